"""Ordering, best-of and distinct operators. All ties go to the earlier input position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scoring import multi_layer


def rank_sentences(scored: DataFrame, batch: str, pos: str = "input_pos", score: str = "score", write=None) -> DataFrame:
    """Adds rank, 1 for the best of its batch. `pos` is unique within a batch.

    A batch may be a third of all rows: rows are ranged by (batch, score, pos), so it lies over many partitions,
    and ranks are places within a partition plus what the partitions before hold of the batch.
    write(df, name) stores the ranged rows; without it the groups are small and one window ranks them.
    """
    order = [F.desc(score), F.asc(pos)]
    if write is None:
        return scored.withColumn("rank", F.row_number().over(W.partitionBy(batch).orderBy(*order)))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = write(scored.repartitionByRange(parts, F.asc(batch), *order).withColumn("_p", F.spark_partition_id()), "ranged")
    held = r.groupBy(batch, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = held.select(F.col(batch).alias("_b"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(W.partitionBy(batch).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = r.withColumn("_r", F.row_number().over(W.partitionBy(batch, "_p").orderBy(*order)))
    j = local.join(before, local[batch].eqNullSafe(before["_b"]) & (local["_p"] == before["_q"]))
    return j.withColumn("rank", (F.col("_before") + F.col("_r")).cast("int")).select(*scored.columns, "rank")


def batch_language(rows: DataFrame, batch: str, text: str, lang: str, pos: str = "input_pos") -> DataFrame:
    """(batch, lang): the language of the first non-empty sentence, en where there is none."""
    first = F.min(F.when(F.col(text) != "", F.struct(F.col(pos).alias("p"), F.col(lang).alias("l"))))
    return rows.groupBy(batch).agg(first.alias("f")).select(batch, F.coalesce("f.l", F.lit("en")).alias("lang"))


def rank_candidates(originals: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """originals (key, text, score) and candidates (key, pos, text, score) -> (key, text, score, is_original,
    rank). The original comes last, so ties favour candidates."""
    o = originals.select(key, F.lit(2**31 - 1).alias("pos"), "text", "score", F.lit(True).alias("is_original"))
    c = candidates.select(key, F.col("pos").cast("int").alias("pos"), "text", "score", F.lit(False).alias("is_original"))
    return rank_sentences(c.unionByName(o), key, "pos").drop("pos")


def score_candidates(measures: DataFrame, key: str, slot_preservation: Column, domain_relevance: Column | None = None, pos: str = "pos") -> DataFrame:
    """measures of candidates (key, pos, ...) -> with final_score and rank, the layered score, best first of each key;
    equal scores (to nine places) by pos."""
    m = multi_layer(measures, slot_preservation, domain_relevance).withColumn("_s", F.round("final_score", 9))
    return m.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_s"), F.asc(pos)))).drop("_s")


def lowest_tokens(scores: DataFrame, key: str, n: int) -> DataFrame:
    """(key, token, zipf, rank): the n distinct tokens (with case) of least score, ties by first position."""
    d = scores.groupBy(key, "token").agg(F.min("pos").alias("pos"), F.min("zipf").alias("zipf"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("zipf", "pos"))).filter(F.col("rank") <= n).select(key, "token", "zipf", "rank")


def lowest_live(scores: DataFrame, key: str, n: int = 3) -> DataFrame:
    """As lowest_tokens, repeats kept."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("zipf", "pos"))).filter(F.col("rank") <= n)


def first_occurrences(rows: DataFrame, key: str, value: str, pos: str = "pos") -> DataFrame:
    """Keeps the first row of each value in its group, by aggregation, so a hot group is no window."""
    rest = [c for c in rows.columns if c not in (key, value)]
    m = rows.groupBy(key, value).agg(F.min(F.struct(F.col(pos).alias("_p"), *[F.col(c) for c in rest])).alias("m"))
    return m.select(key, value, *[f"m.{c}" for c in rest])


def beam(ranked: DataFrame, key: str, width: int = 3) -> DataFrame:
    """The best `width` candidates of each prompt, the original left out."""
    c = ranked.filter(~F.col("is_original"))
    return c.withColumn("beam", F.row_number().over(W.partitionBy(key).orderBy("rank"))).filter(F.col("beam") <= width)


def keep_passing(rows: DataFrame, key: str, passes: str = "passes", score: str = "preservation", pos: str = "pos") -> DataFrame:
    """Rows that pass; where none of a group does, the one of highest preservation, the earlier on ties."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(pos)).alias("p"))).alias("_best")
    g = rows.groupBy(key).agg(F.max(F.col(passes).cast("int")).alias("_any"), best)
    j = rows.join(g, key)
    lone = (F.col("_any") == 0) & (F.col(score) == F.col("_best.s")) & (-F.col(pos) == F.col("_best.p"))
    return j.filter(F.col(passes) | lone).select(*rows.columns)
