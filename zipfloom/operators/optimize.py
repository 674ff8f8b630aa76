"""The optimising pipeline over tables: guard, substitution guard, beam, second round, final choice.

Candidates come as tables, so the loop is two fixed rounds of joins and aggregations over all prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking as R

GAIN_ENOUGH, GAIN_COUNTS, BEAM = 1.5, 0.02, 3


def distinct_candidates(candidates: DataFrame, key: str = "id") -> DataFrame:
    return R.first_occurrences(candidates, key, "text")


def guard(candidates: DataFrame, key: str = "id") -> DataFrame:
    """candidates (key, pos, text, preservation, passes): what passes, or the one best kept of a prompt."""
    return R.keep_passing(candidates, key)


def drop_unsafe(candidates: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Leaves out candidates with an unsafe substitution in verdicts (key, text, safe)."""
    bad = verdicts.filter(~F.col("safe")).select(key, "text").distinct()
    return candidates.join(bad, [key, "text"], "left_anti")


def needs_second(best: DataFrame, originals: DataFrame, key: str = "id") -> DataFrame:
    """Prompts whose best candidate gains less than 1.5 on them. best, originals: (key, score)."""
    j = originals.select(key, F.col("score").alias("_o")).join(best.select(key, F.col("score").alias("_b")), key)
    return j.filter(F.col("_b") - F.col("_o") < GAIN_ENOUGH).select(key)


def optimize(originals: DataFrame, round1: DataFrame, round2: DataFrame | None = None, unsafe: DataFrame | None = None, key: str = "id") -> DataFrame:
    """originals (key, text, score); rounds (key, pos, text, score, preservation, passes) -> (key, original,
    optimized, original_score, optimized_score, second_applied). Prompts left without candidates keep their
    original."""
    r1 = guard(distinct_candidates(round1, key), key)
    r1 = drop_unsafe(r1, unsafe, key) if unsafe is not None else r1
    beam1 = R.beam(R.rank_candidates(originals, r1, key), key, BEAM)
    best1 = beam1.filter("beam = 1").select(key, F.col("score").alias("best1"))
    pool = beam1.select(key, F.col("rank").alias("pos"), "text", "score", F.lit(1).alias("round"))
    if round2 is not None:
        allowed = needs_second(best1.withColumnRenamed("best1", "score"), originals, key)
        r2 = guard(distinct_candidates(round2.join(allowed, key, "left_semi"), key), key)
        r2 = drop_unsafe(r2, unsafe, key) if unsafe is not None else r2
        pool = pool.unionByName(r2.select(key, (F.col("pos") + BEAM).alias("pos"), "text", "score", F.lit(2).alias("round")))
    had2 = pool.groupBy(key).agg((F.max("round") == 2).alias("_two"))
    ranked = R.rank_candidates(originals, R.first_occurrences(pool, key, "text"), key).filter("rank = 1")
    j = ranked.select(key, F.col("text").alias("optimized"), F.col("score").alias("optimized_score")).join(originals.select(key, F.col("text").alias("original"), F.col("score").alias("original_score")), key)
    j = j.join(best1, key, "left").join(had2, key, "left")
    second: Column = F.coalesce(F.col("_two") & (F.col("optimized_score") > F.col("best1") + GAIN_COUNTS), F.lit(False))
    return j.select(key, "original", "optimized", "original_score", "optimized_score", second.alias("second_applied"))
