"""Does a rewrite keep what its prompt says? Slot verdicts and their sums, as joins and aggregations.

Slots of a prompt: (id, slot_ord, kind, text); similarities are matched by (id, slot_ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def exact_verdict(kind: Column, text: Column, matched: Column) -> Column:
    """1.0 or 0.0 for kinds that must stay as they are, null for the others."""
    return F.when(S.needs_exact(kind), F.when(F.coalesce(matched == text, F.lit(False)), 1.0).otherwise(0.0))


def structural_check(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, slot_ord, kind, text, issue): each exact slot, issue 'missing' where the candidate (id, candidate)
    does not hold it, else null."""
    j = slots.filter(S.needs_exact(F.col("kind"))).join(candidates.select("id", "candidate"), "id")
    return j.select("id", "slot_ord", "kind", "text", F.when(~F.coalesce(F.contains("candidate", F.col("text")), F.lit(False)), "missing").alias("issue"))


def passes(kind: Column, similarity: Column, threshold: Column | None = None) -> Column:
    t = threshold if threshold is not None else S.threshold(kind)
    return F.when(S.needs_exact(kind), similarity >= 0.999).otherwise(similarity >= t)


def verify_slots(slots: DataFrame, similarities: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """(id, slot_ord, kind, text, matched, similarity, threshold, passes). A slot without a similarity has
    matched null and 0; exact slots are judged by equality, whatever similarity was given."""
    s = similarities.select("id", "slot_ord", F.col("text").alias("matched"), F.col("similarity").alias("_s"))
    j = slots.select("id", "slot_ord", "kind", "text").join(s, ["id", "slot_ord"], "left")
    j = j.withColumn("similarity", F.coalesce(exact_verdict(F.col("kind"), F.col("text"), F.col("matched")), "_s", F.lit(0.0))).drop("_s")
    j = j.join(thresholds.select("kind", "threshold"), "kind", "left") if thresholds is not None else j.withColumn("threshold", S.threshold(F.col("kind")))
    return j.withColumn("passes", passes(F.col("kind"), F.col("similarity"), F.col("threshold"))).select("id", "slot_ord", "kind", "text", "matched", "similarity", "threshold", "passes")


def preservation(verdicts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, preservation, passes, total, kept, dropped, slot_share, bad): 0.0 if an exact slot fails, else the mean
    similarity. ids: prompts to keep a row for without slots (1.0, passing)."""
    failed = F.max((S.needs_exact(F.col("kind")) & ~F.col("passes")).cast("int")) == 1
    kept = F.sum(F.col("passes").cast("int"))
    total = F.count(F.lit(1))
    v = verdicts.groupBy("id").agg(F.when(failed, 0.0).otherwise(F.avg("similarity")).alias("preservation"), F.min("passes").alias("passes"), total.alias("total"), kept.alias("kept"))
    j = v if ids is None else ids.select("id").join(v, "id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("id", F.coalesce("preservation", F.lit(1.0)).alias("preservation"), F.coalesce("passes", F.lit(True)).alias("passes"), z("total").alias("total"), z("kept").alias("kept"), (z("total") - z("kept")).alias("dropped"), (z("kept") / F.greatest(z("total"), F.lit(1))).alias("slot_share"), ((z("total") - z("kept")) / F.greatest(z("total"), F.lit(1)) > 0.5).alias("bad"))
