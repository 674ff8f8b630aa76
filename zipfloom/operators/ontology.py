"""Substitution checks against a concept graph of several ontologies (domain_key, lang).

Only hypernyms give direction. A name stands for the concept of that text, else for one that has it as an
alias; the broader name is compared as written. Closures join pairs with themselves, so rounds grow as the
logarithm of the depth, and end on circular graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import is_safe
from ..session import Scratch
from .names import concept_records, is_name, name_index, resolve

ONTO = ("domain_key", "lang")


def named_hypernyms(records: DataFrame) -> DataFrame:
    """(domain_key, lang, id, name), as written."""
    return records.select(*ONTO, "id", F.explode(F.array_distinct("hypernyms")).alias("name")).filter(is_name(F.col("name")))


def broader_names(records: DataFrame, write) -> DataFrame:
    """(domain_key, lang, id, name): every name by which something broader than the concept is listed on the
    way up from it. write(df, name) stores a table."""
    base = write(named_hypernyms(records), "named")
    step = resolve(base, name_index(records), "inner").select(*ONTO, "id", F.col("target").alias("up")).distinct()
    pairs, n, i = write(step, "up/0"), -1, 0
    while True:
        got = pairs.count()
        if got == n:
            break
        n, i = got, i + 1
        twice = pairs.select(*ONTO, "id", F.col("up").alias("_m")).join(pairs.select(*ONTO, F.col("id").alias("_m"), "up"), [*ONTO, "_m"]).select(*ONTO, "id", "up")
        pairs = write(pairs.unionByName(twice).distinct(), f"up/{i}")
    above = pairs.join(base.select(*ONTO, F.col("id").alias("up"), "name"), [*ONTO, "up"]).select(*ONTO, "id", "name")
    return base.unionByName(above).distinct()


def substitutions(pairs: DataFrame, records: DataFrame, broader: DataFrame) -> DataFrame:
    """pairs (domain_key, lang, original, candidate) -> with verdict and safe. Repeated pairs stay repeated."""
    index = name_index(records)
    side = lambda df, name, out: resolve(df.withColumn("name", F.col(name)), index, "left").withColumnRenamed("target", out).drop("name", "prio", "target_created", "target_deleted")
    j = side(side(pairs, "original", "a_id"), "candidate", "b_id")
    for out, of, name in (("a_over", "b_id", "original"), ("b_over", "a_id", "candidate")):
        b = broader.select(F.col("domain_key").alias("_d"), F.col("lang").alias("_l"), F.col("id").alias("_i"), F.col("name").alias("_n"), F.lit(True).alias(out))
        j = j.join(b, (j["domain_key"] == b["_d"]) & (j["lang"] == b["_l"]) & (j[of] == b["_i"]) & (j[name] == b["_n"]), "left").drop("_d", "_l", "_i", "_n")
    r = records.select("id", F.coalesce("siblings", F.array().cast("array<string>")).alias("_s"), F.coalesce("hypernyms", F.array().cast("array<string>")).alias("_h"))
    j = j.join(r.select(F.col("id").alias("a_id"), F.col("_s").alias("_as"), F.col("_h").alias("_ah")), "a_id", "left").join(r.select(F.col("id").alias("b_id"), F.col("_s").alias("_bs"), F.col("_h").alias("_bh")), "b_id", "left")
    sibling = F.array_contains("_as", F.col("candidate")) | F.array_contains("_bs", F.col("original")) | F.arrays_overlap("_ah", "_bh")
    verdict = (
        F.when(F.col("original") == F.col("candidate"), "Allowed")
        .when(F.col("a_id").isNull() | F.col("b_id").isNull(), "Unrelated")
        .when(F.col("a_id") == F.col("b_id"), "Allowed")
        .when(F.col("a_over"), "Narrowing")
        .when(F.col("b_over"), "Widening")
        .when(F.coalesce(sibling, F.lit(False)), "CrossBranch")
        .otherwise("Unrelated")
    )
    return j.withColumn("verdict", verdict).withColumn("safe", is_safe(F.col("verdict"))).select(*pairs.columns, "verdict", "safe")


def check_substitutions(concepts: DataFrame, pairs: DataFrame, unsafe_only: bool = False) -> DataFrame:
    """Verdicts of all pairs, or of the unsafe ones."""
    s = Scratch(concepts.sparkSession, "ontology")
    rec = s.write(concept_records(concepts), "records")
    out = substitutions(pairs, rec, s.write(broader_names(rec, s.write), "broader"))
    return out.filter(~F.col("safe")) if unsafe_only else out


def changed_pairs(texts: DataFrame, original: str = "original", candidate: str = "candidate") -> DataFrame:
    """Each candidate word that is not in the original, with the first original word the candidate lacks."""
    t = texts.withColumn("_o", T.change_words(F.col(original))).withColumn("_c", T.change_words(F.col(candidate)))
    gone = F.filter("_o", lambda x: ~F.array_contains("_c", x))
    new = F.filter("_c", lambda x: ~F.array_contains("_o", x))
    t = t.withColumn("_gone", F.try_element_at(gone, F.lit(1))).withColumn("_new", new)
    return t.filter(F.col("_gone").isNotNull()).select(*[c for c in texts.columns if c not in (original, candidate)], F.col("_gone").alias("original"), F.explode("_new").alias("candidate"))
