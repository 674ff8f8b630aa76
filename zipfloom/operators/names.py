"""Concept records and the resolution of names to them, shared by the tree and orphan operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINKS = ("hypernyms", "hyponyms", "siblings", "aliases")
FIELDS = ("id", "text", *LINKS, "domain_key", "lang", "created_at", "deleted_at")


def concept_records(concepts: DataFrame) -> DataFrame:
    """One row per non-null id. Repeated rows are one record; of differing rows the greatest by
    (created_at, text, ...) is taken, so the choice does not depend on row order. Extra columns are dropped."""
    rest = ["created_at", "text", "domain_key", "lang", "deleted_at", *LINKS]
    best = F.max(F.struct(*[concepts[c].alias(c) for c in rest])).alias("r")
    return concepts.filter(concepts["id"].isNotNull()).groupBy(concepts["id"].alias("id")).agg(best).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def is_name(c: Column) -> Column:
    """Nulls and empty strings are no references."""
    return c.isNotNull() & (c != "")


def name_index(records: DataFrame) -> DataFrame:
    """(domain_key, lang, name) -> the concept it stands for: by text first, else by alias.

    Two concepts that claim one name at the same priority resolve to the smaller id. Keys are unique, so
    a join on them never multiplies rows. Null domain_key or lang are kept as keys of their own
    (join null-safe).
    """
    by_text = records.filter(is_name(F.col("text"))).select("domain_key", "lang", F.col("text").alias("name"), F.struct(F.lit(0).alias("prio"), "id", "created_at", F.col("deleted_at").isNotNull().alias("deleted")).alias("t"))
    by_alias = records.select("domain_key", "lang", F.explode(F.array_distinct("aliases")).alias("name"), F.struct(F.lit(1).alias("prio"), "id", "created_at", F.col("deleted_at").isNotNull().alias("deleted")).alias("t")).filter(is_name(F.col("name")))
    best = by_text.unionByName(by_alias).groupBy("domain_key", "lang", "name").agg(F.min("t").alias("t"))
    return best.select("domain_key", "lang", "name", F.col("t.prio").alias("prio"), F.col("t.id").alias("target"), F.col("t.created_at").alias("target_created"), F.col("t.deleted").alias("target_deleted"))


def resolve(refs: DataFrame, index: DataFrame, how: str) -> DataFrame:
    """Joins refs (domain_key, lang, name, ...) to the index."""
    i = index.select(*[F.col(c).alias(f"_i_{c}") for c in ("domain_key", "lang", "name")], "prio", "target", "target_created", "target_deleted")
    on = refs["domain_key"].eqNullSafe(i["_i_domain_key"]) & refs["lang"].eqNullSafe(i["_i_lang"]) & (refs["name"] == i["_i_name"])
    return refs.join(i, on, how).drop("_i_domain_key", "_i_lang", "_i_name")
