"""Ontology files {domain}_{lang}.json: {domain, lang, concepts: {text: concept}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "array<string>"
SCHEMA = f"domain string, lang string, concepts map<string, struct<id:string,text:string,hypernyms:{_LIST},hyponyms:{_LIST},siblings:{_LIST},domain:string,aliases:{_LIST}>>"


def read_ontologies(spark: SparkSession, folder: str) -> DataFrame:
    """Concept rows of all files of a folder, in the columns of the concepts table. Malformed files give no
    rows; missing lists are empty."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    c = raw.filter("concepts is not null").select(F.col("domain").alias("domain_key"), "lang", F.explode("concepts").alias("key", "c"))
    lists = [F.coalesce(f"c.{x}", F.array().cast(_LIST)).alias(x) for x in ("hypernyms", "hyponyms", "siblings", "aliases")]
    return c.select(F.col("c.id").alias("id"), F.col("key").alias("text"), *lists, "domain_key", "lang", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))


def with_fallback(requests: DataFrame, concepts: DataFrame) -> DataFrame:
    """requests (domain_key, lang) -> (domain_key, lang, used): the ontology asked for, else general of the
    language, else null."""
    have = concepts.select("domain_key", "lang").distinct()
    own = have.withColumn("_own", F.lit(True))
    general = have.filter("domain_key = 'general'").select("lang", F.lit(True).alias("_general"))
    j = requests.select("domain_key", "lang").distinct().join(own, ["domain_key", "lang"], "left").join(general, "lang", "left")
    return j.select("domain_key", "lang", F.when(F.col("_own"), F.col("domain_key")).when(F.col("_general"), "general").alias("used"))
