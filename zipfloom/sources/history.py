"""The history of optimised prompts: append, newest first, import and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAP = 50
ENTRY = "id string, timestamp bigint, original string, optimized string, optimizedScore double, originalScore double, language string"


def newest(history: DataFrame, time: str = "ts_millis", cap: int = CAP) -> DataFrame:
    """The `cap` newest entries, newest first; ties by id. Taken by top-k, not by a total sort."""
    return history.orderBy(F.desc(time), F.asc("id")).limit(cap)


def latest_deliveries(history: DataFrame) -> DataFrame:
    """One row an id, the latest saved; of rows saved at once the greatest. Null ids are left out."""
    rest = ["saved_at", *[c for c in history.columns if c not in ("id", "saved_at")]]
    return history.filter("id is not null").groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", "r.*").select(*history.columns)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An exported JSON array in the columns of the history table; malformed files give no rows."""
    r = spark.read.schema(ENTRY).option("multiLine", True).json(path)
    return r.filter("id is not null or original is not null").select("id", F.col("timestamp").alias("ts_millis"), "original", "optimized", F.col("optimizedScore").alias("optimized_score"), F.col("originalScore").alias("original_score"), F.col("language").alias("lang"))


def write_export(history: DataFrame, path: str) -> None:
    h = history.select("id", F.col("ts_millis").alias("timestamp"), "original", "optimized", F.col("optimized_score").alias("optimizedScore"), F.col("original_score").alias("originalScore"), F.col("lang").alias("language"))
    h.write.mode("overwrite").json(path)


def new_entries(present: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entries of an import with an id and a prompt whose id is not present; repeats inside it stay."""
    ok = incoming.filter((F.coalesce("id", F.lit("")) != "") & (F.coalesce("original", F.lit("")) != ""))
    return ok.join(present.select("id").distinct(), "id", "left_anti")


def import_count(present: DataFrame, incoming: DataFrame) -> DataFrame:
    """(imported): how many entries an import adds, one row."""
    return new_entries(present, incoming).agg(F.count(F.lit(1)).alias("imported"))


def merged(present: DataFrame, incoming: DataFrame, cap: int = CAP) -> DataFrame:
    """New entries before those present, each newest first, at most `cap`."""
    new = new_entries(present, incoming).withColumn("_old", F.lit(0))
    both = new.unionByName(present.select(*incoming.columns).withColumn("_old", F.lit(1)))
    return both.orderBy("_old", F.desc("ts_millis"), "id").limit(cap).drop("_old")
