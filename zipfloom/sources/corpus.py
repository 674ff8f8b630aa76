"""Corpora as whole files, and stores of frequency tables and weights."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lang import upload_language
from ..functions.scalars import THRESHOLDS, WEIGHTS


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, lang, text): files of any kind as raw text; name is the file's without its last extension."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("text"))
    name = F.regexp_replace(F.url_decode(F.regexp_extract("f", r"([^/]+)$", 1)), r"\.[^.]*$", "")
    return raw.select(name.alias("name"), upload_language(F.col("text")).alias("lang"), "text")


class TableStore:
    """Frequency tables by name: one partition of a parquet table each, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, table: DataFrame) -> None:
        """table holds a column name; only its names are replaced."""
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(self.path)

    def load(self, name: str) -> DataFrame | None:
        t = self._all()
        got = t.filter(F.col("name") == name) if t is not None else None
        return got if got is not None and got.limit(1).count() else None

    def names(self) -> list[str]:
        t = self._all()
        return [] if t is None else sorted(r["name"] for r in t.select("name").distinct().collect())

    def delete(self, name: str) -> None:
        t = self._all()
        if t is not None and name in self.names():
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/name={name}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _all(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None


def load_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """Stored weights, or the defaults where there are none or they are not whole."""
    try:
        r = spark.read.schema(", ".join(f"{k} double" for k in WEIGHTS)).json(path).first()
    except AnalysisException:  # no such path
        return dict(WEIGHTS)
    return dict(WEIGHTS) if r is None or any(v is None for v in r) else r.asDict()


def save_weights(spark: SparkSession, weights: dict[str, float], path: str) -> None:
    spark.createDataFrame([tuple(float(weights[k]) for k in WEIGHTS)], ", ".join(f"{k} double" for k in WEIGHTS)).coalesce(1).write.mode("overwrite").json(path)


def defaults(spark: SparkSession) -> DataFrame:
    """(thresholds, weights) as JSON, one row."""
    one = lambda d: F.to_json(F.struct(*[F.lit(float(v)).alias(k) for k, v in d.items()]))
    return spark.range(1).select(one(THRESHOLDS).alias("thresholds"), one(WEIGHTS).alias("weights"))
