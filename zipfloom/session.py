"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("zipfloom")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session that names none gets one of its own; on a
    cluster a folder of one machine would lose rows, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not os.environ.get("ZIPFLOOM_LOCAL_SHARED"):
        os.environ["ZIPFLOOM_LOCAL_SHARED"] = tempfile.mkdtemp(prefix="zipfloom-")
    return "file://" + os.environ["ZIPFLOOM_LOCAL_SHARED"]


def own_session(spark: SparkSession) -> SparkSession:
    """A session of the same context and settings, to change settings in without changing the caller's."""
    child = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            child.conf.set(k, v)
    return child


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder; those under way are left out."""
    fs, p = _fs(spark, path)
    return [n for n in (x.getPath().getName() for x in (fs.listStatus(p) if fs.exists(p) else [])) if not n.startswith(("_", "."))]


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small ASCII file, whole or not at all."""
    folder, name = path.rsplit("/", 1)
    fs, under_way = _fs(spark, f"{folder}/_{name}")
    out = fs.create(under_way, True)
    out.writeBytes(text)
    out.close()
    _, p = _fs(spark, path)
    fs.delete(p, False)
    if not fs.rename(under_way, p):
        raise OSError(f"cannot write {path}")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table outlives a lost executor. Tables stay until drop() or, for those a returned
    DataFrame still reads, until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._at_exit)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_counted(self, df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
        """write(), with aggregates taken on the way, so no second job reads the table to count it."""
        seen = Observation()
        return self.write(df.observe(seen, *[v.alias(k) for k, v in sums.items()]), name), dict(seen.get)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Deletes the named tables, or all of them."""
        self.drop_paths(*[f"{self.root}/{name}".rstrip("/") for name in names or ("",)])

    def drop_paths(self, *paths: str) -> None:
        if self.spark.sparkContext._jvm is None:  # at exit, after the session was stopped
            return
        for path in paths:
            fs, p = _fs(self.spark, path)
            fs.delete(p, True)

    def _at_exit(self) -> None:
        try:
            self.drop()
        except (Py4JError, Py4JNetworkError, ConnectionError, AttributeError):  # the JVM is gone, and on a local session its folder may be left
            pass
