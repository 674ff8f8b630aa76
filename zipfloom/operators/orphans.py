"""References to records that do not exist, kept as incremental keyed state.

The state is four tables of segments in a folder: an index of parents by name, the standing of each reference by
name, the references by the record that makes them, and the records known as deleted. Each is partitioned by a
bucket of its key. A batch appends its own rows and reads only the buckets it touches: new references probe the
parent index, arriving parents settle waiting references (as `late`), deletions reopen settled ones (as `deleted`) and
take out those of a deleted record itself. Only references whose standing changed are appended again. Segments of one
size are merged when FAN of them are there, so a row is rewritten a logarithmic number of times. Each batch adds what
it changed in the counts by table, month and kind, which makes a snapshot for every batch.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import Scratch, list_names, read_text, shared_dir, write_text
from .names import is_name

KEY = ("domain_key", "lang", "name")
REF = ("ref_table", "ref_id", "ref_field", "ref_value")
BUCKETS = 16  # folders a table's segments are split by; more for states of many billions
FAN = 8  # segments of one size that are merged into one

_KEYS = "domain_key string, lang string, name string"
_REFS = "ref_table string, ref_id string, ref_field string, ref_value string"
SCHEMAS = {
    "index": f"{_KEYS}, prio int, id string, created timestamp, deleted boolean, b int",
    # with the standing before, null where the reference is new
    "refs": f"{_REFS}, {_KEYS}, ref_time timestamp, kind string, gone boolean, v long, old_kind string, old_time timestamp, b int",
    "owned": f"{_REFS}, {_KEYS}, b int",
    "gone": "id string, b int",
    "counts": "batch long, ref_table string, month string, kind string, delta long",
}


def _bucket(cols: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def concept_refs(concepts: DataFrame) -> DataFrame:
    """hyponyms and siblings of the delivered rows that are not deleted; null and empty names are no references."""
    one = lambda f: concepts.filter(F.col("deleted_at").isNull()).select("domain_key", "lang", F.col("id").alias("ref_id"), F.lit(f).alias("ref_field"), F.col("created_at").cast("timestamp").alias("ref_time"), F.explode(F.array_distinct(f)).alias("name"))
    return one("hyponyms").unionByName(one("siblings")).filter(is_name(F.col("name"))).select(F.lit("concepts").alias("ref_table"), "ref_id", "ref_field", F.col("name").alias("ref_value"), *KEY, "ref_time")


def alias_refs(aliases: DataFrame) -> DataFrame:
    """A reference for each alias_id and concept it names; null ids and names give none."""
    a = aliases.filter(aliases["alias_id"].isNotNull() & is_name(aliases["concept"]))
    return a.select(F.lit("aliases").alias("ref_table"), a["alias_id"].alias("ref_id"), F.lit("concept").alias("ref_field"), a["concept"].alias("ref_value"), a["domain_key"], a["lang"], a["concept"].alias("name"), a["added_at"].cast("timestamp").alias("ref_time"))


def parent_entries(concepts: DataFrame) -> DataFrame:
    """(key, prio, id, created, deleted): the names of each concept, its text (prio 0) and aliases (prio 1)."""
    entry = lambda prio, name: concepts.select("domain_key", "lang", name.alias("name"), F.lit(prio).alias("prio"), "id", F.col("created_at").cast("timestamp").alias("created"), F.col("deleted_at").isNotNull().alias("deleted")).filter(is_name(F.col("name")))
    return _entries(entry(0, F.col("text")).unionByName(entry(1, F.explode(F.array_distinct("aliases")))))


def _entries(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*KEY, "prio", "id", *more).agg(F.min("created").alias("created"), F.max("deleted").alias("deleted"))


def _same(a: DataFrame, b: DataFrame, cols: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for c in cols:
        on = on & a[c].eqNullSafe(b[f"_{c}"])
    return on


def _marked(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()


class OrphanState:
    """Feed batches with update(); read orphans(), counts() and snapshots() at any time.

    The standing does not depend on how the arrivals are cut into batches or ordered. A record may arrive again:
    what any delivery names is a reference, its creation is the earliest, and once deleted it stays deleted, with none
    of its references an orphan. With a `path` of its own the state survives the driver: a batch counts once its
    manifest is written, and another object at that path goes on from there.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.scratch = Scratch(spark, "orphans")
        self.path = (path or self.scratch.path("state")).rstrip("/")
        shared_dir(spark)
        found = sorted(list_names(spark, f"{self.path}/manifest"))
        self.at = json.loads(read_text(spark, f"{self.path}/manifest/{found[-1]}")) if found else {"batch": 0, "buckets": buckets, "feeds": {}, "segments": {t: [] for t in SCHEMAS}}

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/seg={s}" for s, _ in self.at["segments"][table]]
        schema = T._parse_datatype_string(SCHEMAS[table])
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths).select(*schema.names)
        return df if buckets is None else df.filter(F.col("b").isin(buckets))

    def _append(self, table: str, df: DataFrame, level: int = 0) -> DataFrame:
        """A segment, of the batch under way until its manifest names it."""
        name = f"{self.at['batch'] + 1:09d}-{level}"
        schema = T._parse_datatype_string(SCHEMAS[table])
        w = df.select(*schema.names).write.mode("overwrite")
        (w.partitionBy("b") if "b" in schema.names else w).parquet(f"{self.path}/{table}/seg={name}")
        self.at["segments"][table].append([name, level])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/seg={name}")

    def _commit(self) -> None:
        self.at["batch"] += 1
        write_text(self.spark, f"{self.path}/manifest/{self.at['batch']:09d}.json", json.dumps(self.at))

    def update(self, concepts: DataFrame, aliases: DataFrame, feed: str | None = None, epoch: int = 0) -> None:
        """feed, epoch: name and number of a stream's batch; one that was counted is passed over."""
        if feed is not None and self.at["feeds"].get(feed, -1) >= epoch:
            return
        saved = json.dumps(self.at)
        try:
            self._update(concepts, aliases)
            if feed is not None:
                self.at["feeds"][feed] = epoch
            self._commit()
        except BaseException:
            self.at = json.loads(saved)
            raise
        self._merge()

    def _update(self, concepts: DataFrame, aliases: DataFrame) -> None:
        s, n, first = self.scratch, self.at["buckets"], not self.at["batch"]
        c = concepts.filter(concepts["id"].isNotNull()).select(*[concepts[x].alias(x) for x in ("id", "text", "hyponyms", "siblings", "aliases", "domain_key", "lang", "created_at", "deleted_at")])
        refs = concept_refs(c).unionByName(alias_refs(aliases)).groupBy(*REF, *KEY).agg(F.min("ref_time").alias("ref_time"))
        # three jobs that do not wait for each other
        with ThreadPoolExecutor(3) as pool:
            jobs = [
                pool.submit(self._append, "index", parent_entries(c).withColumn("b", _bucket(KEY, n))),
                pool.submit(self._append, "gone", c.filter("deleted_at is not null").select("id").distinct().withColumn("b", _bucket(("id",), n))),
                pool.submit(s.write, refs.withColumn("b", _bucket(KEY, n)).withColumn("ob", _bucket(("ref_id",), n)), f"new/{self.at['batch']}"),
            ]
            delta, new_gone, new = [j.result() for j in jobs]
        self._append("owned", new.filter("ref_table = 'concepts'").withColumn("b", F.col("ob")))
        # what the batch touches: buckets by name and by record, at most 2 * BUCKETS numbers
        marks = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).alias("b"))
        got = marks(delta, "name", "b").unionByName(marks(new, "name", "b")).unionByName(marks(new.filter("ref_table = 'concepts'"), "id", "ob")).unionByName(marks(new_gone, "gone", "b")).distinct().collect()
        buckets = {k: [r["b"] for r in got if r["kind"] == k] for k in ("name", "id", "gone")}
        keys = delta.select(*KEY).unionByName(new.select(*KEY))
        merged = new.select(*REF, *KEY, "ref_time", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("gone"), F.lit(-1).cast("long").alias("v"))
        gone = new_gone
        if not first:
            gone = self._read("gone", sorted({*buckets["id"], *buckets["gone"]}))
            owned = self._read("owned", buckets["gone"])
            m = new_gone.select(F.col("id").alias("_id"))
            touched = owned.join(m, (owned["ref_table"] == "concepts") & (owned["ref_id"] == m["_id"]), "left_semi").select(*KEY)
            keys = s.write(keys.unionByName(touched).distinct(), f"keys/{self.at['batch']}")
            buckets["name"] = [r["b"] for r in keys.select(_bucket(KEY, n).alias("b")).distinct().collect()]
            k = _marked(keys, KEY)
            old = self._read("refs", buckets["name"])
            merged = merged.unionByName(old.join(k, _same(old, k, KEY), "left_semi").select(merged.columns))
        k = _marked(keys, KEY)
        index = self._read("index", buckets["name"])
        best = index.join(k, _same(index, k, KEY), "left_semi") if not first else index
        best = _entries(best).groupBy(*KEY).agg(F.min(F.struct("prio", "id", "created", "deleted")).alias("t"))
        last = F.max(F.struct("v", "kind", "gone", "ref_time")).alias("old")
        w = merged.groupBy(*REF, *KEY).agg(F.min("ref_time").alias("ref_time"), last)
        g = gone.select(F.col("id").alias("_id")).distinct()
        w = w.join(g, (w["ref_table"] == "concepts") & (w["ref_id"] == g["_id"]), "left").withColumn("gone", F.col("old.gone") | F.col("_id").isNotNull())
        b = best.select(*[F.col(x).alias(f"_{x}") for x in KEY], F.col("t.id").alias("target"), F.col("t.created").alias("made"), F.col("t.deleted").alias("dead"))
        w = w.join(b, _same(w, b, KEY), "left")
        kind = F.when(F.col("gone"), None).when(F.col("target").isNull(), "missing").when(F.col("dead"), "deleted").when(F.col("made") > F.col("ref_time"), "late")
        w = w.withColumn("kind", kind)
        known = F.col("old.v") >= 0
        w = w.filter(~known | ~F.col("kind").eqNullSafe(F.col("old.kind")) | (F.col("gone") != F.col("old.gone")) | ~F.col("ref_time").eqNullSafe(F.col("old.ref_time")))
        batch = F.lit(self.at["batch"] + 1).cast("long")
        w = w.withColumns({"old_kind": F.when(known, F.col("old.kind")), "old_time": F.when(known, F.col("old.ref_time")), "v": batch, "b": _bucket(KEY, n)})
        changed = self._append("refs", w)
        month = lambda t: F.date_format(t, "yyyy-MM").alias("month")
        plus = changed.select("ref_table", month(F.col("ref_time")), "kind", F.lit(1).cast("long").alias("delta"))
        minus = changed.select("ref_table", month(F.col("old_time")), F.col("old_kind").alias("kind"), F.lit(-1).cast("long").alias("delta"))
        self._append("counts", plus.unionByName(minus).filter("kind is not null").groupBy("ref_table", "month", "kind").agg(F.sum("delta").alias("delta")).filter("delta <> 0").withColumn("batch", batch))
        s.drop(f"new/{self.at['batch']}", f"keys/{self.at['batch']}")

    def _latest(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy(*REF, *KEY, "b").agg(F.max(F.struct("v", "ref_time", "kind", "gone", "old_kind", "old_time")).alias("r")).select(*REF, *KEY, "r.*", "b")

    def _merge(self) -> None:
        """FAN segments of one level become one of the next. The folders of the old ones go with the next batch's merge,
        when no reader of the standing before them is left."""
        how = {"index": lambda d: _entries(d, "b"), "refs": self._latest, "owned": lambda d: d.distinct(), "gone": lambda d: d.distinct(), "counts": lambda d: d}
        before, dropped = json.dumps(self.at), []
        for table, merge in how.items():
            while True:
                segments = self.at["segments"][table]
                level = next((x for x in sorted({x for _, x in segments}) if sum(y == x for _, y in segments) >= FAN), None)
                if level is None:
                    break
                some = [x for x in segments if x[1] == level]
                rest = [x for x in segments if x[1] != level]
                self.at["segments"][table] = some
                df = merge(self._read(table))
                self.at["segments"][table] = rest
                self._append(table, df, level + 1)
                dropped += [f"{table}/seg={x}" for x, _ in some]
        if dropped:
            try:
                self._commit()
            except BaseException:
                self.at = json.loads(before)
                raise
            self.scratch.drop_paths(*[f"{self.path}/{x}" for x in dropped])

    def orphans(self) -> DataFrame:
        return self._latest(self._read("refs")).filter(F.col("kind").isNotNull()).select(*REF, "kind", "ref_time")

    def counts(self) -> DataFrame:
        """Orphans by table, month of the reference (null where it bears no time) and kind."""
        return self._read("counts").groupBy("ref_table", "month", "kind").agg(F.sum("delta").alias("n_orphans")).filter("n_orphans > 0")

    def snapshots(self) -> DataFrame:
        """(batch, ref_table, month, kind, n_orphans): the counts after each batch that changed them."""
        w = W.partitionBy("ref_table", "month", "kind").orderBy("batch")
        return self._read("counts").select("batch", "ref_table", "month", "kind", F.sum("delta").over(w).alias("n_orphans"))


def replay(concepts: DataFrame, aliases: DataFrame, batches: int = 3) -> OrphanState:
    """Feeds whole tables in `batches` equal spans of time, each deletion in the span it falls in.

    Rows without a time arrive in the first span.
    """
    spark = concepts.sparkSession
    sec = lambda c: c.cast("timestamp").cast("double")
    times = [concepts.select(sec(F.col(c)).alias("t")) for c in ("created_at", "deleted_at")] + [aliases.select(sec(F.col("added_at")).alias("t"))]
    span = times[0].unionByName(times[1]).unionByName(times[2]).agg(F.min("t"), F.max("t")).first()
    state = OrphanState(spark)
    if span[0] is None or batches < 2:
        state.update(concepts, aliases)
        return state
    width = (span[1] - span[0]) / batches
    nr = lambda c: F.coalesce(F.least(F.floor((sec(c) - span[0]) / F.lit(max(width, 1e-6))), F.lit(batches - 1)), F.lit(0))
    for b in range(batches):
        c = concepts.filter((nr(F.col("created_at")) == b) | (F.col("deleted_at").isNotNull() & (nr(F.col("deleted_at")) == b) & (nr(F.col("created_at")) <= b)))
        if b < batches - 1:
            c = c.withColumn("deleted_at", F.when(nr(F.col("deleted_at")) <= b, F.col("deleted_at")))
        state.update(c, aliases.filter(nr(F.col("added_at")) == b))
    return state
