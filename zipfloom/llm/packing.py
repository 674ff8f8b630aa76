"""Filling fixed-capacity containers with texts, by optimal length buckets.

The global histogram of lengths (no more rows than the capacity) goes to the driver. Dynamic programming chooses
the bucket boundaries of least padding; with the bucket's upper length as the size of its items, batches of
a token budget form inside each bucket, largest first, and room left over is filled with batches of the
smaller buckets where it fits best. The plan is a few ranges a bucket. Rows are then numbered within their
bucket (salted, so no bucket is one task's) and look their container up in the ranges.

A text longer than the capacity is split into full pieces and a rest; no other is split. Null and empty texts,
of no tokens, need no room: one row with container null.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

BUCKETS = 256
FOLDER = "/opt/tokenizers"
SALT_ROWS = 200_000  # rows numbered together, about


# ---- plan (driver, bounded by the capacity) -------------------------------------------------------


def boundaries(hist: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most `buckets` buckets that hold all lengths with the least sum of
    (upper - length). Lines of a convex hull make each bucket's row of the table linear in the lengths."""
    s = sorted(hist)
    if len(s) <= buckets:
        return s
    m = len(s)
    n_to, t_to = [0], [0]
    for x in s:
        n_to.append(n_to[-1] + hist[x])
        t_to.append(t_to[-1] + hist[x] * x)
    inf = float("inf")
    prev: list = [0] + [inf] * m
    back: list[list[int]] = []
    for _ in range(buckets):
        cur, choice = [inf] * (m + 1), [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            if prev[i] != inf:
                line = (-n_to[i], prev[i] + t_to[i], i)
                while len(hull) - head >= 2:
                    a, b = hull[-2], hull[-1]
                    if (line[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
            if len(hull) <= head:
                continue
            x = s[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            best = hull[head]
            cur[j] = best[0] * x + best[1] + x * n_to[j] - t_to[j]
            choice[j] = best[2]
        back.append(choice)
        prev = [inf] + cur[1:]
    out, j = [], m
    for choice in reversed(back):
        out.append(s[j - 1])
        j = choice[j]
        if j == 0:
            break
    return sorted(out)


def plan(hist: dict[int, int], capacity: int, buckets: int = BUCKETS) -> tuple[list[int], list[tuple[int, int, int, int]], int]:
    """(uppers, ranges, containers). A range (bucket, first rank, first container, items each) sends the
    ranks from its first on to consecutive containers."""
    hist = {k: v for k, v in hist.items() if 0 < k <= capacity and v > 0}
    uppers = boundaries(hist, buckets)
    count = [0] * len(uppers)
    for k, v in hist.items():
        count[bisect_left(uppers, k)] += v
    ranges: list[tuple[int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first container, how many)
    total = 0
    for b in range(len(uppers) - 1, -1, -1):
        u, left, rank = uppers[b], count[b], 0
        while left:
            fit = min((r for r in room if r >= u), default=None)
            if fit is None:
                fit, spans = capacity, [(total, -(-left // (capacity // u)))]
                total += spans[0][1]
                room[fit] = spans
            spans = room[fit]
            first, many = spans.pop()
            if not spans:
                del room[fit]
            each = fit // u
            full = min(many, left // each)
            if full:
                ranges.append((b, rank, first, each))
                rank, left = rank + full * each, left - full * each
                room.setdefault(fit - each * u, []).append((first, full))
            if left and full < many:  # fewer than `each` are left
                ranges.append((b, rank, first + full, left))
                room.setdefault(fit - left * u, []).append((first + full, 1))
                full, rank, left = full + 1, rank + left, 0
            if full < many:
                room.setdefault(fit, []).append((first + full, many - full))
    return uppers, ranges, total


# ---- sizes ----------------------------------------------------------------------------------------


def counter(tokenizer: str, folder: str):
    """texts -> token counts by a public tokenizer of the folder."""
    p = Path(folder)
    if tokenizer.startswith("byte_bpe") and (p / f"{tokenizer}.json").exists():
        enc = bpe.encoder(str(p / f"{tokenizer}.json"))
        return lambda texts: [len(x) for x in enc(texts)]
    if (p / f"{tokenizer}.tiktoken").exists():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p / f"{tokenizer}.tiktoken", "rb"))}
        e = tiktoken.Encoding(tokenizer, pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(t or "")) for t in texts]
    if (p / f"{tokenizer}.model").exists():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=str(p / f"{tokenizer}.model"))
        return lambda texts: [len(x) for x in sp.encode([t or "" for t in texts], num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(p / f"{tokenizer}.json"))
    t.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def sizes(documents: DataFrame, tokenizers: list[str], folder: str = FOLDER) -> DataFrame:
    """(doc_id, tokenizer, tokens), one row a document and tokenizer."""

    def run(batches):
        count = {t: counter(t, folder) for t in tokenizers}
        for b in batches:
            texts = b.column("text").to_pylist()
            for t in tokenizers:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t] * len(texts), pa.string()), pa.array(count[t](texts), pa.int64())], names=["doc_id", "tokenizer", "tokens"])

    return documents.select(documents["doc_id"].alias("doc_id"), documents["text"].alias("text")).mapInArrow(run, "doc_id long, tokenizer string, tokens long")


# ---- assignment -----------------------------------------------------------------------------------


def pack(documents: DataFrame, specs: DataFrame, write, folder: str = FOLDER, buckets: int = BUCKETS) -> DataFrame:
    """(spec_id, doc_id, piece, tokens, bucket, container). specs is small by its meaning: one row a kind of
    container; rows without a positive capacity are left out. write(df, name) stores a table."""
    spark = documents.sparkSession
    kinds = {r["spec_id"]: (int(r["capacity"]), r["tokenizer"]) for r in specs.select("spec_id", "capacity", "tokenizer").distinct().collect() if r["spec_id"] is not None and r["capacity"] and r["capacity"] > 0 and r["tokenizer"]}
    schema = "spec_id int, doc_id long, piece int, tokens long, bucket long, container long"
    if not kinds:
        return spark.createDataFrame([], schema)
    size = write(sizes(documents, sorted({t for _, t in kinds.values()}), folder), "sizes")
    kind = F.array(*[F.struct(F.lit(k).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity"), F.lit(t).alias("t")) for k, (c, t) in sorted(kinds.items())])
    rows = size.select("doc_id", "tokens", F.explode(F.filter(kind, lambda x: x["t"] == F.col("tokenizer"))).alias("k")).select("doc_id", "tokens", "k.spec_id", "k.capacity")
    full, rest = F.floor(F.col("tokens") / F.col("capacity")), F.col("tokens") % F.col("capacity")
    # full pieces of long texts, then what is left (the whole of all other texts)
    lens = F.concat(F.array_repeat(F.col("capacity"), full.cast("int")), F.when((rest > 0) | (full == 0), F.array(rest)).otherwise(F.array().cast("array<long>")))
    pieces = rows.select("spec_id", "doc_id", F.posexplode(lens).alias("piece", "size"))
    hist: dict[int, dict[int, int]] = {k: {} for k in kinds}
    for r in pieces.groupBy("spec_id", "size").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity rows a kind
        hist[r["spec_id"]][r["size"]] = r["n"]
    plans = {k: plan(hist[k], kinds[k][0], buckets) for k in kinds}
    most = max([1, *(n for h in hist.values() for n in h.values())])
    salts = int(max(8, most // SALT_ROWS))
    shipped = spark.sparkContext.broadcast({k: (np.array(p[0], dtype=np.int64), *_columns(p[1], len(p[0]))) for k, p in plans.items()})

    def bucketed(batches):
        for b in batches:
            spec, s = b.column("spec_id").to_numpy(), b.column("size").to_numpy()
            at = np.full(len(s), -1, dtype=np.int64)
            for k, p in shipped.value.items():
                m = (spec == k) & (s > 0)
                at[m] = np.searchsorted(p[0], s[m])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "bucket"])

    item = pieces.mapInArrow(bucketed, "spec_id int, doc_id long, piece int, size long, bucket long").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    item = write(item, "items")
    part = ["spec_id", "bucket", "salt"]
    held = item.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    before = held.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("spec_id", "bucket").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = item.withColumn("rn", F.row_number().over(W.partitionBy(*part).orderBy("doc_id", "piece"))).join(before, part)
    ranked = numbered.select("spec_id", "doc_id", "piece", "size", "bucket", (F.col("before") + F.col("rn") - 1).alias("rank"))

    def placed(batches):
        for b in batches:
            spec, bucket, rank = (b.column(c).to_numpy() for c in ("spec_id", "bucket", "rank"))
            box = np.full(len(spec), -1, dtype=np.int64)
            upper = np.zeros(len(spec), dtype=np.int64)
            for k, (tops, begin, ranks, firsts, each) in shipped.value.items():
                for u in np.unique(bucket[(spec == k) & (bucket >= 0)]):
                    m = (spec == k) & (bucket == u)
                    lo, hi = begin[u], begin[u + 1]
                    at = lo + np.searchsorted(ranks[lo:hi], rank[m], side="right") - 1
                    box[m] = firsts[at] + (rank[m] - ranks[at]) // each[at]
                    upper[m] = tops[u]
            yield pa.RecordBatch.from_arrays([b.column("spec_id"), b.column("doc_id"), b.column("piece"), b.column("size"), pa.array(upper), pa.array(box, mask=box < 0)], names=["spec_id", "doc_id", "piece", "tokens", "bucket", "container"])

    return ranked.mapInArrow(placed, schema)


def _columns(ranges: list[tuple[int, int, int, int]], n: int):
    r = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 4)
    return np.searchsorted(r[:, 0], np.arange(n + 1)), r[:, 1], r[:, 2], r[:, 3]


def summary(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, containers, tokens, unused): unused is the share of the containers' room."""
    s = packed.filter("container is not null").groupBy("spec_id", "container").agg(F.sum("tokens").alias("t")).groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return s.join(specs.select("spec_id", "capacity"), "spec_id").select("spec_id", "capacity", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"))


def checks(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, documents, pieces_twice, overfull, needless_splits): what has to hold of any packing. Documents placed or
    known to have no tokens, pieces that stand in two places, containers above their capacity, and texts in several
    pieces although they fit one container."""
    p = packed.join(specs.select("spec_id", "capacity"), "spec_id")
    docs = p.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("d"), F.max("capacity").alias("capacity"))
    docs = docs.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") > F.col("d")).alias("pieces_twice"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("needless_splits"))
    full = p.filter("container is not null").groupBy("spec_id", "container").agg((F.sum("tokens") > F.max("capacity")).alias("over")).groupBy("spec_id").agg(F.count_if("over").alias("overfull"))
    return docs.join(full, "spec_id").select("spec_id", "documents", "pieces_twice", "overfull", "needless_splits")
