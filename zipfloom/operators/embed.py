"""Heuristic text vectors, a pluggable embedder, and nearest vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIM = 64
BLOCK = 4096  # query vectors compared at once


def utf16_units(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16).tolist()


def hash_units(units) -> int:
    h = 0
    for u in units:
        h = (h * 31 + u + 0x80000000) % 0x100000000 - 0x80000000
    return abs(h)


def heuristic_vector(text: str, dim: int = DIM) -> np.ndarray:
    """Hashed character n-grams of one to three UTF-16 units weighing 1/n, words of two units and more weighing
    0.5; length 1 in 32-bit floats, zeros for an empty text."""
    v = np.zeros(dim, dtype=np.float32)
    low = text.lower().strip()
    words = low.split()
    units = np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.int64)
    h = np.zeros(len(units), dtype=np.int64)
    for n in (1, 2, 3):  # three units stay below 2**31, so nothing wraps
        if len(units) < n:
            break
        h = h[: len(units) - n + 1] * 31 + units[n - 1 :]
        np.add.at(v, h % dim, np.float32(1.0 / n))
    for w in words:
        u = utf16_units(w)
        if len(u) >= 2:
            v[hash_units(u) % dim] += np.float32(0.5)
    norm = np.float32(np.sqrt(np.float64((v.astype(np.float64) ** 2).sum())))
    return v / norm if norm > 0 else v


def embedder(encode: Callable[[str], np.ndarray] = heuristic_vector):
    """A column function text -> array<float> from any text encoder; each distinct text of a batch is encoded once."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        known = {t: encode(t) for t in s.dropna().unique()}
        return s.map(lambda t: None if t is None else known[t].tolist())

    def apply(text: Column) -> Column:
        return run(text)

    return apply


_KEPT: dict[Callable, dict[str, np.ndarray]] = {}
MOST_KEPT = 50_000  # vectors a worker remembers of each encoder


def _encoded(encode: Callable[[str], np.ndarray], texts) -> np.ndarray:
    """The vectors of distinct texts. Slots are mostly words, and a word comes up in many batches."""
    known = _KEPT.setdefault(encode, {})
    if len(known) > MOST_KEPT:
        known.clear()
    out = []
    for t in texts:
        v = known.get(t)
        if v is None:
            v = encode(t)
            if len(t) <= 64:
                known[t] = v
        out.append(v)
    return np.stack(out).astype(np.float64)


def unit_vectors(encode: Callable[[str], np.ndarray], texts: list[str]) -> np.ndarray:
    """Vectors of length 1, zeros for a text without one."""
    m = _encoded(encode, texts)
    norm = np.linalg.norm(m, axis=1)
    return m / np.where(norm > 0, norm, 1)[:, None]


def text_similarity(encode: Callable[[str], np.ndarray] = heuristic_vector):
    """A column function (text, text) -> cosine of their vectors, 0 where a text is null or a vector zero. Each
    distinct text of a batch is encoded once, and no vector leaves the function, so joins of many pairs
    carry texts only."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        code, texts = pd.factorize(pd.concat([x, y], ignore_index=True), use_na_sentinel=True)
        if not len(texts):
            return pd.Series(np.zeros(len(x)))
        m = unit_vectors(encode, texts)
        m = np.vstack([m, np.zeros((1, m.shape[1]))])  # the last row is null's
        return pd.Series(np.einsum("ij,ij->i", m[code[: len(x)]], m[code[len(x) :]]))

    def apply(a: Column, b: Column) -> Column:
        return run(a, b)

    return apply


def best_matches(originals: DataFrame, candidates: DataFrame, similarity: Column) -> DataFrame:
    """originals (id, slot_ord, kind, text) and candidates (id, kind, cand_ord, cand_text), either with further
    columns that `similarity` reads -> the most alike candidate of the same kind, the first on ties; rows without one keep null and 0."""
    j = originals.join(candidates, ["id", "kind"], "left").withColumn("similarity", F.when(F.col("cand_text").isNull(), F.lit(0.0)).otherwise(similarity))
    w = W.partitionBy("id", "slot_ord").orderBy(F.desc("similarity"), F.asc("cand_ord"))
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "cand_vec", "vec")


def nearest(vectors: DataFrame, key: str, vec: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, neighbour, similarity, rank): exact cosine neighbours of the stated queries among all rows, the
    query itself left out.

    Queries go out in blocks of BLOCK vectors; a task keeps k rows a query and block, so what is shuffled grows
    with tasks times queries, not with pairs. Null or zero vectors have no neighbours. Ties go to the lesser key.
    """
    spark = vectors.sparkSession
    rows = queries.filter(queries[vec].isNotNull()).select(queries[key].alias("k"), queries[vec].alias("v")).orderBy("k")
    parts = []
    batch: list = []

    def block(qs: list) -> DataFrame:
        ids = np.array([q[0] for q in qs])
        m = np.array([q[1] for q in qs], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1)
        ids, m = ids[norm > 0], (m[norm > 0].T / norm[norm > 0]).T
        shipped = spark.sparkContext.broadcast((ids, m))  # BLOCK vectors

        def run(batches):
            qid, q = shipped.value
            top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in qid]
            for b in batches:
                keep = [i for i, x in enumerate(b.column(1).to_pylist()) if x is not None]
                if not keep:
                    continue
                x = np.array(b.column(1).take(pa.array(keep)).to_pylist(), dtype=np.float64)
                xk = b.column(0).take(pa.array(keep)).to_numpy(zero_copy_only=False)
                n = np.linalg.norm(x, axis=1)
                x, xk = x[n > 0] / n[n > 0][:, None], xk[n > 0]
                sim = np.round(q @ x.T, 9)
                for i in range(len(qid)):
                    s, ks = sim[i][xk != qid[i]], xk[xk != qid[i]]
                    s, ks = np.concatenate([top[i][0], s]), np.concatenate([top[i][1], ks])
                    o = np.lexsort((ks, -s))[:k]
                    top[i] = (s[o], ks[o])
            out = [(a, b, c) for a, (s, ks) in zip(qid.tolist(), top) for c, b in zip(s.tolist(), ks.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query", "neighbour", "similarity"])

        return vectors.select(F.col(key), F.col(vec)).mapInArrow(run, "query long, neighbour long, similarity double")

    for r in rows.toLocalIterator():
        batch.append((r["k"], r["v"]))
        if len(batch) == BLOCK:
            parts.append(block(batch))
            batch = []
    if batch or not parts:
        if not batch:
            return spark.createDataFrame([], "query long, neighbour long, similarity double, rank int")
        parts.append(block(batch))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    w = W.partitionBy("query").orderBy(F.desc("similarity"), F.asc("neighbour"))
    return all_.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
