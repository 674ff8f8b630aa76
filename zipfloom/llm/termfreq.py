"""Frequency of every distinct term over the whole collection, by heavy-light aggregation.

One shuffle on (table, term) serves both the choice of the latest delivery and the folding of spellings. The
terms an exact-on-top sketch finds heavy are broadcast (at most HEAVY of them) and counted in local arrays,
one row a heavy term leaving each task; only the remaining terms are shuffled; the two tables are united.
Which terms are taken for heavy changes the traffic, never a count.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAVY = 1024  # terms counted in local arrays, at most
RARE = 5
COMMON = 0.40


def term_of(word: str) -> str:
    return unicodedata.normalize("NFKC", word).lower().strip()


def with_term(rows: DataFrame, word: str = "word") -> DataFrame:
    """Adds term; each distinct word of a batch is folded once. Null words have a null term."""
    schema = T.StructType([*rows.schema.fields, T.StructField("term", T.StringType())])

    def run(batches):
        for b in batches:
            d = b.column(word).dictionary_encode()
            d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
            folded = pa.array([None if w is None else term_of(w) for w in d.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, folded.take(d.indices)], names=[*b.schema.names, "term"])

    return rows.mapInArrow(run, schema)


def table_terms(domain_freq: DataFrame) -> DataFrame:
    """(lang, term, table_id, word_count): of each (table_id, word) the row of the latest loaded_at, of rows
    loaded at once the greatest count; then the spellings of a term in one table added up. Rows with a null
    table, word or language, blank words and counts that are null or not positive hold no occurrences."""
    cols = ["table_id", "lang", "word", "word_count", "loaded_at"]
    rows = domain_freq.select(*[domain_freq[c].alias(c) for c in cols]).filter("table_id is not null and word is not null and lang is not null")
    rows = with_term(rows).filter("term <> ''")
    # co-located by (table, term): a word has one term, so both groupings below stay inside a partition
    rows = rows.repartition("table_id", "lang", "term")
    last = rows.groupBy("table_id", "lang", "term", "word").agg(F.max(F.struct(F.col("loaded_at"), F.coalesce("word_count", F.lit(-1)).alias("n"))).alias("r"))
    return last.select("table_id", "lang", "term", F.col("r.n").alias("n")).filter("n > 0").groupBy("table_id", "lang", "term").agg(F.sum("n").alias("word_count"))


def heavy_terms(terms: DataFrame, limit: int = HEAVY) -> list[tuple[str, str]]:
    """Terms that fill most rows, found by mergeable sketches: at most `limit`."""
    got = terms.agg(F.expr(f"approx_top_k(concat(lang, chr(0), term), {limit}, {limit * 8})").alias("t")).first()["t"]
    return sorted(tuple(r["item"].split("\x00", 1)) for r in got or [] if r["count"] > 1)


def counts(terms: DataFrame, heavy: list[tuple[str, str]]) -> DataFrame:
    """(lang, term, occurrences, n_tables)."""
    spark = terms.sparkSession
    place = spark.sparkContext.broadcast(list(heavy))  # bounded by HEAVY
    size = len(heavy)

    def local(batches):
        names = place.value
        at = pa.array([f"{lang}\x00{term}" for lang, term in names], pa.string())
        occ, tab = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for b in batches:
            key = pc.binary_join_element_wise(b.column("lang").cast(pa.string()), b.column("term").cast(pa.string()), "\x00")
            idx = pc.fill_null(pc.index_in(key, value_set=at), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            n = b.column("word_count").to_numpy(zero_copy_only=False)
            hit = idx >= 0
            np.add.at(occ, idx[hit], n[hit])
            tab += np.bincount(idx[hit], minlength=size)
            rest = np.nonzero(~hit)[0]
            if len(rest):
                keep = b.take(pa.array(rest))
                yield pa.RecordBatch.from_arrays([keep.column("lang"), keep.column("term"), keep.column("word_count"), pa.array(np.ones(len(rest), dtype=np.int64)), pa.array([False] * len(rest))], names=_NAMES)
        used = np.nonzero(tab)[0]
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([names[i][0] for i in used]), pa.array([names[i][1] for i in used]), pa.array(occ[used]), pa.array(tab[used]), pa.array([True] * len(used))], names=_NAMES)

    parts = terms.select("lang", "term", "word_count").mapInArrow(local, "lang string, term string, n long, tables long, heavy boolean")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("occurrences"), F.sum("tables").alias("n_tables"))


_NAMES = ["lang", "term", "n", "tables", "heavy"]


def term_table(domain_freq: DataFrame, domain_meta: DataFrame, write) -> DataFrame:
    """(lang, term, occurrences, n_tables, zipf, rare, common). zipf = log10(share * 1e9) within 0 and 10, of
    the occurrences of the language. write(df, name) stores a table that is read twice."""
    terms = write(table_terms(domain_freq), "terms")
    t = write(counts(terms, heavy_terms(terms)), "counts")
    total = t.groupBy("lang").agg(F.sum("occurrences").alias("total"))
    tables = domain_meta.filter("lang is not null and table_id is not null").groupBy("lang").agg(F.count_distinct("table_id").alias("lang_tables"))
    t = t.join(total, "lang").join(tables, "lang", "left")
    zipf = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.log10(F.col("occurrences") / F.col("total") * 1e9)))
    return t.select("lang", "term", "occurrences", "n_tables", zipf.alias("zipf"), (F.col("occurrences") < RARE).alias("rare"), F.coalesce(F.col("n_tables") * 100 >= F.col("lang_tables") * int(COMMON * 100), F.lit(False)).alias("common"))


def marks(t: DataFrame) -> DataFrame:
    """(lang, term, mark), a row for each mark that holds."""
    m = F.filter(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common")), lambda x: x.isNotNull())
    return t.select("lang", "term", F.explode(m).alias("mark"))
