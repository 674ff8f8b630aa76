"""Which rewrites keep their prompt's meaning: slots of both sides, matched and judged.

Slots that must stay as they are look for their text in the candidate; the others take the most alike slot of
their kind. A worker encodes each word it meets again once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import embed, verify
from .slots import Scanner, language_of


FAILED = "error"


def match_slots(pairs: DataFrame, original: str = "original", candidate: str = "candidate", encode=None, slots: Scanner | None = None) -> DataFrame:
    """pairs (id, original, candidate), id unique -> (id, slot_ord, kind, text, matched, similarity) for every slot
    of the original. Without a slot of its kind a slot has matched '' and 0, of equally alike ones the earlier counts.
    Null candidates are empty; null originals have no slots. Where the encoder fails the pair has one row of kind FAILED,
    with the error as text, which never passes. A pair is one row, so nothing is joined or shuffled."""
    scan, encode = (slots or Scanner()).of, encode or embed.heuristic_vector
    key = pairs.schema["id"].dataType

    def run(batches):
        for b in batches:
            rows = []
            for i, o, c, lo, lc in zip(*(b.column(k).to_pylist() for k in range(5))):
                first = len(rows)
                by: dict[str, list[str]] = {}
                for s in scan(c, lc):
                    by.setdefault(s[0], []).append(s[1])
                vectors: dict = {}
                try:
                    for n, (kind, t, *_) in enumerate(scan(o, lo)):
                        if kind in S.EXACT_KINDS:
                            rows.append((i, n, kind, t, t if t in c else "", 1.0 if t in c else 0.0))
                        elif kind not in by:
                            rows.append((i, n, kind, t, "", 0.0))
                        else:
                            if kind not in vectors:
                                vectors[kind] = embed.unit_vectors(encode, by[kind])
                            alike = vectors[kind] @ embed.unit_vectors(encode, [t])[0]
                            k = int(alike.argmax())
                            rows.append((i, n, kind, t, by[kind][k], float(alike[k])))
                except Exception as e:  # whatever an injected encoder raises
                    rows[first:] = [(i, -1, FAILED, str(e), "", 0.0)]
            types = (b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "slot_ord", "kind", "text", "matched", "similarity"])

    o, c = F.col(original), F.coalesce(candidate, F.lit(""))
    p = pairs.filter(o.isNotNull()).select("id", o.alias("_o"), c.alias("_c"), language_of(o).alias("_lo"), language_of(c).alias("_lc"))
    return p.mapInArrow(run, f"id {key.simpleString()}, slot_ord int, kind string, text string, matched string, similarity double")


def judge(pairs: DataFrame, original: str = "original", candidate: str = "candidate", threshold: Column | None = None, encode=None, slots: Scanner | None = None) -> DataFrame:
    """(id, preservation, passes, total, kept, dropped, slot_share, bad) of every pair; a prompt without slots
    passes with 1.0."""
    m = match_slots(pairs, original, candidate, encode, slots)
    v = m.withColumn("passes", F.coalesce(verify.passes(F.col("kind"), F.col("similarity"), threshold), F.lit(False)) & (F.col("kind") != FAILED))
    return verify.preservation(v, pairs)
