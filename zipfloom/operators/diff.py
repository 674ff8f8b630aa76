"""Longest-common-subsequence diff of two texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<op:string,text:string>>"
MOST_CELLS = 100_000  # beyond it the whole texts are one removal and one addition
_PIECES = regex.compile(r"\s+|[.,!?;:\"“”‘’'()\[\]{}]|[^\s.,!?;:\"“”‘’'()\[\]{}]+")
_HAN = regex.compile(r"[一-鿿]")


def diff_ops(a: str, b: str, lang: str = "auto") -> list[tuple[str, str]]:
    chars = lang == "zh" or (lang == "auto" and bool(_HAN.search(a + b)))
    x, y = (list(a), list(b)) if chars else (_PIECES.findall(a), _PIECES.findall(b))
    if x and y and len(x) * len(y) > MOST_CELLS:
        return [("remove", a), ("add", b)]
    # lengths of common subsequences of prefixes, one row at a time
    code = {t: i for i, t in enumerate(dict.fromkeys(x + y))}
    yc = np.array([code[t] for t in y], dtype=np.int64)
    rows = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    for i, t in enumerate(x, 1):
        met = np.where(yc == code[t], rows[i - 1, :-1] + 1, rows[i - 1, 1:])
        rows[i, 1:] = np.maximum.accumulate(met) if len(y) else met
    out, i, j = [], len(x), len(y)
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            out.append(("equal", x[i - 1]))
            i, j = i - 1, j - 1
        elif i and (not j or rows[i - 1, j] >= rows[i, j - 1]):
            out.append(("remove", x[i - 1]))
            i -= 1
        else:
            out.append(("add", y[j - 1]))
            j -= 1
    return out[::-1]


def diff(a: Column, b: Column) -> Column:
    """array<struct<op, text>>; null texts count as empty."""

    @F.pandas_udf(OPS)
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([diff_ops(p or "", q or "") for p, q in zip(x, y)])

    return run(a, b)


def op_counts(ops: Column) -> Column:
    n = lambda k: F.size(F.filter(ops, lambda o: o["op"] == k))
    return F.struct(n("add").alias("n_add"), n("remove").alias("n_remove"), n("equal").alias("n_equal"))
