"""Tokenisers and string functions as column expressions.

A null text gives a null array; an empty or blank text an empty one. Offsets and lengths count code points.
"""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the characters of Unicode White_Space, as regular expression ranges
WS = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_RE2 = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CJK_ZH = r"一-鿿"
QUOTES = "“”‘’"
ZH_SPLIT = rf"[\s{WS}。！？，、；：{QUOTES}（）\[\]【】《》]+"
EN_SPLIT = rf"[\s{WS}.,;:!?'\"()\[\]{{}}<>]+"
CHANGE_SPLIT = rf"[\s{WS},，。！？、；：{QUOTES}\"'（）\[\]【】]+"
EN_PIECES = r"\s+|[.,!?;:\"'()\[\]{}“”‘’]|[^\s.,!?;:\"'()\[\]{}“”‘’]+"


def words_en(text: Column) -> Column:
    """Split on white space and ASCII punctuation; tokens without a letter are dropped, case is kept."""
    return F.filter(F.split(text, rf"[{WS}\p{{Punct}}]"), lambda x: x.rlike(r"\p{IsAlphabetic}"))


OFFSETS = "array<struct<token:string,start:int,end:int,of:int>>"
_TOKEN = re.compile("[^" + WS + re.escape(string.punctuation) + "]+")


def words_with_offsets(text: Column) -> Column:
    """array<struct<token, start, end, of>> split as words_en, keeping tokens without letters; `of` is the number
    of tokens. An Arrow function, as running offsets in a fold would copy the array at each token."""

    def tokens(t: str) -> list[tuple[str, int, int, int]]:
        found = list(_TOKEN.finditer(t))
        return [(m[0], m.start(), m.end(), len(found)) for m in found]

    @F.pandas_udf(OFFSETS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokens(t))

    return run(text)


def clauses_zh(text: Column) -> Column:
    """Corpus tokens of Chinese: clauses that hold a Chinese character, letter or digit."""
    return F.filter(F.split(text, ZH_SPLIT), lambda x: x.rlike(rf"[{CJK_ZH}A-Za-z0-9]"))


def corpus_words_en(text: Column) -> Column:
    """Corpus tokens of other languages, lower case; hyphens do not split, numbers stay."""
    return F.transform(F.filter(F.split(text, EN_SPLIT), lambda x: x.rlike("[A-Za-z0-9]")), F.lower)


def pieces_en(text: Column) -> Column:
    """Diff tokens: words, runs of white space and single marks, nothing lost."""
    return F.regexp_extract_all(text, F.lit(EN_PIECES), F.lit(0))


def pieces_zh(text: Column) -> Column:
    """Diff tokens of Chinese: code points."""
    return F.filter(F.split(text, ""), lambda x: x != "")


def change_words(text: Column) -> Column:
    return F.filter(F.split(text, CHANGE_SPLIT), lambda x: x != "")


def token_rows(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, pos, token, prev), the neighbour taken inside the row, so nothing is shuffled."""
    k = F.transform(tokens, lambda x, i: x)
    pair = df.select(*keys, k.alias("_k")).select(*keys, "_k", F.posexplode("_k").alias("pos", "token"))
    return pair.select(*keys, "pos", "token", F.when(F.col("pos") > 0, F.get("_k", F.col("pos") - 1)).alias("prev"))


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_html(text: Column) -> Column:
    """For text between tags: what a page writes for it, quotation marks as they are."""
    return _replaced(text, (("&", "&amp;"), ("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")))


def escape_attribute(text: Column) -> Column:
    """For a value between double quotation marks."""
    return _replaced(text, (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")))
