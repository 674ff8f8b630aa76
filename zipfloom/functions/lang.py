"""The five language rules; each differs from the others in its ranges, so they stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

HAN = r"一-鿿㐀-䶿"
PUNCT = r"\u3000-〿"
WIDE = r"\uff00-\uffef"
COMPAT = r"豈-\ufaff"


def _share(text: Column, ranges: str, blank: str, blanks_count: bool = True) -> Column:
    """Share of the characters other than blank that lie in the ranges; the ideographic space is both, and
    counts above the line where blanks_count."""
    rest = F.regexp_replace(text, f"[{blank}]", "")
    n = F.length(rest)
    return F.when(n > 0, F.regexp_count(text if blanks_count else rest, F.lit(f"[{ranges}]")) / n).otherwise(F.lit(0.0))


def _zh_if(test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), "zh").otherwise("en")


def detect_language(text: Column) -> Column:
    """zh if over 0.3 of the characters other than white space are CJK, full-width forms included; empty is en."""
    return _zh_if(_share(text, HAN + COMPAT + PUNCT + WIDE, WS) > 0.3)


def is_chinese(text: Column) -> Column:
    """As detect_language without the full-width forms."""
    return F.coalesce(_share(text, HAN + COMPAT + PUNCT, WS) > 0.3, F.lit(False))


def page_language(text: Column) -> Column:
    """The front end's rule: neither compatibility ideographs nor full-width forms."""
    return _zh_if(_share(text, HAN + PUNCT, WS + r"\ufeff", False) > 0.3)


def any_chinese(text: Column) -> Column:
    return _zh_if(text.rlike(r"[一-鿿]"))


def upload_language(text: Column) -> Column:
    """zh if a Chinese character is among the first 100."""
    return any_chinese(F.substring(text, 1, 100))
