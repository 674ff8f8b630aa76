"""Spans a rewrite must keep as they are: placeholders, quotations, addresses, dates and numbers.

One ordered alternation of patterns does the scan, since at each position the first rule that fits takes the
span; only balanced brackets, which no regular expression counts, are measured by hand.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = "struct<kind:string,text:string,char_start:int,char_end:int,sub_tag:string>"
SLOTS = f"array<{SLOT}>"

_OPENERS = {"{": ("}", "braces"), "[": ("]", "square"), "<": (">", "angle")}
_SCAN = regex.compile(
    r"""(?P<open>[{\[<])
    |(?P<shell>\$[A-Za-z_][A-Za-z0-9_]*)
    |(?P<quoted>"[^"\n]*"|'[^'\n]*'|‘[^‘\n]*‘|’[^’\n]*’)
    |(?P<url>http[^\s)\]><"]*)
    |(?P<email>(?=[A-Za-z])(?=[\p{L}\p{N}.@_+\-]*@)(?=[\p{L}\p{N}@_+\-]*\.)[\p{L}\p{N}@._+\-]+)
    |(?P<iso>[0-9]{4}-[0-9]{2}-[0-9]{2})
    |(?P<cn>[0-9]+年[0-9]*月(?:[0-9]+日?)?)
    |(?P<number>[0-9])""",
    regex.X,
)
_TAGS = {"shell": ("placeholder", "shell"), "quoted": ("placeholder", "quoted"), "url": ("entity", "url"), "email": ("entity", "email"), "iso": ("entity", "iso-date"), "cn": ("entity", "cn-date"), "number": ("entity", "number")}


def _closer(text: str, at: int, close: str) -> int | None:
    """Index of the closer that balances the opener at `at` on the same line."""
    depth, opener = 0, text[at]
    for i in range(at, len(text)):
        c = text[i]
        if c == "\n":
            return None
        depth += (c == opener) - (c == close)
        if depth == 0:
            return i
    return None


def _tag_like(span: str) -> bool:
    digits = any(c in "0123456789" for c in span)
    letters = any(c.isascii() and c.isalpha() for c in span)
    return "=" not in span and " " not in span and len(span.encode()) >= 3 and (letters or not digits)


def _number_end(text: str, at: int) -> int:
    """A number takes one point; a second ends it, unless it is the unit of nothing."""
    seen, i, n = False, at, len(text)
    digit = lambda k: k < n and text[k] in "0123456789"
    while i < n:
        c = text[i]
        if c in "0123456789" or (c == "," and digit(i + 1)) or (c == "e" and (digit(i + 1) or text[i + 1 : i + 2] == "-")):
            i += 1
        elif c == "." and not seen and digit(i + 1):
            seen = True
            i += 1
        else:
            return i + (c in "%$€¥£元块千万亿kKmM")
    return i


def placeholder_spans(text: str) -> list[tuple[str, str, int, int, str]]:
    out, at = [], 0
    while m := _SCAN.search(text, at):
        kind, start = m.lastgroup, m.start()
        if m["open"]:
            close, tag = _OPENERS[m["open"]]
            end = _closer(text, start, close)
            if end is None or (tag == "angle" and not _tag_like(text[start : end + 1])):
                at = start + 1
                continue
            out.append(("placeholder", text[start : end + 1], start, end + 1, tag))
            at = end + 1
            continue
        kind = next(k for k in _TAGS if m[k])
        end = _number_end(text, start) if kind == "number" else m.end()
        slot, tag = _TAGS[kind]
        out.append((slot, text[start:end], start, end, tag))
        at = end
    return out


def placeholders(text: Column) -> Column:
    """array<slot> of a text, null for null."""
    @F.pandas_udf(SLOTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else placeholder_spans(t))

    return run(text)
