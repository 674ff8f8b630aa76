"""Chinese word segmentation by greatest score, and the places of its words.

Words are up to eight CJK characters; other runs are one token. A word adds the log of its frequency score, by
a factor of its length, and that of the pair it forms; of equal sums the earlier start wins. The pair's left word is the second word of the path, as the
scores this engine has to equal were made with it; `compat=False` takes the word before.
"""

from __future__ import annotations

import math
import unicodedata
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH_FACTOR = (0.3, 1.0, 1.1, 1.05)  # fixed values, by length, the last for four and more
PAIR_FACTOR, OTHER_SCORE, MISS, MOST = 0.4, 0.1, 3.5, 8
CJK = "\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff"
ASCII_PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def is_cjk(c: str) -> bool:
    o = ord(c)
    return 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0xF900 <= o <= 0xFAFF


def is_punct(c: str) -> bool:
    o = ord(c)
    return c in ASCII_PUNCT or 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFFEF


def is_blank(c: str) -> bool:
    return c.isspace() and unicodedata.category(c) != "Cc" or c in "\t\n\x0b\x0c\r\x85"


def segment(text: str, words: dict[str, float], pairs: dict[str, float], compat: bool = True) -> list[str]:
    n = len(text)
    best: list[float] = [-math.inf] * (n + 1)
    back = [0] * (n + 1)
    # per end: the word that counts as left neighbour of what follows
    left: list[str | None] = [None] * (n + 1)
    best[0] = 0.0
    log = lambda x: math.log(max(x, 0.1))

    def reach(i: int, j: int, score: float, word: str) -> None:
        if score > best[j]:
            best[j], back[j] = score, i
            own = None if all(is_blank(c) or c in ASCII_PUNCT for c in word) else word
            left[j] = left[i] or (own if i else None) if compat else own or left[i]

    for i in range(n):
        if best[i] == -math.inf:
            continue
        c = text[i]
        if is_blank(c) or c in ASCII_PUNCT:
            reach(i, i + 1, best[i] + OTHER_SCORE, c)
        elif not is_cjk(c):
            j = i + 1
            while j < n and not is_cjk(text[j]) and not is_blank(text[j]) and text[j] not in ASCII_PUNCT:
                j += 1
            reach(i, j, best[i] + OTHER_SCORE, text[i:j])
        else:
            for j in range(i + 1, min(n, i + MOST) + 1):
                if not is_cjk(text[j - 1]):
                    break
                w = text[i:j]
                score = best[i] + log(words.get(w, MISS)) * LENGTH_FACTOR[min(j - i, 4) - 1]
                if left[i] is not None:
                    score += PAIR_FACTOR * log(pairs.get(f"{left[i]} {w}", MISS))
                reach(i, j, score, w)
    out, j = [], n
    while j:
        w = text[back[j] : j]
        if not all(is_blank(c) or c in ASCII_PUNCT for c in w):
            out.append(w)
        j = back[j]
    return out[::-1]


def places(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the tokens in order; characters between them are passed over, blanks and marks before
    any comparison, so a token that starts with a mark is never met and ends the list."""
    out, at = [], 0
    for t in tokens:
        while at < len(text) and (is_blank(text[at]) or is_punct(text[at]) or not text.startswith(t, at)):
            at += 1
        if at >= len(text):
            break
        out.append((at, at + len(t)))
        at += len(t)
    return out


class Words:
    """A dictionary shipped once to each executor, as one text and an array of scores; a worker process makes it a
    map once, at its first look-up."""

    _made: dict[str, dict[str, float]] = {}

    def __init__(self, shipped):
        self.shipped, self.key = shipped, uuid4().hex

    def map(self) -> dict[str, float]:
        if self.key not in Words._made:
            Words._made.clear()
            text, scores = self.shipped.value
            Words._made[self.key] = dict(zip(text.split("\n"), scores.tolist())) if text else {}
        return Words._made[self.key]


def shipped_words(lexicon: DataFrame) -> Words:
    """The whole of lexicon (word, zipf), but words that segment() never looks up: those of over eight characters or
    with a character that is no CJK."""
    usable = lexicon.filter(F.col("word").rlike(rf"\A[{CJK}]{{1,{MOST}}}\z")).select("word", "zipf").toArrow()
    text = "\n".join(usable["word"].to_pylist())
    return Words(lexicon.sparkSession.sparkContext.broadcast((text, usable["zipf"].to_numpy())))


def segmenter(lexicon: dict[str, float] | Words, bigrams: dict[str, float], compat: bool = True):
    """A column function text -> array<string>. Dictionaries are those of one language; a large one comes as Words."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        words = lexicon.map() if isinstance(lexicon, Words) else lexicon
        return s.map(lambda t: None if t is None else segment(t, words, bigrams, compat))

    def apply(text: Column) -> Column:
        return run(text)

    return apply
