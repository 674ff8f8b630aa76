"""Sentences of a text, and what of a sentence speaks for its language."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

_END = regex.compile(r"[.!?…]+[\"'”“’»)\]*_`]*(?=\s|$)|[。！？｡]+[」』”’）)]*|[\r\n\u2028\u2029]+|\s/\s|(?<=[.!?])(?=\p{Han}|\p{Hiragana}|\p{Katakana})")
_QUOTED = regex.compile(r"```.*?(?:```|$)|`[^`\n]*`|\"[^\"\n]*\"|„[^“”\n]*[“”]|“[^”\n]*”|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|《[^》\n]*》", regex.S)
_MARKS = regex.compile(r"\{+[^{}\n]*\}+|\[[^\[\]\n]*\]|<[^<>\n]*>|\$[A-Za-z_]+|https?://[!-~]+|[!-~]+@[!-~]+\.[!-~]+|[A-Za-z0-9]+[_./\\][A-Za-z0-9_./\\]+|[A-Za-z0-9]*[0-9][A-Za-z0-9]*")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}'’ー]+")
_ZERO_WIDTH = regex.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]")
KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
HIRAGANA_END = regex.compile(r"\p{Hiragana}\P{L}*$")
# letters of the other scripts; what is of none of them is one class more
OTHERS = {name: regex.compile(rf"[\p{{{name}}}\p{{M}}]+") for name in ("Cyrillic", "Greek", "Hangul", "Arabic", "Hebrew", "Thai", "Devanagari")}
_REST = regex.compile(r"[[\p{L}\p{M}]--[\p{Latin}\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)
LATIN_WORD = regex.compile(r"[\p{Latin}\p{M}'’]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the non-blank sentences; together they cover every non-blank character."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.end()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def wording(sentence: str) -> str:
    """A sentence without quoted terms, placeholders, code, addresses and numbers, in lower case."""
    s = _ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", sentence))
    s = _MARKS.sub(" ", _QUOTED.sub(" ", s))
    return _NOT_LETTERS.sub(" ", s).strip().lower()


def frame(words: str) -> tuple[str, str]:
    """('cjk' | 'latin' | another script's name | '', the part in that script): the script of the clause itself.

    A foreign term may be longer than the clause that names it, so where the Latin letters outweigh the
    others, the script the clause begins in decides.
    """
    cjk = CJK.findall(words)
    latin = LATIN_WORD.findall(words)
    n = sum(map(len, latin))
    rest = _REST.findall(words)
    if sum(map(len, rest)) > len(cjk) + n:
        for name, r in OTHERS.items():
            part = r.findall(words)
            if 2 * sum(map(len, part)) >= sum(map(len, rest)):
                return name.lower(), " ".join(part)
        return "other", " ".join(rest)
    if not cjk and not n:
        return "", ""
    first = 0
    if cjk and n:
        first = 0 if 2 * len(cjk) >= n or CJK.match(words) else 1
    elif n:
        first = 1
    if first:
        return "latin", " ".join(latin)
    return "cjk", "".join(cjk)


@lru_cache(50_000)
def clause(sentence: str) -> tuple[str, str]:
    """frame() of a sentence's wording; sentences come up again in many texts."""
    return frame(wording(sentence))


def is_sentence(script: str, part: str) -> bool:
    """Long enough to be a sentence, not an interjection or a name."""
    return len(part) >= 5 if script == "cjk" else len(part.split()) >= 3 and len(part) >= 10
