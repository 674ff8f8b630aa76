"""Semantic slots of prompts. English alone runs on built-in expressions over the token array; slots of both languages
with placeholders come from one Arrow function, as Chinese ones follow their segmentation."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lang import is_chinese
from .placeholders import SLOTS, placeholder_spans
from .pos import ZH_ADJECTIVE, ZH_ONE, ZH_VERB, ZH_VERB_END, tag_lower_en, tag_word_en
from .segment_zh import Words, is_blank, is_punct, places, segment

# fixed values
EN_REGISTER = ["please", "pls", "kindly", "would", "could"]
EN_NEGATION = ["not", "no", "never", "neither", "nor", "n't", "cannot"]
EN_CONDITION = ["if", "when", "whenever", "unless", "assuming", "suppose"]
EN_QTYPE = ["how", "why", "what", "where", "who", "which", "mechanism", "process", "method", "procedure", "reason", "cause"]
EN_GENERIC = ["thing", "way", "kind", "sort", "type", "one", "ones", "stuff"]
ZH_REGISTER = {"请", "麻烦", "求", "麻烦你", "请帮忙", "拜托"}
ZH_NEGATION = {"不", "没", "没有", "未", "非", "无", "勿", "不要", "无法", "不能"}
ZH_CONDITION = {"如果", "要是", "假如", "假设", "若", "倘若", "假如说"}
ZH_QTYPE = {"如何", "怎么", "怎样", "怎么样", "为什么", "为何", "是什么", "什么是", "哪些", "什么", "影响", "机制", "过程", "原理", "原因", "方法", "步骤", "流程", "区别", "差异", "对比", "比较"}
ZH_SCOPE = {"整体", "部分", "全部", "总体", "宏观", "微观", "全球", "国内", "国际", "长期", "短期", "中期", "当前", "目前", "现在", "过去", "未来"}


def _slot(kind: Column, text: Column, start: Column, end: Column, tag: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), tag.alias("sub_tag"))


def slots_en_raw(text: Column) -> Column:
    """array<slot> before merging: the first rule that fits a token names it."""
    # one transform a step, so that each is worked out once a token: nothing is shared inside a lambda
    toks = T.words_with_offsets(text)
    low = F.transform(toks, lambda t, i: F.struct(t["token"].alias("token"), t["start"].alias("start"), t["end"].alias("end"), (i <= F.floor(t["of"] / 2)).alias("early"), i.alias("i"), F.lower(t["token"]).alias("w")))
    tagged = F.transform(low, lambda t: F.struct(t.alias("t"), tag_lower_en(t["w"]).alias("pos")))

    def kind(x: Column) -> Column:
        t, pos = x["t"], x["pos"]
        return (
            F.when(t["w"].isin(EN_REGISTER), "register")
            .when(t["w"].isin(EN_NEGATION), "negation")
            .when(t["w"].isin(EN_CONDITION), "condition")
            .when(t["w"].isin(EN_QTYPE), "qtype")
            .when((t["i"] > 0) & t["token"].rlike(r"^\p{Lu}\p{IsAlphabetic}*$"), "entity")
            .when((pos == "verb") & t["early"], "action")
            .when(pos == "adjective", "modifier")
            .when((pos == "noun") & (t["i"] > 0) & ~t["w"].isin(EN_GENERIC), "object")
        )

    kinds = F.filter(F.transform(tagged, lambda x: F.struct(x["t"].alias("t"), kind(x).alias("kind"))), lambda x: x["kind"].isNotNull())
    tag = lambda k: F.when(k == "register", "politeness").when(k == "entity", "proper-noun").when(k == "action", "verb").when(k == "modifier", "adj").when(k == "object", "noun")
    return F.transform(kinds, lambda x: _slot(x["kind"], x["t"]["token"], x["t"]["start"], x["t"]["end"], tag(x["kind"])))


def merge_en(slots: Column) -> Column:
    """A modifier and the object one character after it are one object; so are runs of objects.

    One fold from the left: a slot joins the last kept one where the pair may merge. An object that a modifier
    has joined takes further objects, as any object does.
    """
    empty = F.array().cast(SLOTS)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & last["kind"].isin("modifier", "object") & (s["kind"] == "object") & (s["char_start"] == last["char_end"] + 1)
        merged = _slot(F.lit("object"), F.concat_ws(" ", last["text"], s["text"]), last["char_start"], s["char_end"], F.lit("phrase"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(slots, empty, step)


def slots_en(text: Column) -> Column:
    return merge_en(slots_en_raw(text))


_CAPITAL = regex.compile(r"\p{Lu}\p{Alphabetic}*")
_BY_WORD = {w: kind for kind, words in reversed((("register", EN_REGISTER), ("negation", EN_NEGATION), ("condition", EN_CONDITION), ("qtype", EN_QTYPE))) for w in words}
_EN_TAGS = {"register": "politeness", "entity": "proper-noun", "action": "verb", "modifier": "adj", "object": "noun"}


@lru_cache(200_000)
def _word_en(token: str) -> tuple[str | None, bool, str, bool]:
    """(kind by the word alone, with a capital, part of speech, generic)."""
    w = token.lower()
    return _BY_WORD.get(w), bool(_CAPITAL.fullmatch(token)), tag_word_en(w), w in EN_GENERIC


def slots_en_of(text: str) -> list[tuple]:
    """slots_en of one text, for use beside other scanners in one Arrow function."""
    found = list(T._TOKEN.finditer(text))
    half, out = len(found) // 2, []
    for i, m in enumerate(found):
        kind, capital, pos, generic = _word_en(m[0])
        if kind is None:
            if i and capital:
                kind = "entity"
            elif pos == "verb" and i <= half:
                kind = "action"
            elif pos == "adjective":
                kind = "modifier"
            elif pos == "noun" and i and not generic:
                kind = "object"
            else:
                continue
        last = out[-1] if out else None
        if kind == "object" and last and last[0] in ("modifier", "object") and m.start() == last[3] + 1:
            out[-1] = ("object", f"{last[1]} {m[0]}", last[2], m.end(), "phrase")
        else:
            out.append((kind, m[0], m.start(), m.end(), _EN_TAGS.get(kind)))
    return out


def _zh_pos(word: str) -> str:
    if not word:
        return "other"
    if len(word) == 1:
        return next((k for k, v in ZH_ONE.items() if word in v), "noun")
    if word[0] in "不没未":
        return "adverb"
    if word in ZH_VERB or word.endswith(tuple(ZH_VERB_END)):
        return "verb"
    if word in ZH_ADJECTIVE:
        return "adjective"
    return "adverb" if word.endswith("地") else "noun"


def slots_zh_of(text: str, lexicon: dict[str, float], bigrams: dict[str, float]) -> list[tuple]:
    toks = [t for t in segment(text, lexicon, bigrams) if not all(is_punct(c) or is_blank(c) for c in t)]
    at = places(text, toks)
    if len(at) != len(toks):
        return []
    pos, n = [_zh_pos(t) for t in toks], len(toks)
    out: list[tuple] = []
    for i, (t, (a, b), p) in enumerate(zip(toks, at, pos)):
        following = pos[i + 1] if i + 1 < n else None
        if t in ZH_REGISTER:
            out.append(("register", t, a, b, "politeness"))
        elif t in ZH_NEGATION or (t[0] in "不没" and len(t) <= 3):
            out.append(("negation", t, a, b, None))
        elif t in ZH_CONDITION:
            out.append(("condition", t, a, b, None))
        elif t in ZH_QTYPE or t.endswith(("机制", "过程", "原理")):
            out.append(("qtype", t, a, b, None))
        elif p == "verb" and (i <= n // 3 or following == "noun"):
            out.append(("action", t, a, b, "verb"))
        elif p == "noun" and i and toks[i - 1] in ZH_SCOPE:
            begin = at[i - 1][0]
            out = [s for s in out if s[2] != begin]
            out.append(("scope", toks[i - 1] + t, begin, b, "scope-noun"))
        elif p == "noun":
            out.append(("object", t, a, b, "noun"))
        elif t in ZH_SCOPE and following != "noun":
            out.append(("scope", t, a, b, None))
        elif p == "adjective":
            out.append(("modifier", t, a, b, "adj"))
    merged: list[tuple] = []
    for s in out:
        last = merged[-1] if merged else None
        if last and last[0] == s[0] == "object" and last[3] == s[2]:
            merged[-1] = ("object", last[1] + s[1], last[2], s[3], "phrase")
        else:
            merged.append(s)
    return merged


class ZhSlots:
    """A column function text -> array<slot> over one language's dictionaries; a large one comes as Words."""

    def __init__(self, lexicon: dict[str, float] | Words, bigrams: dict[str, float]):
        self.lexicon, self.bigrams = lexicon, bigrams

    def of(self, text: str) -> list[tuple]:
        return slots_zh_of(text, self.lexicon.map() if isinstance(self.lexicon, Words) else self.lexicon, self.bigrams)

    def __call__(self, text: Column) -> Column:
        of = self.of

        @F.arrow_udf(SLOTS)
        def run(texts: pa.Array) -> pa.Array:
            return slot_array([None if t is None else of(t) for t in texts.to_pylist()])

        return run(text)


slots_zh = ZhSlots


class Scanner:
    """Placeholders and slots by place; on one place placeholders come first. zh: slots_zh() of a dictionary; without it
    Chinese has placeholders only. Anything but zh is read as English."""

    def __init__(self, zh: ZhSlots | None = None):
        self.zh = zh

    def of(self, text: str, lang: str | None) -> list[tuple]:
        own = (self.zh.of(text) if self.zh else []) if lang == "zh" else slots_en_of(text)
        return sorted(placeholder_spans(text) + own, key=lambda s: s[2])

    def __call__(self, text: Column, lang: Column | None = None) -> Column:
        """array<slot> of a text, null for null. lang null or 'auto' is detected."""
        of = self.of

        @F.arrow_udf(SLOTS)
        def run(texts: pa.Array, langs: pa.Array) -> pa.Array:
            known: dict[tuple, list[tuple]] = {}
            rows: list[list[tuple] | None] = []
            for key in zip(texts.to_pylist(), langs.to_pylist()):
                if key[0] is not None and key not in known:
                    known[key] = of(*key)
                rows.append(None if key[0] is None else known[key])
            return slot_array(rows)

        return run(text, language_of(text, lang))


def language_of(text: Column, lang: Column | None = None) -> Column:
    auto = F.when(is_chinese(text), "zh").otherwise("en")
    return auto if lang is None else F.when(lang.isNull() | (lang == "auto"), auto).otherwise(lang)


def slot_array(rows: list[list[tuple] | None]) -> pa.Array:
    """Rows of slots as one Arrow array, built by column."""
    flat = [s for r in rows if r for s in r]
    column = lambda i, t: pa.array([s[i] for s in flat], t)
    struct = pa.StructArray.from_arrays([column(0, pa.string()), column(1, pa.string()), column(2, pa.int32()), column(3, pa.int32()), column(4, pa.string())], ["kind", "text", "char_start", "char_end", "sub_tag"])
    ends, at = [0], 0
    for r in rows:
        at += len(r or [])
        ends.append(at)
    # a null offset makes its row null
    offsets = pa.array([None if i < len(rows) and rows[i] is None else e for i, e in enumerate(ends)], pa.int32())
    return pa.ListArray.from_arrays(offsets, struct)


def all_slots(text: Column, lang: Column | None = None, zh: ZhSlots | None = None) -> Column:
    return Scanner(zh)(text, lang)


def slot_rows(df: DataFrame, key: str, slots: Column) -> DataFrame:
    # Arrow functions run in a projection, not inside the generator
    return df.select(key, slots.alias("_slots")).select(key, F.posexplode("_slots").alias("slot_ord", "s")).select(key, "slot_ord", "s.*")
