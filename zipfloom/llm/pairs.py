"""Broken prompt and rewrite pairs: empty, refusal, copy, other_language, truncated; the first that holds counts.

Per entry (one Arrow pass): lead-ins and wrapping are taken off, refusal grammars read the sentences outside
quotations, greedy string tiling aligns rewrite and prompt, language models compare their sentences, and a
pushdown parser follows fences, brackets, quotations, lists and markup to the end. A last sentence without
its stop that the prompt does not settle is held against how sentences of the same opening end in all
rewrites (a join with corpus counts, no entry is decided alone by a sample).

Nulls and blanks: entries with null or blank `original` are left out; a null or blank `optimized` is
`empty`. Repeated deliveries of an id are one entry, the latest saved.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import refusal
from . import segment as S
from .langid import Model, judged, main_language, whole_languages

# ---- fixed values: words and grammars by language -------------------------------------------------

NO_VALUE = set(
    "n a|na|none|null|nil|nan|undefined|empty|blank|no value|no output|no answer|no response|no result|nothing|not available|not applicable|unknown|void|missing|tbd|todo|"
    "leer|keine|keiner|keine angabe|nichts|kein wert|entfällt|ohne|aucun|aucune|vide|néant|rien|sans objet|ninguno|ninguna|vacío|nada|sin valor|sin respuesta|"
    "无|空|空白|无内容|没有|暂无|不适用|未知|なし|無し|無|該当なし|空欄|未定|特になし".split("|")
)
# A lead-in announces the rewrite; it ends in a colon, a line break or a dash, or stands alone.
_ANNOUNCE = "(?:" + r"""here(?:'s| is| are)? (?:you go|it is|the|your|a|an|my)|(?:sure|certainly|of course|okay|ok|absolutely|gladly|no problem)\b|(?:the )?(?:optimi[sz]ed|rewritten|improved|revised|reworded|rephrased|new|better|final|updated)\b|(?:rewrite|revision|result|answer|output|response|version|optimi[sz]ation)\b
|gerne\b|natürlich\b|klar\b|sicher\b|hier (?:ist|sind|kommt|die|der|das|eine?)|umformuliert|überarbeitet|optimiert|verbessert|neue fassung|neufassung|ergebnis|antwort|ausgabe
|voici\b|bien sûr|volontiers|d'accord|reformul|version|optimis|amélior|résultat|réponse|texte (?:réécrit|amélioré)|réécriture
|aquí (?:está|tiene|va|tienes)|claro\b|por supuesto|con gusto|reformulad|mejorad|optimizad|reescrit|versión|resultado|respuesta
|好的|当然|没问题|可以|以下是|这是|改写|优化|润色|修改后|改进|重写|结果|新版本
|はい|もちろん|承知|こちら|以下|書き換え|改善|最適化|修正|書き直し|結果|回答""".replace("\n", "") + ")"
_LEAD = regex.compile(rf"^\W{{0,4}}{_ANNOUNCE}[^\n:：。]{{0,60}}(?:[:：]|\n|\s[-–—]\s)", regex.I)
_LEAD_ALONE = regex.compile(r"^\W{0,4}(?:here (?:is|are)|here's|sure|certainly|hier ist|gerne|voici|aquí está|好的|以下是|はい)\b[^\n.。!?]{0,60}\W*$", regex.I)
_HERE_YOU_GO = regex.compile(r"^\W{0,4}(?:here you (?:go|are)|sure thing|bitte sehr|voilà|aquí tienes|どうぞ|请看|如下)\W{0,4}", regex.I)

# Words that make a sentence an order to write such a thing, not the thing itself.
_ORDERS = regex.compile(
    r"\b(?:write|compose|draft|formulate|find|make|tell|say that|explain|give|put|set|show|cut|sum)\b[^.]{0,30}\b(?:letter|note|email|mail|reply|response|excuse|words|apology|message|that says|than)\b|\b(?:schreib\w*(?! ich\b)|entwirf|formulier\w*|such\w*|verfass\w*)\b|\b(?:écris|écrivez|rédige\w*|ébauche\w*|formule\w*|cherche\w*|trouve\w*)\b|\b(?:escrib[ea]|redact[ea]|elabor[ea]|formul[ea]|busc[ao]|busque)\b|写一|撰写|起草|拟一|写张|找.{0,8}说法|書いてください|作成して|起草して|考案して|探してください|言い方",
    regex.I,
)

_DANGLING = set(
    # articles, prepositions, conjunctions and the like, after which no sentence of the language stops
    "the a an of for to with and or but that which who whose because although as if than from by into onto upon about concerning regarding between their its your my our his her whether when while since until so not very "
    "der die das den dem des ein eine einen einem einer eines und oder aber dass weil obwohl wenn als für mit von vom zum zur im am beim durch gegen ohne über unter zwischen seit während sowie nicht damit sodass ob wie "
    "le la les un une des du de d l et ou mais que qui dont car parce pour avec sans dans sur sous entre par au aux à en chez vers si ne quand comme afin ce cette ces son sa ses leur leurs "
    "el los las unos unas del al y o u pero con sin por para según sobre entre hasta desde cuando como si lo se su sus que cuyo cuya porque aunque mientras".split()
)
_DANGLING |= {w.replace("ü", "ue") for w in _DANGLING}  # tokens spell umlauts out
_DANGLING_CJK = ("的", "和", "与", "及", "在", "把", "被", "对", "向", "给", "为", "从", "但", "而", "或", "以", "将", "是", "不", "最", "让", "はの", "の", "を", "が", "に", "は", "へ", "と", "で", "や", "も", "から", "より", "および", "または", "な", "し", "て")
_OPEN_END = tuple(",;:，、；：-–—([{（【「『《“„«‘<…/&+=·") + ("...", "..")
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "』": "『", "》": "《", "”": "“", "»": "«"}
KEPT = 0.5  # share of a prompt's tokens from which a rewrite is one, whatever it says beside
_FINAL = regex.compile(r"[.!?。！？｡][\"'”“’»」』)）\]】*_`]*$")

# ---- normal forms ---------------------------------------------------------------------------------

_ALNUM = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_TOKENS = regex.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}|[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)


def squeeze(text: str) -> str:
    """Letters and digits only, in one case: what is left apart from case, spacing, punctuation and wrapping."""
    return _ALNUM.sub("", unicodedata.normalize("NFKC", text)).casefold()


def tokens(text: str) -> list[str]:
    t = unicodedata.normalize("NFKC", text).casefold()
    return [x.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss") for x in _TOKENS.findall(t)]


def without_lead(text: str) -> str:
    """The text without a lead-in, blanks and outer wrapping."""
    t = text.strip()
    for _ in range(3):
        m = _HERE_YOU_GO.match(t) or _LEAD.match(t)
        if not m or not m.end():
            break
        t = t[m.end() :].strip()
    return t


def says_nothing(text: str | None) -> bool:
    if text is None:
        return True
    rest = without_lead(text)
    if not rest or _LEAD_ALONE.match(rest):
        return True
    plain = " ".join(_TOKENS.findall(rest.casefold())) if not S.CJK.search(rest) else squeeze(rest)
    return not plain or plain in NO_VALUE


# ---- parts ----------------------------------------------------------------------------------------


def refuses(text: str, original: str = "") -> bool:
    """A sentence outside quotations, and not the prompt's own, declines the task and does not order a text that declines
    something; and the text does not otherwise keep the prompt, as a rewrite does."""
    t = unicodedata.normalize("NFKC", text).replace("\u2019", "'")
    if not refusal.has_sign(t):
        return False
    t = S._QUOTED.sub(" ", t)
    own = kept = None
    for a, b in S.sentences(t):
        s = t[a:b].strip()
        if refusal.has_sign(s) and not _ORDERS.search(s) and not regex.search(r"\{\w|\[[A-Z]|\$[A-Z]", s) and refusal.declines(s):
            own = squeeze(original) if own is None else own
            if squeeze(s) in own:
                continue
            if kept is None:
                kept = _kept(original, text)
            if kept < KEPT:
                return True
    return False


def _kept(original: str, rewrite: str) -> float:
    """Share of the prompt's tokens that tiles of the rewrite cover."""
    a, b = tokens(original), tokens(rewrite)
    return sum(k for _, _, k in tiles(a, b, 2)) / len(a) if a else 0.0


def tiles(a: list[str], b: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of maximal common runs, longest first, each
    token used once; ties go to the earliest."""
    out: list[tuple[int, int, int]] = []
    used_a, used_b = [False] * len(a), [False] * len(b)
    at: dict[tuple, list[int]] = {}
    for j in range(len(b) - least + 1):
        at.setdefault(tuple(b[j : j + least]), []).append(j)
    while True:
        best: list[tuple[int, int, int]] = []
        longest = least
        for i in range(len(a) - least + 1):
            if used_a[i]:
                continue
            for j in at.get(tuple(a[i : i + least]), ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > longest:
                    best, longest = [(i, j, k)], k
                elif k == longest:
                    best.append((i, j, k))
        if not best:
            return sorted(out, key=lambda x: x[1])
        for i, j, k in best:
            if not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
                used_a[i : i + k] = [True] * k
                used_b[j : j + k] = [True] * k
                out.append((i, j, k))


# list and heading marks at the start of a line, inside any wrapping
_MARK = regex.compile(r"^[ \t\"'“„«‘*_`#>+•·‣▪◦–—-]*[(（]?(?:\d{1,3}[.)、）](?!\d)|[A-Za-z][.)）](?=\s)|[一二三四五六七八九十]{1,3}、)", regex.M)
# a lead-in of unknown wording: one sentence, of any length, that ends as lead-ins do
_PIECE = regex.compile(r"[^\n.!?。！？]+(?:[:：]|\n|\s[-–—])[^\p{L}\p{N}]*")


def covered(original: str, rewrite: str) -> bool:
    """Tiles of the rewrite are the whole original, once or repeated, in its order. Uncovered are list marks and a
    lead-in at the very start at most."""
    a = squeeze(original)
    have = Counter(squeeze(rewrite))
    if any(have[x] < n for x, n in Counter(a).items()):
        return False  # some of the original's letters are not there
    t = regex.sub(r"[①-⑳]", lambda m: f"{ord(m[0]) - 0x245F}. ", rewrite)
    t = unicodedata.normalize("NFKC", t)
    letters = [(i, x) for i, c in enumerate(t) if not _ALNUM.match(c) for x in c.casefold()]
    b = [x for _, x in letters]
    marks = {i for m in _MARK.finditer(t) for i in range(*m.span())}
    lead = _PIECE.match(t)
    spare = (sum(i < lead.end() for i, _ in letters) if lead else 0) + sum(i in marks for i, _ in letters)
    have = Counter(b)
    for times in range(len(b) // len(a), 0, -1):
        if len(b) - times * len(a) > spare:
            return False
        if any(have[x] < n * times for x, n in Counter(a).items()):
            continue
        found = tiles(list(a * times), b, min(3, len(a)))
        if sum(k for _, _, k in found) < times * len(a) or found != sorted(found):
            continue
        held = {j for _, at, n in found for j in range(at, at + n)}
        rest = [i for j, (i, _) in enumerate(letters) if j not in held and i not in marks]
        start = letters[found[0][1]][0]
        start = next((m.start() for m in _MARK.finditer(t) if m.start() < start <= m.end() + 2), start)
        if not rest or (max(rest) < start and _PIECE.fullmatch(t[:start])):
            return True
    return False


def is_copy(original: str, rewrite: str) -> bool:
    """The original, once or repeated, apart from case, spacing, punctuation, wrapping, list marks and a lead-in.

    Whole-string equality settles the plain cases; tiling decides the others."""
    o = squeeze(original)
    if not o:
        return original.strip() == rewrite.strip()
    rest = without_lead(rewrite)
    for r in (rewrite, rest):
        p = squeeze(r)
        if p and len(p) % len(o) == 0 and p == o * (len(p) // len(o)):
            return True
    return covered(original, rewrite) or (rest != rewrite.strip() and covered(original, rest))


# elements whose end tag may not be left out
_ELEMENTS = frozenset("ul ol div span b i u em strong table code pre a h1 h2 h3 h4 h5 h6 blockquote section article dl details summary sup sub".split())
_TAG = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(/?)>")
_CUT_TAG = regex.compile(r"</?(?:" + "|".join(sorted(_ELEMENTS | {"li", "p", "td", "tr", "th"})) + r")(?:\s[^<>]*)?$|</[A-Za-z]*$")
_BARE_MARK = regex.compile(r"(?:^|\n)[ \t]*(?:\d{1,3}[.)]|[-*+•]|#{1,6})[ \t]*$")


_SPECIAL = regex.compile(r'[`*_<"“”„«»()\[\]{}（）【】「」『』《》]|\n\n')


def open_at_end(text: str) -> list[str]:
    """Pushdown parse: what is still open at the end, outermost first. Fences and code spans hide what they hold;
    elements of markup close what is inside them; emphasis ends with its paragraph; emoticons and closers without an
    opener are passed over; straight quotes toggle."""
    stack: list[str] = []
    i, n = 0, len(text)

    def close(x: str) -> None:
        while stack.pop() != x:
            pass

    while i < n:
        special = _SPECIAL.search(text, i)
        if not special:
            break
        i = special.start()
        c = text[i]
        if text.startswith("```", i):
            if stack and stack[-1] == "```":
                stack.pop()
            elif "```" not in stack:
                stack.append("```")
            i += 3
            continue
        if stack and stack[-1] == "```":
            i += 1
            continue
        if c == "`":
            if stack and stack[-1] == "`":
                stack.pop()
            else:
                stack.append("`")
        elif stack and stack[-1] == "`":
            pass
        elif c == "<":
            m = _TAG.match(text, i)
            name = m[2].lower() if m else ""
            if name in _ELEMENTS and not m[3]:
                if not m[1]:
                    stack.append(f"<{name}>")
                elif f"<{name}>" in stack:
                    close(f"<{name}>")
            if m:
                i = m.end()
                continue
        elif text.startswith("\n\n", i):
            while stack and stack[-1] in ("*", "_", "**"):
                stack.pop()
        elif text.startswith("**", i):
            if "**" in stack:
                close("**")
            else:
                stack.append("**")
            i += 2
            continue
        elif c in "*_":
            before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
            if c in stack and not before.isspace() and not after.isalnum():
                close(c)
            elif c not in stack and after.isalpha() and (before.isspace() or before in "([{\"'“„«"):
                stack.append(c)
        elif c == '"':
            if '"' in stack:
                close('"')
            else:
                stack.append('"')
        elif c in "“”" and "„" in stack:
            close("„")
        elif c in "([{（【「『《“«„":
            stack.append(c)
        elif c in _PAIRS:
            if _PAIRS[c] in stack:
                close(_PAIRS[c])
        i += 1
    return stack


def cut_mark(text: str) -> bool:
    """The text ends in a tag without its end, or in a list or heading mark with nothing after it."""
    return bool(_CUT_TAG.search(text)) or bool(_BARE_MARK.search(text)) and "\n" in text.strip()


def ending(original: str, rewrite: str) -> tuple[str, str, str, int]:
    """('truncated' | 'whole' | 'unsure...', opening, last, length) of the rewrite's end."""
    t = regex.sub(r"[\s\u200b]+$", "", rewrite)
    if cut_mark(t) and not cut_mark(regex.sub(r"\s+$", "", original)):
        return "truncated", "", "", 0
    still = open_at_end(t)
    if still and len(still) > len(open_at_end(original)):
        return "truncated", "", "", 0
    bare = regex.sub(r"^[*_>`#\s]+|[*_`\s]+$", "", t)
    if bare.endswith(_OPEN_END) and not regex.search(r"[.!?。！？]\s*[/)\]）】:：;-]+$", bare):
        oend = regex.sub(r"[*_`\s]+$", "", original)
        if not oend.endswith(bare[-3:]):
            return "truncated", "", "", 0
    spans = S.sentences(t)
    last = t[spans[-1][0] : spans[-1][1]].strip() if spans else ""
    if _FINAL.search(last):
        if not regex.search(r"(?:^|\s)\p{L}?\.$", last):
            return "whole", "", "", 0
    frag = tokens(last)
    if not frag:
        return "whole", "", "", 0
    cjk = bool(S.CJK.match(frag[0])) or bool(S.CJK.search(last[-2:]))
    # against the prompt's own sentences: the same sentence in full, or broken off
    best = None
    for a, b in S.sentences(original):
        o = tokens(original[a:b])
        if not o:
            continue
        same = 0
        while same < min(len(o), len(frag)) and o[same] == frag[same]:
            same += 1
        if o == frag:
            return "whole", "", "", 0
        need = 4 if cjk else 3
        if same >= need or (same == len(frag) and same >= 2):
            if same == len(frag) or (same == len(frag) - 1 and not cjk and len(o) > same and o[same].startswith(frag[-1]) and o[same] != frag[-1]):
                return "truncated", "", "", 0
            best = max(best or (0, []), (same, o))
    if best and best[1][-1] == frag[-1] and abs(len(best[1]) - len(frag)) <= max(1, len(frag) // 10):
        return "whole", "", "", 0
    if cjk:
        if any(last.endswith(x) for x in _DANGLING_CJK if x not in ("し", "て", "な", "と", "も")):
            return "truncated", "", "", 0
    elif frag[-1] in _DANGLING:
        return "truncated", "", "", 0
    # a last word the prompt holds, as names are, is not cut off inside
    return ("unsure" if cjk or frag[-1] not in tokens(original) else "unsure, word whole", *end_key(frag))


def end_key(frag: list[str]) -> tuple[str, str, int]:
    """(opening, last, length) of a sentence, for comparison with others: its first two tokens and its last (the
    last two characters of one without word spaces); numbers are one word."""
    same = lambda x: "0" if x[0].isdigit() else x
    spaced = not (S.CJK.match(frag[-1]) or S.CJK.match(frag[0]))
    return " ".join(map(same, frag[:2])), same(frag[-1]) if spaced else "".join(map(same, frag[-2:])), len(frag)


def endings(rewrite: str) -> list[tuple[str, str, int]]:
    """Keys of the sentences that end in a stop."""
    out = []
    for a, b in S.sentences(rewrite):
        s = rewrite[a:b].strip()
        if _FINAL.search(s):
            f = tokens(s)
            if len(f) > 1:
                out.append(end_key(f))
    return out


def other_language(own: list, theirs: list) -> bool:
    """The rewrite's leading language is one in which the prompt has no sentence."""
    lead = main_language(theirs)
    mine = set(whole_languages(own)) | {main_language(own)}
    if lead is None or mine == {None}:
        return False
    letters = sum(s[5] for s in theirs if s[2] == lead)
    return lead not in mine and letters >= 4


# ---- on tables ------------------------------------------------------------------------------------


def first_pass(entries: DataFrame, model: Model) -> DataFrame:
    """(id, defect, opening, last, length) of entries with a defect, or 'unsure...' where the end is open."""
    shipped = entries.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for b in batches:
            origs, rews = b["original"].tolist(), [x if isinstance(x, str) else None for x in b["optimized"]]
            recs: list = []
            ask = []
            for i, o, r in zip(b["id"], origs, rews):
                if says_nothing(r):
                    recs.append((i, "empty", None, None, None))
                elif refuses(r, o):
                    recs.append((i, "refusal", None, None, None))
                elif is_copy(o, r):
                    recs.append((i, "copy", None, None, None))
                else:
                    ask.append((i, o, without_lead(r)))
            both = judged(m, [o for _, o, _ in ask] + [r for _, _, r in ask])
            for (i, o, r), x, y in zip(ask, both, both[len(ask) :]):
                if other_language(x, y):
                    recs.append((i, "other_language", None, None, None))
                    continue
                kind, op, la, n = ending(o, r)
                if kind != "whole":
                    recs.append((i, kind, op, la, n))
            yield pd.DataFrame(recs, columns=["id", "defect", "opening", "last", "length"])

    kept = entries.filter(F.col("original").isNotNull() & (F.regexp_replace("original", r"[\s\u3000 \u200b]+", "") != ""))
    return kept.select("id", "original", "optimized").mapInPandas(run, "id string, defect string, opening string, last string, length int")


def sentence_ends(entries: DataFrame) -> DataFrame:
    """(opening, last, length, n) over all sentences of all rewrites, added up in each task before the shuffle."""

    def run(batches):
        for b in batches:
            n: dict = {}
            for r in b["optimized"]:
                for e in endings(r):
                    n[e] = n.get(e, 0) + 1
            yield pd.DataFrame([(*e, k) for e, k in n.items()], columns=["opening", "last", "length", "n"])

    parts = entries.filter("optimized is not null").select("optimized").mapInPandas(run, "opening string, last string, length int, n long")
    return parts.groupBy("opening", "last", "length").agg(F.sum("n").alias("n"))


def settle(first: DataFrame, ends: DataFrame) -> DataFrame:
    """Decides the unsure ends: truncated if no sentence of the same opening ends so, although, by the share of
    endings seen once (Good-Turing), unseen ones are not to be expected; or if it is shorter than nearly
    all of them; or if no sentence at all ends in that word, unless the prompt holds it."""
    by_pair = ends.groupBy("opening", "last").agg(F.sum("n").alias("n_pair"))
    lengths = ends.groupBy("opening", "length").agg(F.sum("n").alias("n"))
    by_open = by_pair.groupBy("opening").agg(F.sum("n_pair").alias("n_open"), F.sum(F.when(F.col("n_pair") == 1, 1).otherwise(0)).alias("n_once"))
    short = lengths.groupBy("opening").agg(F.expr("percentile(length, 0.03, n)").alias("least"))
    by_last = by_pair.groupBy(F.col("last")).agg(F.sum("n_pair").alias("n_last"))
    sure = first.filter("defect not like 'unsure%'").select("id", "defect")
    u = first.filter("defect like 'unsure%'")
    u = u.join(by_pair, ["opening", "last"], "left").join(by_open, "opening", "left").join(short, "opening", "left").join(by_last, "last", "left")
    seen = F.coalesce("n_pair", F.lit(0))
    expected = F.coalesce(F.col("n_once") / F.col("n_open"), F.lit(1.0))
    cut = (seen == 0) & (((F.coalesce("n_open", F.lit(0)) >= 5) & (F.col("length") < F.col("least"))) | ((F.coalesce("n_open", F.lit(0)) >= 20) & (expected < 0.1)) | ((F.coalesce("n_last", F.lit(0)) == 0) & (F.col("defect") == "unsure")))
    return sure.unionByName(u.filter(cut).select("id", F.lit("truncated").alias("defect")))
