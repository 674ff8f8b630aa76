"""Abusive, hateful and sexually explicit content.

Words are undone of disguise (zero-width and look-alike letters, spaced or joined letters, digits for letters,
masks, drawn-out letters) and sought in one trie of the lexicon's words by a bit-parallel Levenshtein
automaton: one error for words of five letters and more, any letter for a masked one. Phrases of the lexicon
are then read in word order. A word in plain letters that resembles a term but is commoner in the corpus than
the term is no misspelling of it. Per sentence, scores of its window weigh what is said against somebody
against signs of report, prohibition or everyday sense. The score of a document is that of its worst sentence.

Null, empty and blank texts score 0. Every sentence of a text is read.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import abuse_terms as T
from . import segment as S

FLAG = 0.6  # score from which a document counts as abusive
KINDS = ("INSULT", "WEAK", "ADDRESS", "HARM", "HATE", "SEXUAL", "HALF", "REPORT", "SPEECH", "TOLD_OF", "HARMLESS", "EVERYDAY")
TOLD = frozenset({"INSULT", "WEAK", "HARM", "HATE", "SEXUAL", "HALF"})  # what is scored; the rest is its window
GAP = 3  # words between two words of a phrase
CJK_GAP = 14  # characters for "…"
REACH, CJK_REACH = 6, 16  # words, characters between an insult and what turns it against somebody
LONG = 9  # letters from which a word may be two errors away
NEAR, CLEAR = 0.7, 0.79  # likeness of a word one error away, if it may be a name, and if not
RARE, SHARE = 3, 3e-4  # a word near a term is ordinary from this count and this share of the documents
KEPT = 200_000  # words and sentences a worker remembers

# fixed values: letters of other scripts that look like Latin ones, and signs used for letters
_ALIKE = str.maketrans("аеорсухіјѕԁԛѡһӏԍьвкмнтαορινυχκτεβμηζ", "aeopcyxijsdqwhlgbbkmhtaopivuxktebmnz")
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a", "!": "i", "€": "e", "|": "l", "+": "t"}
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}$@!][ \-._·•*\u200b]){2,}[\p{L}\p{N}$@!](?![\p{L}\p{N}])")
_JOINED_BY = regex.compile(r"[ \-._·•*\u200b]")
_HIDDEN = regex.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad]")
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}*#@$%!€|+'’\-]+")
_CJK_SEP = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}ー])[ \u3000·・•*_\-.~|/\u200b]{1,2}(?=[\p{Han}\p{Hiragana}\p{Katakana}ー])")
_QUOTE = regex.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』")


_PART = regex.compile(r"[^'’]+")
_TIGHT = regex.compile(r"[\s'’\-]*")  # between words of one run


def fold(word: str) -> str:
    """Lower case without accents."""
    w = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", word).lower().replace("ß", "ss"))
    return unicodedata.normalize("NFC", "".join(c for c in w if not unicodedata.combining(c) or c in "゙゚"))


def _spread(alt: str) -> list[str]:
    """The words an alternative stands for: a class by its name, with what stands before it."""
    before, at, name = alt.partition("@")
    return [before + w for w in T.CLASSES[name].split()] if at else [alt]


class Lexicon:
    """Phrases as rows of alternatives of word numbers, and the trie of the words."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.phrases: list[tuple[str, list[frozenset[int]]]] = []
        self.cjk: list[tuple[str, list[list[str]]]] = []
        for kind in KINDS:
            for line in getattr(T, kind).strip().splitlines():
                if S.CJK.search(line):
                    self.cjk.append((kind, [[fold(x) for x in _spread(part)] for part in line.split("…")]))
                else:
                    self.phrases.append((kind, [frozenset(self._word(w) for alt in slot.split("|") for w in _spread(alt)) for slot in line.split()]))
        self.trie: dict = {}
        for w, i in self.words.items():
            node = self.trie
            for c in w.rstrip("-") if w.endswith("-") else w:
                node = node.setdefault(c, {})
            node["prefix" if w.endswith("-") else "end"] = i
        self.left: dict[int, tuple[int, int]] = {}  # by node: least and most letters to the end of a word
        self._measure(self.trie)
        whole = [w for w in self.words if not w.endswith("-")]
        self.heads = {w[:i] for w in whole for i in range(len(w) + 1)}
        self.tails = {w[i:] for w in whole for i in range(len(w) + 1)}
        self.middles = {w[i:j] for w in whole if len(w) >= LONG - 2 for i in range(len(w)) for j in range(i, len(w) + 1)}
        self.ctrie: dict = {}
        for k, (_, parts) in enumerate(self.cjk):
            for j, p in enumerate(parts):
                for word in p:
                    node = self.ctrie
                    for c in word:
                        node = node.setdefault(c, {})
                    node.setdefault("end", []).append((k, j, len(word)))
        self.by_first: dict[int, list[int]] = {}
        for n, (_, slots) in enumerate(self.phrases):
            for w in slots[0]:
                self.by_first.setdefault(w, []).append(n)
        self.ordinary = set(T.ORDINARY.split())

    def _measure(self, node: dict) -> tuple[int, int]:
        below = [self._measure(x) for c, x in node.items() if c not in ("end", "prefix")]
        ends = [(0, 0)] if "end" in node else []
        got = ends + [(a + 1, b + 1) for a, b in below if b >= 0]
        self.left[id(node)] = (min(a for a, _ in got), max(b for _, b in got)) if got else (0, -1)
        return self.left[id(node)]

    def _word(self, w: str) -> int:
        w = fold(w[:-1]) + "-" if w.endswith("-") and len(w) > 1 else fold(w)
        return self.words.setdefault(w, len(self.words))

    def exact(self, word: str) -> dict[int, float]:
        out, node = {}, self.trie
        for c in word:
            node = node.get(c)
            if node is None:
                return out
            if "prefix" in node:
                out[node["prefix"]] = 1.0
        if "end" in node:
            out[node["end"]] = 1.0
        return out

    def _may_be_near(self, word: str, errors: int) -> bool:
        """Of errors + 1 pieces of a word, one letter apart, so many edits (each of two neighbouring letters at most)
        leave one as it is: it heads, ends or is inside a term. Without one the automaton need not run."""
        if "*" in word:
            return True
        n = (len(word) - errors) // (errors + 1)
        if word[:n] in self.heads or word[-n:] in self.tails:
            return True
        return errors > 1 and word[n + 1 : len(word) - n - 1] in self.middles

    def near(self, word: str, errors: int) -> dict[int, float]:
        """Words of the trie within so many edits; '*' in the word is any one letter and no error.

        The automaton's states are sets of bits, one a number of errors; each edge of the trie is a step."""
        if errors and not self._may_be_near(word, errors):
            return {}
        m, accept = len(word), 1 << len(word)
        wild = sum(1 << i for i, c in enumerate(word) if c == "*")
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            if c != "*":
                mask[c] = mask.get(c, 0) | 1 << i
        full = (1 << (m + 1)) - 1
        start = [1]
        for _ in range(errors):
            start.append((start[-1] | start[-1] << 1) & full)
        out: dict[int, float] = {}
        left = self.left
        todo = [(self.trie, start, None, 0)]
        while todo:
            node, rows, swap, depth = todo.pop()
            for c, nxt in node.items():
                if c == "end" or c == "prefix":
                    continue
                least, most = left[id(nxt)]
                if depth + 1 + least > m + errors or depth + 1 + most < m - errors:
                    continue
                hit = mask.get(c, 0) | wild
                new = [(rows[0] & hit) << 1]
                for e in range(1, errors + 1):
                    r = (rows[e] & hit) << 1 | rows[e - 1] | rows[e - 1] << 1 | new[e - 1] << 1
                    if swap is not None:
                        r |= (swap[e - 1] & hit) << 2
                    new.append(r & full)
                if not any(new):
                    continue
                if "end" in nxt and depth + 1 >= 3:
                    for e, r in enumerate(new):
                        if r & accept and (e == 0 or depth + 1 >= (5 if e == 1 else LONG)):
                            out[nxt["end"]] = max(out.get(nxt["end"], 0), 0.95 if e == 0 else NEAR)
                            break
                # letters that stand one place too early, to be met by the next step
                todo.append((nxt, new, [r & (hit >> 1) for r in rows[:-1]] if errors else None, depth + 1))
        return out


_OWNERS = frozenset("your dein deine deiner ton ta tes votre vos".split())  # of something named, not called so


class Hit(NamedTuple):
    """A phrase met: its place in words (characters in scripts without word spaces), and what is around it."""

    kind: str
    q: float
    at: int
    last: int
    word: str
    alone: bool  # set off by marks on both sides, as one calls somebody
    closed: bool  # a mark follows
    quoted: bool


def plain_forms(word: str) -> list[str]:
    """What a word may be without its disguise, the word itself left out. Signs not used for a letter become
    '*', any letter."""
    w = word.translate(_ALIKE) if any(ord(c) > 0x250 for c in word) else word
    out = []
    if w != word:
        out.append(w)
    core = w.strip("-'’")
    marked = any(c in _LEET or not c.isalpha() for c in core) and any(c.isalpha() for c in core)
    if marked:
        lead = "".join(_LEET.get(c, c if c.isalpha() or c in "-'’" else "*") for c in core)
        out.append(lead)
        if "1" in core:
            out.append("".join("l" if c == "1" else _LEET.get(c, c if c.isalpha() else "*") for c in core))
        if core[-1] in "!+|":
            out.append("".join(_LEET.get(c, c if c.isalpha() else "*") for c in core.rstrip("!+|")))
        bare = "".join(c if c.isalpha() else "*" for c in core)
        if bare.count("*") and bare.rstrip("*"):
            out.append(bare)
        joined = "".join(c for c in core if c.isalpha())
        if "-" in core or "'" in core:
            out.append(joined)
    for x in [w, *out]:
        for r in (r"\1", r"\1\1"):
            y = regex.sub(r"(\p{L})\1{2,}", r, x)
            if y != x:
                out.append(y)
    return list(dict.fromkeys(x for x in out if x and (x != word or "*" in x)))


class Scorer:
    def __init__(self, ordinary: frozenset[str] = frozenset()):
        self.lex = Lexicon()
        self.lex.ordinary |= ordinary
        self.seen: dict[str, dict[int, float]] = {}
        self.said: dict[str, tuple] = {}
        self.known: dict[str, tuple[str, dict[int, float], dict[int, float]]] = {}

    def word(self, w: str) -> dict[int, float]:
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) > KEPT:
                self.seen.clear()
            got = self.seen[w] = self._word(w)
        return got

    def _word(self, w: str) -> dict[int, float]:
        lex = self.lex
        out = dict(lex.exact(w))
        if "'" in w or "’" in w:
            for part in regex.split(r"['’]", w):
                out.update(lex.exact(part))
        if out:
            return out
        forms = plain_forms(w)
        for x in forms:
            for k, v in lex.exact(x).items():
                out[k] = max(out.get(k, 0), 0.95 * v)
        if not out:
            for x in forms:
                letters = sum(c.isalpha() for c in x)
                if letters >= 2 and len(x) >= 3:
                    # a mask must leave its first letter; long masks only fit words of their length
                    for k, v in lex.near(x, 0).items():
                        out[k] = max(out.get(k, 0), v)
        if not out:
            for x in [w, *forms]:
                if len(x) >= 5 and x not in lex.ordinary and x.count("*") <= 1:
                    for k, v in lex.near(x, 2 if len(x) >= LONG else 1).items():
                        out[k] = max(out.get(k, 0), v)
        return out

    def sentence(self, text: str) -> tuple[tuple[tuple[str, float, bool, bool], ...], bool]:
        """(findings (category, score, in quotation), whether others' words are told of), the same for the same text."""
        got = self.said.get(text)
        if got is None:
            if len(self.said) > KEPT:
                self.said.clear()
            got = self.said[text] = self._sentence(text)
        return got

    def _sentence(self, text: str):
        t = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
        if S.CJK.search(t):
            hits, reach, t = self._cjk_hits(t), CJK_REACH, t
        else:
            t = _SPACED.sub(lambda m: _JOINED_BY.sub("", m[0]), t)
            hits, reach = self._word_hits(t), REACH
        return self._weigh(hits, reach)

    def token(self, raw: str) -> tuple[str, dict[int, float], dict[int, float]]:
        """(folded, likeness to words of the lexicon, the same if it is surely no name) of a word as written."""
        got = self.known.get(raw)
        if got is None:
            if len(self.known) > KEPT:
                self.known.clear()
            w = fold(raw).strip("-")
            if not any(c.isalnum() for c in w):
                got = ("", {}, {})
            else:
                trimmed = w.rstrip("!|+'*") if not any(c.isalpha() for c in w[-1:]) else w
                at = self.word(w) or (self.word(trimmed) if trimmed and trimmed != w else {})
                sure = at
                if trimmed.isalpha():
                    plain = at if trimmed == w else self.word(trimmed)  # a stop read as a letter makes no clear word
                    sure = {k: CLEAR if v == NEAR and k in plain else v for k, v in at.items()}
                got = (w, at, sure)
            self.known[raw] = got
        return got

    def _pieces(self, t: str):
        """(start, end, word); what an apostrophe joins is apart unless the lexicon has it joined."""
        for m in _WORD.finditer(t):
            raw, a = m[0], m.start()
            if ("'" in raw or "’" in raw) and not self.lex.exact(fold(raw).replace("’", "'")):
                for part in _PART.finditer(raw):
                    yield a + part.start(), a + part.end(), part[0]
            else:
                yield a, m.end(), raw

    def _word_hits(self, t: str) -> list[Hit]:
        spans, at = [], []
        first = True
        for a, b, raw in self._pieces(t):
            w, like, sure = self.token(raw)
            if w:
                name = not first and raw[0].isupper() and not raw.isupper()  # names, also German nouns
                at.append(like if name else sure)
                spans.append((a, b, w))
                first = False
        if not any(at):
            return []
        hits, lex = [], self.lex
        quotes = [m.span() for m in _QUOTE.finditer(t)]
        for i, m in enumerate(at):
            for n in {n for k in m for n in lex.by_first.get(k, ())}:
                kind, slots = lex.phrases[n]
                q, last = self._follow(at, i, slots)
                if q >= (NEAR if kind in TOLD else 0.8):
                    a, b = spans[i][0], spans[last][1]
                    closed = last + 1 == len(at) or not _TIGHT.fullmatch(t[b : spans[last + 1][0]])
                    alone = closed and (i == 0 or not _TIGHT.fullmatch(t[spans[i - 1][1] : a]))
                    hits.append(Hit(kind, q, i, last, spans[i][2], alone, closed, any(x <= a and b <= y for x, y in quotes)))
        return hits

    @staticmethod
    def _follow(at: list[dict[int, float]], i: int, slots: list[frozenset[int]]) -> tuple[float, int]:
        """(the least likeness of a phrase's words from position i on, 0 where it is not there; its last position)."""
        q = max((at[i][k] for k in slots[0] if k in at[i]), default=0.0)
        for slot in slots[1:]:
            for j in range(i + 1, min(len(at), i + 2 + GAP)):
                v = max((at[j][k] for k in slot if k in at[j]), default=0.0)
                if v:
                    q, i = min(q, v), j
                    break
            else:
                return 0.0, i
        return q, i

    @staticmethod
    def _chained(parts: list[dict[tuple[int, int], float]]) -> tuple[int, float] | None:
        """(start, likeness) of the likest way through one place of each part, in order and within the gap, the
        earliest on ties."""
        ways = {(a, b): (v, a) for (a, b), v in parts[0].items()}
        for part in parts[1:]:
            far: dict[tuple[int, int], tuple[float, int]] = {}
            for (a, b), v in part.items():
                before = [(min(v, w), start) for (_, end), (w, start) in ways.items() if end <= a <= end + CJK_GAP]
                if before:
                    far[(a, b)] = max(before, key=lambda x: (x[0], -x[1]))
            ways = far
        if not ways:
            return None
        v, start = max(ways.values(), key=lambda x: (x[0], -x[1]))
        return start, v

    def _cjk_hits(self, t: str) -> list[Hit]:
        hits: list[Hit] = []
        root = self.lex.ctrie
        for s in dict.fromkeys((fold(_CJK_SEP.sub("", t)), fold(t))):
            found: dict[tuple[int, int], dict[tuple[int, int], float]] = {}  # (phrase, part) -> places, with likeness
            for i, c in enumerate(s):
                if c not in root:
                    continue
                # states of the walk: node, position, masked letters; a mask is any one character
                todo = [(root[c], i + 1, 0)]
                while todo:
                    node, j, masks = todo.pop()
                    for k, part, n in node.get("end", ()):
                        if masks == 0 or masks * 2 <= n:
                            v = 1.0 if not masks else 0.85
                            at = found.setdefault((k, part), {})
                            at[(i, j)] = max(at.get((i, j), 0.0), v)
                    if j >= len(s):
                        continue
                    x = s[j]
                    if x in node:
                        todo.append((node[x], j + 1, masks))
                    elif x in "*#○×●":
                        todo += [(nxt, j + 1, masks + 1) for y, nxt in node.items() if y != "end"]
            quotes = [m.span() for m in _QUOTE.finditer(s)]
            for k in sorted(k for k, part in found if part == 0):
                kind, parts = self.lex.cjk[k]
                got = self._chained([found.get((k, p), {}) for p in range(len(parts))])
                if got:
                    hits.append(Hit(kind, got[1], got[0], got[0], str(k), False, False, any(x < got[0] < y for x, y in quotes)))
        latin = S.CJK.sub(" ", t)
        if len(latin.split()) >= 4:
            hits += self._word_hits(latin)
        return hits

    @staticmethod
    def _weigh(hits: list[Hit], reach: int):
        """Scores of each hit's window. An insult counts in full only against somebody: within reach of an address or
        of contempt, or called out alone. Report, prohibition, fiction and everyday sense take off."""
        kinds = {h.kind for h in hits}
        told = bool(kinds & {"REPORT", "SPEECH", "TOLD_OF"})
        if not kinds & TOLD:
            return (), told
        of = lambda kind: [h for h in hits if h.kind == kind]
        reports = len({h.at for h in of("REPORT")})
        report = (0.5 if reports == 1 else 0.7) if reports else 0.5 if "TOLD_OF" in kinds else 0.0
        everyday, harmless = 0.5 * ("EVERYDAY" in kinds), 0.5 * ("HARMLESS" in kinds)
        address = of("ADDRESS")
        out = []
        for h in hits:
            # in a quotation, what stands around it tells whose words these are
            off = 0.8 if h.quoted and told else report
            if h.kind in ("INSULT", "WEAK"):
                near = len({a.at for a in address if min(abs(a.at - h.last), abs(a.last - h.at), abs(a.at - h.at)) <= reach}) + h.alone
                called = h.closed and any(0 < h.at - a.last <= 2 and a.word not in _OWNERS for a in address)
                if h.kind == "WEAK" and not (h.alone and address or called):
                    continue
                out.append(("insult", 0.5 * h.q + (0.3 if h.q >= CLEAR else 0.2) * min(2, near) - off, h.quoted))
            elif h.kind == "HARM":
                out.append(("threat", 0.9 * h.q - off * (h.quoted or not address) - harmless, h.quoted))
            elif h.kind == "HATE":
                several = len({x.at for x in of("HATE")}) > 1
                out.append(("hate", 0.85 * h.q + 0.1 * several - off - everyday, h.quoted))
            elif h.kind == "SEXUAL":
                several = len({x.at for x in hits if x.kind in ("SEXUAL", "HALF")}) > 1
                out.append(("sexual", 0.8 * h.q + 0.1 * several - off - everyday, h.quoted))
        halves = {h.word: h.q for h in of("HALF")}
        if len(halves) > 1:
            out.append(("sexual", 0.66 * min(halves.values()) - report - everyday, all(h.quoted for h in of("HALF"))))
        best: dict[tuple[str, bool], float] = {}
        for kind, v, quoted in out:
            if v > 0:
                best[kind, quoted] = max(best.get((kind, quoted), 0.0), min(1.0, v))
        return tuple((kind, v, quoted) for (kind, quoted), v in best.items()), told

    def text(self, text: str | None) -> tuple[float, str]:
        best = (0.0, "")
        spans: list[tuple[int, int]] = []
        for a, b in S.sentences(text) if text else ():
            # a "!" before a small letter stands for the last letter of its word
            if spans and text[spans[-1][1] - 1] == "!" and text[a:b].lstrip()[:1].islower():
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        got = [self.sentence(text[a:b].strip()) for a, b in spans]
        for i, (found, told) in enumerate(got):
            for kind, v, quoted in found:
                # a quotation may be told of in the sentence before or after
                if quoted and not told and any(got[j][1] for j in (i - 1, i + 1) if 0 <= j < len(got)):
                    v = max(0.0, v - 0.6)
                if (v, kind) > best:
                    best = (v, kind)
        return best if best[0] else (0.0, "")


_SCORER: dict[frozenset[str], Scorer] = {}


def scorer(ordinary: frozenset[str] = frozenset()) -> Scorer:
    """One scorer a worker process and set of ordinary words."""
    if ordinary not in _SCORER:
        _SCORER.clear()
        _SCORER[ordinary] = Scorer(ordinary)
    return _SCORER[ordinary]


_SPARK_WORD = r"[\p{L}\p{N}\p{M}*#@$%!€|+'’\-]+"  # as _WORD


def ordinary_words(documents: DataFrame) -> frozenset[str]:
    """Words in plain letters near terms, commoner in all documents than those terms, of at least RARE places and SHARE
    places a document. Words are counted in the JVM and the automaton meets each distinct one once. What comes to the
    driver are terms and words of SHARE places a document, of which there are no more than a document's mean number of
    words over SHARE, however many documents there are."""
    words = documents.select(F.explode(F.regexp_extract_all(documents["text"], F.lit(_SPARK_WORD), F.lit(0))).alias("w"))
    # words of two characters and less are near no term
    words = words.filter(F.length("w") > 2).groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))

    def folded(batches):
        lex = scorer().lex
        for b in batches:
            w = [fold(x).strip("-'’") for x in b.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([bool(lex.exact(x)) for x in w], pa.bool_()), b.column("n")], names=["word", "exact", "n"])

    def terms(batches):
        lex = scorer().lex
        name = {i: w for w, i in lex.words.items()}
        for b in batches:
            rows = []
            for w, exact, n in zip(*(b.column(c).to_pylist() for c in ("word", "exact", "n"))):
                near = lex.exact(w) if exact else lex.near(w, 2 if len(w) >= LONG else 1) if len(w) >= 5 and w.isalpha() else {}
                rows += [(w, name[k], n) for k in near]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["word", "term", "n"])

    least = F.greatest(F.lit(float(RARE)), F.lit(SHARE) * F.col("documents"))
    counts = words.mapInArrow(folded, "word string, exact boolean, n long").groupBy("word", "exact").agg(F.sum("n").alias("n"))
    counts = counts.crossJoin(F.broadcast(documents.agg(F.count(F.lit(1)).alias("documents")))).filter(F.col("exact") | (F.col("n") >= least))  # one row
    counts = counts.select("word", "exact", "n").mapInArrow(terms, "word string, term string, n long")
    own: dict[str, int] = {}
    like: dict[str, tuple[int, list[str]]] = {}
    for r in counts.collect():
        if r["word"] == r["term"]:
            own[r["term"]] = own.get(r["term"], 0) + r["n"]
        else:
            n, terms = like.get(r["word"], (0, []))
            like[r["word"]] = (max(n, r["n"]), [*terms, r["term"]])
    return frozenset(w for w, (n, terms) in like.items() if n > max(own.get(t, 0) for t in terms))


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, category): a row for every row of documents; category is null at score 0."""
    ordinary = ordinary_words(documents)

    def run(batches):
        sc = scorer(ordinary)
        for b in batches:
            got = [sc.text(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] or None for g in got], pa.string())], names=["doc_id", "source", "score", "category"])

    d = documents.select(*[documents[c].alias(c) for c in ("doc_id", "source", "text")])
    return d.mapInArrow(run, "doc_id long, source string, score double, category string")


def rates(scored: DataFrame, flag: float = FLAG) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) by source, null sources together."""
    hit = F.sum(F.when(F.col("score") >= flag, 1).otherwise(0))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), hit.alias("flagged"), (hit / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))
