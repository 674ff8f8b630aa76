"""Encoding of a corpus with a public byte-level BPE by merge replay.

A task takes the distinct words of its part of the corpus, lays them out in one array of symbols and keeps an
inverted index from token pair to the positions where it stands. Merges are applied in rank order to all
positions of a pair at once; only the neighbours a merge touches change the index. BPE treats words
independently, so the replay of a part gives the ids the replay of the whole gives, and nothing is shuffled:
the one stage reads, replays and writes. Words already replayed in a worker are kept in a bounded table.

Null and empty texts have no ids: an empty list, never null. Strings of special tokens inside a text are
ordinary text.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
KEPT_WORDS = 200_000  # words a worker keeps ids of; beyond it the table starts anew
SLICE_CHARS = 4_000_000  # text replayed at once

# fixed value: the published split pattern of this family of byte-level tokenizers
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: printable bytes for themselves,
    the others, in order, for the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """Ids of single bytes, and for each pair of ids that merges its rank and the id it becomes."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.bytes = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        self.rank: dict[int, int] = {}
        self.becomes: list[int] = []
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(vocab[a] << 32 | vocab[b], i)
            self.becomes.append(vocab[a + b])


def replay(words: list[str], merges: Merges) -> list[list[int]]:
    """Ids of each word. One array of symbols holds all words, a -1 after each."""
    if not words:
        return []
    encoded = [w.encode("utf-8", "surrogatepass") for w in words]
    raw = np.frombuffer(b"\x00".join(encoded) + b"\x00", dtype=np.uint8)
    lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
    ends = np.cumsum(lengths + 1) - 1
    first = merges.bytes[raw]
    first[ends] = -1
    sym = first.tolist()
    n = len(sym)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    # the index: positions of each mergeable pair, by the position of its left symbol
    where: dict[int, list[int]] = {}
    rank, becomes = merges.rank, merges.becomes
    keys = (first[:-1] << 32) | np.where(first[1:] < 0, 0, first[1:])
    ok = (first[:-1] >= 0) & (first[1:] >= 0)
    at = np.nonzero(ok)[0]
    order = np.argsort(keys[at], kind="stable")
    at = at[order]
    ks, start = np.unique(keys[at], return_index=True)
    for k, part in zip(ks.tolist(), np.split(at, start[1:])):
        if k in rank:
            where[k] = part.tolist()
    heap = [(rank[k], k) for k in where]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        places = where.pop(k, None)
        if not places:
            continue
        a, b, new = k >> 32, k & 0xFFFFFFFF, becomes[r]
        places.sort()
        for i in places:
            if sym[i] != a:
                continue
            j = right[i]
            if j >= n or sym[j] != b:
                continue
            sym[i] = new
            sym[j] = -2
            nxt = right[j]
            right[i] = nxt
            if nxt < n:
                left[nxt] = i
                c = sym[nxt]
                if c >= 0:
                    kk = new << 32 | c
                    if kk in rank:
                        if kk in where:
                            where[kk].append(i)
                        else:
                            where[kk] = [i]
                            heapq.heappush(heap, (rank[kk], kk))
            p = left[i]
            if p >= 0:
                c = sym[p]
                if c >= 0:
                    kk = c << 32 | new
                    if kk in rank:
                        if kk in where:
                            where[kk].append(p)
                        else:
                            where[kk] = [p]
                            heapq.heappush(heap, (rank[kk], kk))
    s = np.array(sym, dtype=np.int64)
    live = s[s != -2]
    cut = np.nonzero(live == -1)[0]
    out, begin = [], 0
    for e in cut.tolist():
        out.append(live[begin:e].tolist())
        begin = e + 1
    return out


class Encoder:
    """Encodes texts of a worker, slice by slice."""

    def __init__(self, path: str):
        self.merges, self.split, self.known = Merges(path), regex.compile(SPLIT), {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = []
        part: list[str | None] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= SLICE_CHARS:
                out += self._slice(part)
                part, size = [], 0
        return out + self._slice(part)

    def _slice(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        split = [self.split.findall(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in known})
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list({w for ws in split for w in ws})
        known.update(zip(new, replay(new, self.merges)))
        return [[i for w in ws for i in known[w]] for ws in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(documents: DataFrame, path: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row, without special tokens."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = enc(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    d = documents.select(documents[key].alias(key), documents[text].alias(text))
    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, path: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): the length of each row's ids."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(x) for x in enc(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "tokens"])

    d = documents.select(documents[key].alias(key), documents[text].alias(text))
    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, tokens long")


_BYTES: dict[str, list[bytes]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, read once a worker process; empty for special tokens."""
    if path not in _BYTES:
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_letters())}
        table = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            table[i] = bytes(back[c] for c in t) if all(c in back for c in t) else b""
        _BYTES[path] = table
    return _BYTES[path]


def texts(encoded: DataFrame, path: str = TOKENIZER, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids): what token_ids() encoded; an empty list gives an empty text, null ids a null one."""

    def run(batches):
        for b in batches:
            table = token_bytes(path)
            got = [None if ids is None else b"".join(table[i] for i in ids).decode("utf-8", "surrogatepass") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=[key, "text"])

    d = encoded.select(encoded[key].alias(key), encoded["ids"].alias("ids"))
    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, text string")
