"""Term counts against a plain count."""

import datetime as dt
import math
import random
import unicodedata

from zipfloom.llm import termfreq

FREQ = "table_id long, table_name string, lang string, word string, word_count long, zipf double, loaded_at timestamp, term string"
META = "table_id long, table_name string, lang string, total_tokens long, term string"


def at(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def rows(seed, n):
    rng = random.Random(seed)
    words = ["Haus", " haus", "HAUS　", "ｈａｕｓ", "Ｋ", "ﬁle", "the", "The", "x", "é", "é", "", "  ", None]
    out = [(rng.randrange(6), "n", rng.choice(["en", "en", "de", None]), rng.choice(words), rng.choice([1, 2, 3, 0, -4, None]), 0.0, at(rng.choice([1, 2, 3, None])), "clash") for _ in range(n)]
    return out + out[: n // 5]


def plain(data, meta):
    last = {}
    for t, _, lang, w, n, _, loaded, _ in data:
        if t is None or lang is None or w is None:
            continue
        key, val = (t, lang, w), ((loaded is not None, loaded or at(0)), -1 if n is None else n)
        if key not in last or val > last[key]:
            last[key] = val
    c, tabs = {}, {}
    for (t, lang, w), (_, n) in last.items():
        term = unicodedata.normalize("NFKC", w).lower().strip()
        if n > 0 and term:
            c[(lang, term)] = c.get((lang, term), 0) + n
            tabs.setdefault((lang, term), set()).add(t)
    listed = {}
    for t, _, lang, _, _ in meta:
        listed.setdefault(lang, set()).add(t)
    return {k: (v, len(tabs[k]), v < 5, len(tabs[k]) * 100 >= 40 * len(listed[k[0]]) if k[0] in listed else False) for k, v in c.items()}


def check(spark, write, data, meta):
    f, m = spark.createDataFrame(data, FREQ), spark.createDataFrame(meta, META)
    t = termfreq.term_table(f, m, write).cache()
    got = {(r["lang"], r["term"]): (r["occurrences"], r["n_tables"], r["rare"], r["common"]) for r in t.collect()}
    assert got == plain(data, meta)
    marks = {(r["lang"], r["term"], r["mark"]) for r in termfreq.marks(t).collect()}
    assert marks == {(*k, m) for k, v in got.items() for m, on in (("rare", v[2]), ("common", v[3])) if on}
    return t


def test_counts(spark, write):
    data = rows(1, 300)
    meta = [(i, "n", "en", None, "c") for i in range(6)] + [(0, "n", "en", None, "c"), (9, "n", "de", 5, "c")]
    t = check(spark, write, data, meta)
    en = [r for r in t.collect() if r["lang"] == "en"]
    total = sum(r["occurrences"] for r in en)
    for r in en:
        assert abs(r["zipf"] - min(10, max(0, math.log10(r["occurrences"] / total * 1e9)))) < 1e-9


def test_empty(spark, write):
    assert termfreq.term_table(spark.createDataFrame([], FREQ), spark.createDataFrame([], META), write).count() == 0


def test_heavy_choice_changes_nothing(spark, write):
    terms = write(termfreq.table_terms(spark.createDataFrame(rows(3, 200), FREQ)), "terms")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    every = sorted({(r["lang"], r["term"]) for r in terms.collect()})
    assert key(termfreq.counts(terms, [])) == key(termfreq.counts(terms, every)) == key(termfreq.counts(terms, every[:2]))
    assert 0 < len(termfreq.heavy_terms(terms, 3)) <= 3
