"""Placeholders, parts of speech, slots, verification, segmentation, diff and vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zipfloom.operators import guard, diff, embed, pos, segment_zh, slots, verify
from zipfloom.operators.placeholders import placeholder_spans

SPANS = [
    ("Hello {name}, welcome!", ["{name}"]), ("Please do [TASK] carefully", ["[TASK]"]), ("Set $HOME and $PATH first", ["$HOME", "$PATH"]), ('He said "hello world" to me', ['"hello world"']), ("The answer is 42 or 3.14", ["42", "3.14"]),
    ("Increase by 15%", ["15%"]), ("Contact user@example.com for help", ["user@example.com"]), ("Today is 2026-06-02, hi", ["2026-06-02"]), ("今天是2026年6月2日", ["2026年6月2日"]), ("Just a plain sentence.", []), ("Use { to mean literal brace", []),
    ("-5", ["5"]), ("1e-5", ["1e", "5"]), ("5km", ["5k"]), ("abc123", ["123"]), ("https://x.y.", ["https://x.y."]), ("1,000 and {a{b}c}", ["1,000", "{a{b}c}"]), ("1<2>3", ["1", "2", "3"]), ("<b> x", ["<b>"]), ("1.2.3", ["1.2", "3"]), ("", []),
]


@pytest.mark.parametrize("text,want", SPANS)
def test_placeholders(text, want):
    got = placeholder_spans(text)
    assert [s[1] for s in got] == want
    assert all(text[a:b] == t for _, t, a, b, _ in got)


POS = {"the": "function", "of": "function", "is": "function", "policy": "noun", "mechanism": "noun", "adjustment": "noun", "economy": "noun", "explain": "verb", "analyze": "verb", "modify": "verb", "realize": "verb", "carefully": "adverb", "clearly": "adverb", "careful": "adjective", "detailed": "adjective", "global": "adjective", "fiscal": "adjective", "during": "preposition", "although": "preposition", "": "other"}
POS_ZH = {"阐述": "verb", "说明": "verb", "分析": "verb", "财政政策": "noun", "均衡状态": "noun", "不": "adverb", "没": "adverb", "不要": "adverb", "请": "adverb", "在": "preposition"}


def test_pos(spark):
    en = spark.createDataFrame([(w,) for w in POS], "w string").select("w", pos.tag_en(F.col("w")).alias("t"))
    assert {r["w"]: r["t"] for r in en.collect()} == POS
    zh = spark.createDataFrame([(w,) for w in POS_ZH], "w string").select("w", pos.tag_zh(F.col("w")).alias("t"))
    assert {r["w"]: r["t"] for r in zh.collect()} == POS_ZH
    assert all(slots._zh_pos(w) == t for w, t in POS_ZH.items())


def kinds(spark, text, fn=slots.slots_en):
    got = spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("s")).first()["s"]
    return None if got is None else [(s["kind"], s["text"]) for s in got]


def test_slots_en(spark):
    k = kinds(spark, "Please explain the impact of fiscal policy on macroeconomic equilibrium.")
    assert ("register", "Please") in k and ("action", "explain") in k and ("object", "fiscal policy") in k
    assert "negation" in dict(kinds(spark, "Do not use this method"))
    assert ("qtype", "How") in kinds(spark, "How does this work?")
    assert {("entity", "Apple"), ("entity", "Microsoft")} <= set(kinds(spark, "Tell me about Apple Inc and Microsoft"))
    assert ("condition", "If") in kinds(spark, "If you have time, tell me")
    assert ("object", "student") in kinds(spark, "I am a student")
    assert kinds(spark, "") == [] and kinds(spark, None) is None


def test_slots_with_placeholders(spark):
    got = kinds(spark, "Greet {name} now", slots.all_slots)
    assert got[0] == ("object", "Greet") or ("placeholder", "{name}") in got
    assert got.index(("placeholder", "{name}")) < got.index(("object", "name"))
    assert kinds(spark, "为{name}写信", slots.all_slots) == [("placeholder", "{name}")]


def test_verify(spark):
    s = spark.createDataFrame([(1, 0, "placeholder", "{name}"), (1, 1, "object", "policy"), (2, 0, "placeholder", "{name}"), (3, 0, "object", "a"), (3, 1, "object", "b")], "id int, slot_ord int, kind string, text string")
    sim = spark.createDataFrame([(1, 0, "{name}", 0.0), (1, 1, "policies", 0.95), (2, 0, "{user}", 0.99), (3, 0, "a", 0.95), (3, 1, "c", 0.70)], "id int, slot_ord int, text string, similarity double")
    v = verify.verify_slots(s, sim)
    p = {r["id"]: r for r in verify.preservation(v, spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")).collect()}
    assert p[1]["passes"] and p[1]["preservation"] == pytest.approx(0.975)
    assert (p[2]["passes"], p[2]["preservation"], p[2]["bad"]) == (False, 0.0, True)
    assert p[3]["preservation"] == pytest.approx(0.825) and not p[3]["passes"]
    assert (p[4]["preservation"], p[4]["passes"], p[4]["total"]) == (1.0, True, 0)
    c = spark.createDataFrame([(1, "keep {name}", "x"), (2, None, "x")], "id int, candidate string, kind2 string")
    got = {(r["id"], r["slot_ord"]): r["issue"] for r in verify.structural_check(s, c).collect()}
    assert got == {(1, 0): None, (2, 0): "missing"}


@given(st.text(alphabet="今天气很好财政a， 1", max_size=14))
@settings(max_examples=150, deadline=None)
def test_segment_keeps_text(text):
    words, pairs = {"今天": 6.0, "天气": 5.5, "财政": 5.0, "好": 6.0}, {"今天 天气": 6.0}
    toks = segment_zh.segment(text, words, pairs)
    assert "".join(toks) == "".join(c for c in text if c != " ")
    for (a, b), t in zip(segment_zh.places(text, toks), toks):
        assert text[a:b] == t


def slow_segment(text, words, pairs):
    """All ways to cut a short text of CJK characters, the best by score, earlier starts first on ties."""
    import math

    factor = {1: 0.3, 2: 1.0, 3: 1.1}
    dp = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 8), end):
            w, (score, path) = text[start:end], dp[start]
            score += math.log(max(words.get(w, 3.5), 0.1)) * factor.get(len(w), 1.05)
            if len(path) > 1:
                score += 0.4 * math.log(max(pairs.get(f"{path[1]} {w}", 3.5), 0.1))
            if end not in dp or score > dp[end][0]:
                dp[end] = (score, [*path, w])
    return dp[len(text)][1]


@given(st.text(alphabet="今天气很好财政", max_size=12))
@settings(max_examples=200, deadline=None)
def test_segment_is_best(text):
    words, pairs = {"今天": 6.0, "天气": 5.5, "财政": 5.0, "好": 6.0, "很好": 7.5}, {"天气 很好": 6.0, "今天 天气": 5.0}
    assert segment_zh.segment(text, words, pairs) == slow_segment(text, words, pairs)


def test_slots_zh():
    lex = {w: 9.0 for w in ("请", "阐述", "财政", "政策", "影响")}
    got = slots.slots_zh_of("请阐述财政政策影响", lex, {})
    assert "".join(s[1] for s in got) == "请阐述财政政策影响"
    assert {"register", "action", "qtype"} <= {s[0] for s in got}
    assert slots.slots_zh_of("", {}, {}) == []


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = d[i - 1][j - 1] + 1 if x == y else max(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


@given(st.text(alphabet="ab ,", max_size=20), st.text(alphabet="ab ,", max_size=20))
@settings(max_examples=200, deadline=None)
def test_diff(a, b):
    ops = diff.diff_ops(a, b, "zh")
    assert "".join(t for o, t in ops if o != "add") == a
    assert "".join(t for o, t in ops if o != "remove") == b
    assert sum(o == "equal" for o, _ in ops) == lcs(a, b)


def test_diff_large_and_null(spark):
    big = "x y " * 400
    assert [o for o, _ in diff.diff_ops(big, big + "z")] == ["remove", "add"]
    r = spark.createDataFrame([(None, "a b")], "a string, b string").select(diff.diff(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert [x["op"] for x in r] == ["add"] * 3


def test_vectors(spark):
    v = embed.heuristic_vector("fiscal policy")
    assert np.linalg.norm(v) == pytest.approx(1.0, abs=1e-6) and not embed.heuristic_vector("").any()
    assert float(v @ embed.heuristic_vector("fiscal policies")) > 0.85
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in m[i]], "q") for i in range(60)] + [(60, None, "q"), (61, [0.0] * 8, "q")], "k long, v array<double>, similarity string")
    got = embed.nearest(df.select("k", "v"), "k", "v", df.filter("k % 20 = 0"), 5).collect()
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for q in (0, 20, 40):
        want = [int(i) for i in np.argsort(-(u @ u[q])) if i != q][:5]
        assert [r["neighbour"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want
    assert embed.nearest(df.select("k", "v"), "k", "v", df.filter("k < 0")).count() == 0


def test_guard(spark):
    from zipfloom.operators import guard

    rows = [("a", "Please keep {name} and explain fiscal policy", "Kindly keep {name} and explain fiscal policies", "x"), ("b", "Use {name} now", "Use {user} now", "x"), ("c", "", None, "x"), ("d", "Explain inflation", None, "x"), ("e", None, "anything", "x")]
    df = spark.createDataFrame(rows, "id string, original string, candidate string, text string")
    got = {r["id"]: r for r in guard.judge(df).collect()}
    assert got["b"]["preservation"] == 0.0 and not got["b"]["passes"]
    assert got["c"]["preservation"] == 1.0 and got["c"]["passes"] and got["e"]["total"] == 0
    assert got["d"]["preservation"] == 0.0 and got["d"]["bad"]
    m = {(r["id"], r["text"]): (r["matched"], r["similarity"]) for r in guard.match_slots(df).collect()}
    assert m[("a", "{name}")] == ("{name}", 1.0) and m[("b", "{name}")] == ("", 0.0)
    assert m[("a", "fiscal policy")][0] == "fiscal policies" and m[("a", "fiscal policy")][1] > 0.85


def test_text_similarity(spark):
    sim = embed.text_similarity()
    df = spark.createDataFrame([("fiscal policy", "fiscal policies"), ("same", "same"), (None, "x"), ("", "x"), (None, None)], "a string, b string")
    got = [r["s"] for r in df.coalesce(1).select(sim(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == pytest.approx(float(embed.heuristic_vector("fiscal policy") @ embed.heuristic_vector("fiscal policies")), abs=1e-6)
    assert got[1] == pytest.approx(1.0) and got[2:] == [0.0, 0.0, 0.0]


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_vector_against_plain_loops(text):
    v = np.zeros(64, dtype=np.float32)
    low = text.lower().strip()
    units = embed.utf16_units("".join(low.split()))
    for n in (1, 2, 3):
        for i in range(len(units) - n + 1):
            v[embed.hash_units(units[i : i + n]) % 64] += np.float32(1.0 / n)
    for w in low.split():
        u = embed.utf16_units(w)
        if len(u) >= 2:
            v[embed.hash_units(u) % 64] += np.float32(0.5)
    norm = np.linalg.norm(v.astype(np.float64))
    assert np.allclose(embed.heuristic_vector(text), v / norm if norm else v, atol=1e-6)


def test_chinese_negations_are_guarded(spark, tmp_path):
    from zipfloom.plans import scoring as plans

    h = [("kept", "请不要写代码", "不要写代码"), ("lost", "请不要写代码", "请写代码"), ("en", "Do not write code", "Write code")]
    sch = "id string, saved_at string, original string, optimized string, original_score double, optimized_score double"
    spark.createDataFrame([(i, "2025-01-01", o, r, 3.0, 4.0) for i, o, r in h], sch).write.parquet(f"{tmp_path}/history.parquet")
    spark.createDataFrame([("zh", w, 50) for w in ("不要", "代码", "写", "请")], "lang string, word string, word_count long").write.parquet(f"{tmp_path}/domain_freq.parquet")
    d = str(tmp_path)
    assert {r["id"] for r in plans.structural_check(spark, d).filter("kind = 'negation' and issue = 'missing'").collect()} == {"lost", "en"}
    got = {r["id"]: r for r in plans.guard_rewrites(spark, d).collect()}
    assert (got["lost"]["preservation"], got["lost"]["passes"]) == (0.0, False) and got["kept"]["preservation"] > 0
    x = slots.slot_rows(spark.createDataFrame([("lost", "请不要写代码")], "id string, original string"), "id", plans._slots(spark, d)(F.col("original"))).collect()
    assert "negation" in {r["kind"] for r in x}
    assert {r["id"] for r in plans.optimize_prompts(spark, d).collect()} == {"kept", "lost", "en"}


def test_whole_dictionary_segments(spark, tmp_path):
    from zipfloom.plans import scoring as plans

    # the rarest of 21,000 words, beyond any cut by frequency
    many = [chr(0x5000 + i // 150) + chr(0x7000 + i % 150) for i in range(21_000)]
    rows = [("zh", w, 1000) for w in many] + [("zh", " 天气预报 ", 2), ("zh", "abc", 9), ("zh", "一二三四五六七八九", 9)]
    spark.createDataFrame(rows, "lang string, word string, word_count long").write.parquet(f"{tmp_path}/domain_freq.parquet")
    spark.createDataFrame([(1, "天气预报")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = plans._zh_words(spark, str(tmp_path)).map()
    assert len(words) == 21_001 and "天气预报" in words
    total = sum(n for _, _, n in rows)
    assert words["天气预报"] == pytest.approx(np.log10(2 / total * 1e9))
    want = segment_zh.segment("天气预报", words, {})
    assert [r["token"] for r in plans.segment_chinese(spark, str(tmp_path)).orderBy("pos").collect()] == want


def test_slots_in_python_are_those_of_the_expression(spark):
    texts = ["Please explain how the global Fiscal Policy quickly affects our economic growth rate, if possible.", "Never compare Large old stone bridges with the one", "", "Explain IBM's  new   way - of doing things", "don't stop Émile élan", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in df.select("t", slots.slots_en(F.col("t")).alias("s")).collect():
        assert (None if r["t"] is None else slots.slots_en_of(r["t"])) == (None if r["s"] is None else [tuple(x) for x in r["s"]])


def test_a_failing_encoder_never_passes(spark):
    def encode(text):
        raise ValueError("no model")

    df = spark.createDataFrame([("a", "Explain the global economy now", "Explain the economy"), ("b", "{x}", "{x}")], "id string, original string, candidate string")
    got = {r["id"]: r for r in guard.judge(df, encode=encode).collect()}
    assert not got["a"]["passes"] and got["a"]["preservation"] == 0.0
    assert got["b"]["passes"] and got["b"]["preservation"] == 1.0  # its only slot has to stay as it is, which needs no encoder
