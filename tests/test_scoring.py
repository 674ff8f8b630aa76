"""Frequency tables, sentence scores, rankings and the pipeline."""

import math

import pytest
from pyspark.sql import functions as F

from zipfloom.operators import domain, lexicon, optimize, ranking, scoring
from zipfloom.sources import history as H
from zipfloom.sources import rewrites

DOC = "doc_id long, text string, salt string"


def test_freq_table(spark):
    words = ["财政"] * 3 + ["政策"] * 3 + ["税收", "宏观", "经济", "均衡", "影响", "机制"]
    t = lexicon.freq_table(spark.createDataFrame([(w,) for w in [*words, None]], "token string"))
    r = t.filter("word = '财政'").first()
    assert (r["total_tokens"], r["unique_words"], r["count"]) == (12, 8, 3)
    assert r["zipf"] == pytest.approx(math.log10(3 / 12 * 1e9))
    top = lexicon.top_n(lexicon.freq_table(spark.createDataFrame([(c,) for c in "abacab"], "token string")), 2)
    assert [(x["word"], x["count"]) for x in top.collect()] == [("a", 3), ("b", 2)]


def test_freq_table_empty(spark):
    assert lexicon.freq_table(spark.createDataFrame([], "token string")).count() == 0


def test_zipf_zh(spark):
    lex = spark.createDataFrame([("政策", 5.0), ("财", 4.0), ("财", 3.0)], "word string, zipf double")
    t = spark.createDataFrame([("政策",), ("财政",), ("无",)], "token string")
    got = {r["token"]: r["zipf"] for r in lexicon.with_zipf_zh(t, lex).collect()}
    assert got["政策"] == 5.0 and got["无"] == 3.5
    assert got["财政"] == pytest.approx(math.sqrt(4.0 * 3.5))


def test_measures(spark):
    docs = spark.createDataFrame([(1, "Big cat", "x"), (2, "", "y"), (3, None, "z"), (4, "42 !", "w")], DOC)
    lex = spark.createDataFrame([("big", 6.0), ("cat", 1.0)], "word string, zipf double")
    big = spark.createDataFrame([("Big cat", 5.5), ("Big cat", 5.1)], "phrase string, zipf double")
    s = scoring.scored_tokens(docs, "doc_id", lex, big)
    got = {r["doc_id"]: r for r in scoring.multi_layer(scoring.sentence_measures(docs, s, "doc_id")).collect()}
    # weights 0.7 and 0.7 * 1.3, scores 6 and the floor 2
    assert got[1]["score"] == pytest.approx((6 * 0.7 + 2 * 0.91) / 1.61)
    assert got[1]["live_avg"] == 4.0 and got[1]["collocation"] == 1.0 and got[1]["n_tokens"] == 2
    for i in (2, 3, 4):
        assert (got[i]["score"], got[i]["collocation"], got[i]["complexity"]) == (0.0, 1.0, 1.0)


def test_hybrid(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    lex = spark.createDataFrame([("a", 6.0), ("b", 7.0), ("c", 5.0)], "word string, zipf double")
    dom = spark.createDataFrame([("s", "a", 8.0), ("s", "c", 6.0), ("t", "b", 1.0)], "name string, word string, zipf double")
    r = scoring.hybrid_measures(docs, scoring.scored_tokens(docs, "doc_id", lex), dom, "doc_id", by="source").first()
    assert r["hybrid_score"] == pytest.approx((6.8 * 7 * 5.4) ** (1 / 3))
    assert r["domain_coverage"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("stored", [False, True])
def test_rank_sentences_ties_and_hot_batch(spark, tmp_path, stored):
    rows = [("hot" if i % 3 else "cold", i, float(i % 5)) for i in range(300)] + [(None, 300, 1.0)]
    df = spark.createDataFrame(rows, "batch string, input_pos long, score double")

    def write(d, name):
        d.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    got = ranking.rank_sentences(df, "batch", write=write if stored else None).collect()
    assert len(got) == 301
    for b in ("hot", "cold", None):
        mine = sorted((r for r in got if r["batch"] == b), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(r["score"], r["input_pos"]) for r in mine] == sorted(((r["score"], r["input_pos"]) for r in mine), key=lambda x: (-x[0], x[1]))


def test_candidates_win_ties(spark):
    o = spark.createDataFrame([(1, "o", 2.0)], "id long, text string, score double")
    c = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 2.0)], "id long, pos int, text string, score double")
    r = ranking.rank_candidates(o, c, "id").orderBy("rank").collect()
    assert [x["text"] for x in r] == ["b", "o", "a"]
    assert [x["text"] for x in ranking.beam(ranking.rank_candidates(o, c, "id"), "id", 1).collect()] == ["b"]


def test_lowest_tokens_distinct(spark):
    t = spark.createDataFrame([(1, 0, "b", 2.0), (1, 1, "a", 2.0), (1, 2, "b", 2.0), (1, 3, "c", 9.0)], "doc_id long, pos int, token string, zipf double")
    assert [r["token"] for r in ranking.lowest_tokens(t, "doc_id", 2).orderBy("rank").collect()] == ["b", "a"]
    assert [r["token"] for r in ranking.lowest_live(t, "doc_id").orderBy("rank").collect()] == ["b", "a", "b"]


def test_keep_passing(spark):
    rows = [(1, 0, True, 0.9), (1, 1, False, 1.0), (2, 0, False, 0.5), (2, 1, False, 0.5), (2, 2, False, 0.1)]
    df = spark.createDataFrame(rows, "id long, pos int, passes boolean, preservation double")
    assert sorted((r["id"], r["pos"]) for r in ranking.keep_passing(df, "id").collect()) == [(1, 0), (2, 0)]


def test_optimize(spark):
    o = spark.createDataFrame([(1, "orig", 3.0), (2, "only", 3.0)], "id long, text string, score double")
    sch = "id long, pos int, text string, score double, preservation double, passes boolean"
    r1 = spark.createDataFrame([(1, 0, "a", 3.5, 1.0, True), (1, 1, "a", 3.5, 1.0, True), (1, 2, "bad", 9.0, 0.0, False)], sch)
    r2 = spark.createDataFrame([(1, 0, "b", 4.5, 1.0, True)], sch)
    got = {r["id"]: r for r in optimize.optimize(o, r1, r2).collect()}
    assert (got[1]["optimized"], got[1]["second_applied"]) == ("b", True)
    assert (got[2]["optimized"], got[2]["second_applied"]) == ("only", False)


CASES = [("请阐述财政政策调整对宏观经济均衡状态的影响机制", "zh", "finance", 2.5 / 21.7), ("解释分布式系统中的一致性算法原理", "zh", "tech", 1.7 / 10.7), ("今天天气真好", "zh", None, None), ("Explain the fiscal policy impact on GDP equilibrium", "en", "finance", 2.5 / 10.5), (None, "en", None, None)]


def test_detect_domains(spark):
    df = spark.createDataFrame([(i, t, lg) for i, (t, lg, _, _) in enumerate(CASES)], "doc_id int, text string, lang string")
    got = {r["doc_id"]: r for r in domain.detect_domains(df, domain.profiles(spark), "doc_id").collect()}
    for i, (_, _, want, conf) in enumerate(CASES):
        if want is None:
            assert i not in got
        else:
            assert got[i]["domain"] == want and got[i]["confidence"] == pytest.approx(conf)


def test_history(spark):
    sch = "id string, ts_millis long, original string, lang string"
    now = spark.createDataFrame([(f"p{i}", i, "x", "en") for i in range(60)], sch)
    new = spark.createDataFrame([("p1", 1, "x", "en"), ("n1", 5, "y", "en"), ("n1", 5, "y", "en"), ("", 6, "z", "en"), ("n2", 7, "", "en"), (None, 8, "q", "en")], sch)
    assert H.new_entries(now, new).count() == 2
    m = H.merged(now, new).collect()
    assert len(m) == 50 and [r["id"] for r in m[:3]] == ["n1", "n1", "p59"]
    assert [r["id"] for r in H.newest(now, cap=2).collect()] == ["p59", "p58"]


def test_answers(spark):
    text = "1. First rewrite here\n\n2) short\n3、第二个改写的句子\n  plain sentence  \nabc"
    a = spark.createDataFrame([(1, text)], "id int, answer string")
    assert [r["text"] for r in rewrites.candidate_rows(a, "id").orderBy("pos").collect()] == ["First rewrite here", "第二个改写的句子", "plain sentence"]

    def client(prompt, temperature):
        if prompt == "bad":
            raise ValueError("no")
        return f"{prompt} {temperature}"

    r = {x["id"]: x for x in rewrites.ask(spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, p string"), client, "id", "p").collect()}
    assert r[1]["answer"] == "ok 0.8" and r[2]["error"] == "no"


def test_chinese_documents_are_scored_as_chinese(spark, tmp_path):
    from zipfloom.operators import segment_zh
    from zipfloom.plans import scoring as plans

    text = {1: "财政政策影响经济", 2: "Fiscal policy matters", 3: "财政政策", 4: None}
    spark.createDataFrame([(i, t, "s", None if i == 3 else 7) for i, t in text.items()], "doc_id long, text string, source string, bitext_id long").write.parquet(f"{tmp_path}/documents.parquet")
    n = {"财政": 40, "政策": 30, "影响": 20, "经": 10}
    spark.createDataFrame([("zh", w, k) for w, k in n.items()], "lang string, word string, word_count long").write.parquet(f"{tmp_path}/domain_freq.parquet")
    d, lex = str(tmp_path), {w: math.log10(k / 100 * 1e9) for w, k in n.items()}

    def zipf(w):
        return lex[w] if w in lex else 3.5 if len(w) == 1 else math.prod(lex.get(c, 3.5) for c in w) ** (1 / len(w))

    cut = {i: segment_zh.segment(text[i], lex, {}) for i in (1, 3)}
    pairs = [" ".join(p) for w in cut.values() for p in zip(w, w[1:])]
    weight = {1: 0.5, 2: 1.0, 3: 1.2, 4: 1.3}
    got = {r["doc_id"]: r for r in plans.sentence_measures(spark, d).collect()}
    tokens = [(r["doc_id"], r["token"], r["zipf"]) for r in plans.token_scores(spark, d).orderBy("doc_id", "pos").collect()]
    for i, words in cut.items():
        big = [1.3 if k and math.log10(pairs.count(f"{words[k - 1]} {w}") / len(pairs) * 1e9) > 5 else 1.0 for k, w in enumerate(words)]
        w = [weight.get(len(x), 1.4) * b for x, b in zip(words, big)]
        assert got[i]["score"] == pytest.approx(sum(max(zipf(x), 1.75) * y for x, y in zip(words, w)) / sum(w))
        assert got[i]["n_tokens"] == len(words) > 1
        assert [(t, z) for k, t, z in tokens if k == i] == [(x, pytest.approx(zipf(x))) for x in words]
    assert [t for k, t, _ in tokens if k == 2] == ["Fiscal", "policy", "matters"] and got[4]["n_tokens"] == 0
    h = {r["doc_id"]: r for r in plans.hybrid_score(spark, d).collect()}
    assert h[1]["token_count"] == len(cut[1])
    assert h[1]["hybrid_score"] == pytest.approx(math.prod(zipf(x) for x in cut[1]) ** (1 / len(cut[1])))
    # the batch starts in Chinese, so its English sentence is cut and scored as Chinese too
    r = {x["doc_id"]: x for x in plans.rank_sentences(spark, d).collect()}
    assert len(r) == 4 and r[2]["score"] == pytest.approx((zipf("Fiscal") * 1.4 + 1.4 * zipf("policy") * 1.3 + 1.4 * zipf("matters") * 1.3) / (1.4 * 3.6))
    # a document of no batch in its own language
    assert r[3]["score"] == pytest.approx(got[3]["score"])
