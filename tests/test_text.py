"""Language rules, tokenisers and scalar scores against stated values."""

import pytest
from pyspark.sql import functions as F

from zipfloom.functions import lang as L
from zipfloom.functions import scalars as S
from zipfloom.functions import text as T

LANG = [("今天天气很好", "zh"), ("你好世界", "zh"), ("的", "zh"), ("Hello 世界", "en"), ("", "en"), ("   ", "en"), ("The weather is nice today", "en")]


def one(spark, expr, *values, schema="t string"):
    return spark.createDataFrame([values], schema).select(expr.alias("x")).first()["x"]


def test_language_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LANG)], "i int, t string").select("i", L.detect_language(F.col("t")).alias("a"), L.page_language(F.col("t")).alias("b"), L.any_chinese(F.col("t")).alias("c"), L.upload_language(F.col("t")).alias("d"), L.is_chinese(F.col("t")).alias("e"))
    got = {r["i"]: r for r in df.collect()}
    for i, (_, want) in enumerate(LANG):
        assert got[i]["a"] == got[i]["b"] == want
        assert got[i]["e"] == (want == "zh")
    assert got[3]["c"] == got[3]["d"] == "zh"


def test_language_rules_differ_on_wide_forms(spark):
    r = spark.createDataFrame([("ＡＢ cd",)], "t string").select(L.detect_language(F.col("t")).alias("a"), L.is_chinese(F.col("t")).alias("b"), L.page_language(F.col("t")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ("zh", False, "en")


def test_null_text_is_english_or_null(spark):
    assert one(spark, L.any_chinese(F.col("t")), None) == "en"
    assert one(spark, T.words_en(F.col("t")), None) is None


def test_words_en(spark):
    t = F.col("t")
    assert len(one(spark, T.words_en(t), "The quick brown fox jumps over the lazy dog.")) == 9
    assert one(spark, T.words_en(t), "") == []
    assert one(spark, T.words_en(t), "don't snake_case a1 42") == ["don", "t", "snake", "case", "a1"]


def test_words_with_offsets(spark):
    got = one(spark, T.words_with_offsets(F.col("t")), "a1, 42 né")
    assert [(x["token"], x["start"], x["end"]) for x in got] == [("a1", 0, 2), ("42", 4, 6), ("né", 7, 9)]


def test_corpus_tokens(spark):
    t = F.col("t")
    assert one(spark, T.clauses_zh(t), "财政政策，影响（经济）！ok") == ["财政政策", "影响", "经济", "ok"]
    assert one(spark, T.corpus_words_en(t), "Well-known: 42 Things, «é»") == ["well-known", "42", "things"]
    assert one(spark, T.pieces_en(t), "a,  b!") == ["a", ",", "  ", "b", "!"]
    assert one(spark, T.pieces_zh(t), "a世") == ["a", "世"]


def test_long_text(spark):
    t = "word " * 50_000
    assert len(one(spark, T.words_with_offsets(F.col("t")), t)) == 50_000


def test_scores(spark):
    layers = dict(zip(S.WEIGHTS, map(F.lit, (7.0, 0.8, 0.6, 1.0, 0.5))))
    x = F.lit(1)
    got = spark.range(1).select(
        S.layered(layers).alias("layers"), S.complexity(F.lit(5), F.lit(3.0)).alias("short"), S.complexity(F.lit(30), F.lit(8.0)).alias("long"), S.hybrid(F.lit(6.0), F.lit(8.0)).alias("hit"), S.hybrid(F.lit(6.0), F.lit(None).cast("double")).alias("miss"),
        S.corpus_zipf(F.lit(3), F.lit(12)).alias("zipf"), S.string_hash(F.lit("hello")).alias("hash"), S.weights_valid(*map(F.lit, S.WEIGHTS.values())).alias("valid"), S.delta_text(F.lit(0.126)).alias("delta"), x,
    ).first()
    assert got["layers"] == pytest.approx(3.25)
    assert got["short"] > 0.3 > got["long"]
    assert got["hit"] == pytest.approx(6.8) and got["miss"] == 6.0
    assert got["zipf"] == pytest.approx(8.39794, abs=1e-5)
    assert got["hash"] == 99162322 and got["valid"] and got["delta"] == "+0.13"
    assert S.normalized(dict(zip(S.WEIGHTS, (4, 2, 1.5, 1.5, 1))))["frequency"] == pytest.approx(0.4)


def test_cosine(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = spark.range(1).select(S.cosine(a(1, 2), a(1, 2)).alias("same"), S.cosine(a(1, 0), a(0, 1)).alias("right"), S.cosine(a(1, 0), a(-1, 0)).alias("opposite"), S.cosine(a(0, 0), a(1, 0)).alias("zero"), S.cosine(a(1), a(1, 0)).alias("dims")).first()
    assert [round(got[k], 6) for k in ("same", "right", "opposite", "zero", "dims")] == [1, 0, -1, 0, 0]


def test_string_hash_beyond_basic_plane(spark):
    from zipfloom.operators.embed import hash_units, utf16_units

    for t in ("", "a", "世界", "😀x", "x" * 500):
        assert one(spark, S.string_hash(F.col("t")), t) == hash_units(utf16_units(t))
