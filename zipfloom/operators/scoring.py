"""Sentence scores. One aggregation a sentence; texts without tokens keep their row (0.0 where a mean is empty,
collocation 1.0, complexity 1.0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from .lexicon import with_bigram, with_zipf, with_zipf_zh


def _lang(lang: str | Column) -> Column:
    return F.lit(lang) if isinstance(lang, str) else lang


def scored_tokens(docs: DataFrame, key: str, lexicon: DataFrame, bigrams: DataFrame | None = None, text: str = "text", lang: str = "en", tokens: Column | None = None) -> DataFrame:
    """(key, pos, token, prev, zipf, bigram): zipf raw, before the floor."""
    rows = T.token_rows(docs, [key], tokens if tokens is not None else T.words_en(F.col(text)))
    return scored_rows(rows, lexicon, bigrams, lang)


def scored_rows(rows: DataFrame, lexicon: DataFrame, bigrams: DataFrame | None = None, lang: str = "en") -> DataFrame:
    """As scored_tokens, of token rows that are at hand."""
    t = with_zipf(rows, lexicon, S.DEFAULT_ZIPF[lang], fold=lang == "en")
    return with_bigram(t, bigrams) if bigrams is not None else t.withColumn("bigram", F.lit(None).cast("double"))


def scored_tokens_zh(rows: DataFrame, lexicon: DataFrame, bigrams: DataFrame | None = None) -> DataFrame:
    """As scored_tokens, of the token rows of segmented Chinese texts."""
    t = with_zipf_zh(rows, lexicon)
    return with_bigram(t, bigrams) if bigrams is not None else t.withColumn("bigram", F.lit(None).cast("double"))


def token_scores(scored: DataFrame, key: str, lang: str | Column = "en") -> DataFrame:
    """lang: one language, or the column of scored that names each token's."""
    return scored.select(key, "pos", "token", S.score_floor(F.col("zipf"), _lang(lang)).alias("zipf"))


def sentence_measures(docs: DataFrame, scored: DataFrame, key: str, lang: str | Column = "en") -> DataFrame:
    """(key, score, live_avg, collocation, avg_word_length, n_tokens, complexity), a row for every doc. lang as in
    token_scores."""
    z = S.score_floor(F.col("zipf"), _lang(lang))
    w = S.token_weight(F.col("token"), _lang(lang)) * S.bigram_weight(F.col("pos"), F.col("bigram"))
    m = scored.groupBy(key).agg(
        (F.sum(z * w) / F.sum(w)).alias("score"),
        F.avg(z).alias("live_avg"),
        F.avg(F.when(F.col("prev").isNotNull(), F.when(F.col("bigram") > S.BIGRAM_HIT, 1.0).otherwise(0.0))).alias("collocation"),
        F.avg(F.length("token")).alias("avg_word_length"),
        F.count(F.lit(1)).alias("n_tokens"),
    )
    j = docs.select(key).join(m, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    j = j.select(key, zero("score"), zero("live_avg"), F.coalesce("collocation", F.lit(1.0)).alias("collocation"), zero("avg_word_length"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    return j.withColumn("complexity", S.complexity(F.col("n_tokens"), F.col("avg_word_length")))


def multi_layer(measures: DataFrame, slot_preservation: Column | None = None, domain_relevance: Column | None = None, weights: dict[str, float] = S.WEIGHTS) -> DataFrame:
    layers = {"frequency": F.col("score"), "collocation": F.col("collocation"), "complexity": F.col("complexity"), "slot_preservation": slot_preservation if slot_preservation is not None else F.lit(1.0), "domain_relevance": domain_relevance if domain_relevance is not None else F.lit(0.0)}
    return measures.withColumn("final_score", S.layered(layers, weights))


def hybrid_measures(docs: DataFrame, scored: DataFrame, domain: DataFrame, key: str, by: str | None = None, alpha: float = S.ALPHA, beta: float = S.BETA) -> DataFrame:
    """(key, hybrid_score, token_count, domain_coverage): geometric mean of blended raw scores, unweighted.

    domain: (word, zipf), or (name, word, zipf) with `by` the doc column that names its table. Words match with
    case. Texts without tokens score 0.
    """
    d = domain.select(*(["name"] if by else []), F.col("word").alias("_w"), F.col("zipf").alias("_d"))
    on = F.col("token") == F.col("_w")
    if by:
        scored = scored.join(docs.select(key, F.coalesce(F.col(by), F.lit("")).alias("_by")), key)
        on = on & (F.col("_by") == F.col("name"))
    m = scored.join(d, on, "left").groupBy(key).agg(
        F.exp(F.avg(F.ln(S.hybrid(F.col("zipf"), F.col("_d"), alpha, beta) + 1e-12))).alias("hybrid_score"), F.count(F.lit(1)).alias("token_count"), (F.count("_d") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("domain_coverage")
    )
    j = docs.select(key).join(m, key, "left")
    return j.select(key, F.coalesce("hybrid_score", F.lit(0.0)).alias("hybrid_score"), F.coalesce("token_count", F.lit(0)).alias("token_count"), F.coalesce("domain_coverage", F.lit(0.0)).alias("domain_coverage"))
