"""Frequency tables from corpora, and look-ups in them. Dictionaries are tables, never constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T


def freq_table(tokens: DataFrame, word: str = "token", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, word, count, total_tokens, unique_words, zipf) of token rows; null tokens are not counted.

    Counts are added up before the shuffle; totals come from the counted table, not from the tokens.
    """
    w = tokens.filter(F.col(word).isNotNull()).groupBy(*by, F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("count"))
    t = w.groupBy(*by).agg(F.sum("count").alias("total_tokens"), F.count(F.lit(1)).alias("unique_words"))
    w = w.join(t, list(by)) if by else w.crossJoin(F.broadcast(t))  # t is one row
    return w.withColumn("zipf", S.corpus_zipf(F.col("count"), F.col("total_tokens")))


def top_n(table: DataFrame, n: int) -> DataFrame:
    """The n words of most occurrences; ties by word."""
    return table.orderBy(F.desc("count"), F.asc("word")).limit(n)


def unique_words(lexicon: DataFrame, key: str = "word") -> DataFrame:
    """One row a key (the greatest zipf), so that a join never multiplies rows."""
    return lexicon.groupBy(F.col(key).alias(key)).agg(F.max("zipf").alias("zipf"))


def with_zipf(tokens: DataFrame, lexicon: DataFrame, default: float | None = 4.0, fold: bool = True, key: Column | None = None, out: str = "zipf") -> DataFrame:
    """Adds the zipf of each token: left join on the (lower-cased) word, `default` on a miss, null if None."""
    lex = unique_words(lexicon).select(F.col("word").alias("_w"), F.col("zipf").alias(out))
    k = key if key is not None else (F.lower("token") if fold else F.col("token"))
    j = tokens.withColumn("_k", k).join(lex, F.col("_k") == F.col("_w"), "left").drop("_k", "_w")
    return j if default is None else j.withColumn(out, F.coalesce(out, F.lit(float(default))))


def with_bigram(tokens: DataFrame, bigrams: DataFrame, default: float = S.BIGRAM_MISS) -> DataFrame:
    """Adds bigram: the zipf of "prev token", case kept; `default` on a miss, null for the first token."""
    b = bigrams.groupBy(F.col("phrase").alias("_w")).agg(F.max("zipf").alias("bigram"))
    j = tokens.withColumn("_k", F.concat_ws(" ", "prev", "token")).join(b, F.col("_k") == F.col("_w"), "left").drop("_k", "_w")
    return j.withColumn("bigram", F.when(F.col("prev").isNotNull(), F.coalesce("bigram", F.lit(float(default)))))


def with_zipf_zh(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Chinese: the trimmed word; else 3.5 for one character, else the geometric mean of its characters'."""
    lex = unique_words(lexicon)
    t = tokens.withColumn("_id", F.xxhash64("token")).withColumn("_w", F.trim("token"))
    words = t.select("_w").distinct()
    chars = words.select("_w", F.explode(F.filter(F.split("_w", ""), lambda x: x != "")).alias("c"))
    mean = chars.join(lex.select(F.col("word").alias("c"), F.col("zipf").alias("z")), "c", "left").groupBy("_w").agg(F.exp(F.avg(F.ln(F.greatest(F.coalesce("z", F.lit(3.5)), F.lit(0.01))))).alias("_mean"))
    known = words.join(lex.select(F.col("word").alias("_w"), F.col("zipf").alias("_z")), "_w", "left").join(mean, "_w", "left")
    z = known.select("_w", F.coalesce("_z", F.when(F.length("_w") <= 1, 3.5), "_mean", F.lit(3.5)).alias("zipf"))
    return t.join(z, "_w", "left").drop("_w", "_id")


def corpus_tokens(docs: DataFrame, lang: Column, text: str = "text") -> DataFrame:
    """Adds tokens: clauses of Chinese texts, lower-cased words of the others."""
    return docs.withColumn("tokens", F.when(lang == "zh", T.clauses_zh(F.col(text))).otherwise(T.corpus_words_en(F.col(text))))


def domain_tables(docs: DataFrame, name: str, lang: Column, text: str = "text") -> DataFrame:
    """A frequency table for each value of `name` (null names together)."""
    t = corpus_tokens(docs, lang, text).select(F.coalesce(F.col(name), F.lit("")).alias("name"), F.explode("tokens").alias("token"))
    return freq_table(t, by=("name",))


def bigram_table(tokens: DataFrame) -> DataFrame:
    """(phrase, zipf) of neighbouring tokens of a corpus."""
    p = tokens.filter(F.col("prev").isNotNull()).select(F.concat_ws(" ", "prev", "token").alias("token"))
    return freq_table(p).select(F.col("word").alias("phrase"), "zipf")
