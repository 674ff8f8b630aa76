"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import abuse, bpe, langid, packing, pairs, termfreq


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _labelled_history(spark: SparkSession, d: str):
    names, history = table(spark, d, "lang_names"), table(spark, d, "history")
    model = langid.model_of(history, names)
    return langid.with_code(langid.latest(history), names), model


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.findings(langid.identify(*_labelled_history(spark, d), "entries"))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(*_labelled_history(spark, d), "segments")


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(*_labelled_history(spark, d), "entries").select("id", "code", "main_lang", "confidence")


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """What language each entry's label names, null where it names none."""
    return langid.with_code(langid.latest(table(spark, d, "history")), table(spark, d, "lang_names")).select("id", "code")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    entries, model = _labelled_history(spark, d)
    entries = Scratch(spark, "pairs").write(entries.select("id", "original", "optimized"), "entries")
    s = Scratch(spark, "judged")
    first = s.write(pairs.first_pass(entries, model), "first")
    return pairs.settle(first, s.write(pairs.sentence_ends(entries), "ends"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.term_table(table(spark, d, "domain_freq"), table(spark, d, "domain_meta"), Scratch(spark, "terms").write)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.marks(p5_terms(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """The ids turned back into texts."""
    return bpe.texts(p6_ids(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    return packing.checks(p7_containers(spark, d), table(spark, d, "pack_specs"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"), Scratch(spark, "pack").write)


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p7_containers(spark, d), table(spark, d, "pack_specs"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).filter(F.col("score") >= abuse.FLAG).select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_segments, p4_entries, p4_labels, p5_found, p5_terms, p6_ids, p6_text, p7_containers, p7_unused, p7_checks, p8_found, p8_scores, p8_rates)}
_TERMS = """
WITH last AS (
  SELECT table_id, lang, word, max_by(n, (loaded_at, n)) AS n
  FROM (SELECT table_id, lang, word, coalesce(word_count, -1) AS n, loaded_at FROM domain_freq WHERE table_id IS NOT NULL AND word IS NOT NULL AND lang IS NOT NULL) GROUP BY ALL),
folded AS (
  SELECT table_id, lang, trim(lower(translate(nfc_normalize(word), '\u3000ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ', ' abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'))) AS term, n
  FROM last WHERE n > 0),
t AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT table_id) AS n_tables FROM folded WHERE term <> '' GROUP BY ALL),
total AS (SELECT lang, sum(occurrences) AS total FROM t GROUP BY lang),
tables AS (SELECT lang, count(DISTINCT table_id) AS lang_tables FROM domain_meta GROUP BY lang),
term_table AS (
  SELECT lang, term, occurrences, n_tables, greatest(0, least(10, log10(occurrences / total * 1e9))) AS zipf,
    occurrences < 5 AS rare, coalesce(n_tables * 100 >= lang_tables * 40, false) AS common
  FROM t JOIN total USING (lang) LEFT JOIN tables USING (lang))
"""

SQL: dict[str, str] = {
    "p4_labels": r"""WITH h AS (SELECT id, lang FROM history WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY saved_at DESC NULLS LAST, lang DESC NULLS LAST) = 1),
n AS (SELECT regexp_replace(spelling, '^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$', '', 'g') AS spelling, min(lang) AS code FROM lang_names WHERE spelling IS NOT NULL AND lang IS NOT NULL GROUP BY 1)
SELECT id, code FROM h LEFT JOIN n ON n.spelling = regexp_replace(coalesce(h.lang, ''), '^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$', '', 'g')""",
    # ids carry each text whole
    "p6_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    # each document once, nothing above its container's room, nothing split that fits
    "p7_checks": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS pieces_twice, 0 AS overfull, 0 AS needless_splits FROM pack_specs",
    "p5_terms": _TERMS + "SELECT lang, term, occurrences, n_tables, zipf, rare, common FROM term_table",
    "p5_found": _TERMS + "SELECT lang, term, 'rare' AS mark FROM term_table WHERE rare UNION ALL SELECT lang, term, 'common' FROM term_table WHERE common",
}
