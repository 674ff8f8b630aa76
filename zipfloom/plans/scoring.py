"""Queries of the reference's operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lang as L
from ..functions import scalars as S
from ..functions import text as T
from ..operators import diff, domain, embed, guard, lexicon, ontology, optimize, placeholders, pos, ranking, scoring, segment_zh, slots, verify
from ..operators.names import concept_records
from ..session import Scratch
from ..sources import history as H
from ..sources import requests, rewrites


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "bitext_id")


def _doc_tokens(docs: DataFrame) -> DataFrame:
    return T.token_rows(docs, ["doc_id"], T.words_en(F.col("text")))


def _scored(spark: SparkSession, d: str, docs: DataFrame, name: str, pairs: bool = True, lang: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, token, prev, zipf, bigram, lang) of both languages, stored: what follows reads them more than
    once. lang (doc_id, lang) is the language to score each document in, by default its own."""
    s = Scratch(spark, name)
    if lang is None:
        lang = docs.select("doc_id", L.detect_language(F.coalesce("text", F.lit(""))).alias("lang"))
    docs = docs.select("doc_id", "text")
    # the corpus is read into tokens once; both tables and the look-ups read those
    tokens = s.write(_doc_tokens(docs), "tokens")
    lex = lexicon.freq_table(tokens.select(F.lower("token").alias("token")))
    is_zh = lang.filter("lang = 'zh'").select("doc_id")
    en = scoring.scored_rows(tokens.join(is_zh, "doc_id", "left_anti"), lex, lexicon.bigram_table(tokens) if pairs else None)
    words = docs.join(is_zh, "doc_id", "left_semi").select("doc_id", segment_zh.segmenter(_zh_words(spark, d), {})(F.col("text")).alias("words"))
    cut = s.write(T.token_rows(words, ["doc_id"], F.col("words")), "words")
    zh = scoring.scored_tokens_zh(cut, _zh_lexicon(spark, d), lexicon.bigram_table(cut) if pairs else None)
    return s.write(en.withColumn("lang", F.lit("en")).unionByName(zh.withColumn("lang", F.lit("zh"))), "scored")


def lang_detect(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", L.detect_language(t).alias("l1"), L.is_chinese(t).alias("l2"), L.page_language(t).alias("l3"), L.any_chinese(t).alias("l4"), L.upload_language(t).alias("l5"))


def token_counts(spark, d):
    t = F.col("text")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    full = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return full.select("doc_id", n(T.words_en(t)).alias("k1"), n(T.words_with_offsets(t)).alias("k3"), n(T.clauses_zh(t)).alias("k4"), n(T.corpus_words_en(t)).alias("k5"), n(T.change_words(t)).alias("k7"))


def zipf_table(spark, d):
    return lexicon.freq_table(_doc_tokens(_docs(spark, d))).select("word", "count", "zipf")


def zipf_top_n(spark, d):
    return lexicon.top_n(zipf_table(spark, d), 20)


def domain_tables(spark, d):
    docs = _docs(spark, d)
    return lexicon.domain_tables(docs, "source", L.detect_language(F.coalesce("text", F.lit("")))).select("name", "word", "count", "zipf")


def token_scores(spark, d):
    return scoring.token_scores(_scored(spark, d, _docs(spark, d), "tokens", pairs=False), "doc_id", F.col("lang"))


def sentence_measures(spark, d):
    docs = _docs(spark, d)
    m = scoring.sentence_measures(docs, _scored(spark, d, docs, "measures"), "doc_id", F.col("lang"))
    return scoring.multi_layer(m)


def lowest_tokens(spark, d):
    return ranking.lowest_tokens(token_scores(spark, d), "doc_id", 5)


def rank_sentences(spark, d):
    """A batch is scored in the language of its first sentence that is not empty; documents of no batch each in
    their own."""
    docs = _docs(spark, d)
    own = docs.withColumn("own", L.detect_language(F.coalesce("text", F.lit(""))))
    batch = ranking.batch_language(own, "bitext_id", "text", "own", "doc_id").select(F.col("bitext_id").alias("_b"), "lang")
    lang = own.join(batch.filter("_b is not null"), F.col("bitext_id") == F.col("_b"), "left").select("doc_id", F.coalesce("lang", "own").alias("lang"))
    m = scoring.sentence_measures(docs, _scored(spark, d, docs, "rank", lang=lang), "doc_id", F.col("lang")).withColumn("score", F.round("score", 9))
    s = Scratch(spark, "ranked")
    return ranking.rank_sentences(docs.select("doc_id", "bitext_id").join(m.select("doc_id", "score"), "doc_id"), "bitext_id", "doc_id", write=s.write)


def hybrid_score(spark, d):
    docs = _docs(spark, d)
    tables = lexicon.domain_tables(docs, "source", L.detect_language(F.coalesce("text", F.lit(""))))
    return scoring.hybrid_measures(docs, _scored(spark, d, docs, "hybrid", pairs=False), tables, "doc_id", by="source")


def domain_detect(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs = docs.withColumn("lg", L.detect_language(F.coalesce("text", F.lit(""))))
    return domain.detect_domains(docs, domain.profiles(spark), "doc_id", lang="lg").select("doc_id", "domain", "confidence", F.array_join("matched", "|").alias("matched"))


def onto_closure(spark, d):
    s = Scratch(spark, "closure")
    rec = s.write(concept_records(table(spark, d, "concepts")), "records")
    return ontology.broader_names(rec, s.write)


def _pairs(concepts: DataFrame) -> DataFrame:
    """Every name a concept lists, against the concept: what a rewriter may swap."""
    r = concept_records(concepts)
    names = F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("hypernyms", "hyponyms", "siblings", "aliases")])))
    p = r.select("domain_key", "lang", F.col("text").alias("a"), F.explode(names).alias("b")).filter("b is not null and b <> '' and a is not null")
    return p.select("domain_key", "lang", F.col("a").alias("original"), F.col("b").alias("candidate")).unionByName(p.select("domain_key", "lang", F.col("b").alias("original"), F.col("a").alias("candidate"))).distinct()


def substitution_verdicts(spark, d):
    c = table(spark, d, "concepts")
    return ontology.check_substitutions(c, _pairs(c))


def pos_tags(spark, d):
    w = _doc_tokens(_docs(spark, d)).select("token").distinct()
    return w.select("token", pos.tag_en(F.col("token")).alias("en"))


def slots_en(spark, d):
    docs = table(spark, d, "history").select("id", "original").distinct()
    return slots.slot_rows(docs, "id", slots.slots_en_raw(F.col("original")))


def slots_merged(spark, d):
    docs = table(spark, d, "history").select("id", "original").distinct()
    return slots.slot_rows(docs, "id", _slots(spark, d)(F.col("original")))


def placeholder_slots(spark, d):
    docs = table(spark, d, "history").select("id", "original").distinct()
    return slots.slot_rows(docs, "id", placeholders.placeholders(F.col("original")))


def structural_check(spark, d):
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized"))
    s = slots.slot_rows(h.filter("original is not null"), "id", _slots(spark, d)(F.col("original")))
    return verify.structural_check(s, h.select("id", F.coalesce("optimized", F.lit("")).alias("candidate")))


def guard_rewrites(spark, d):
    """How much of each prompt's slots its rewrite keeps."""
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized")).filter("original is not null")
    # slots cost far more than reading, so rows are spread over all cores however small the files are
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    h = Scratch(spark, "guard").write(h.select("id", "original", "optimized").repartition(parts, "id"), "pairs")
    return guard.judge(h, candidate="optimized", slots=_slots(spark, d))


def _zh_lexicon(spark, d) -> DataFrame:
    """(word, zipf) of all Chinese words of the corpus tables, without the blanks around them."""
    f = table(spark, d, "domain_freq").filter("lang = 'zh' and word_count > 0 and word is not null")
    n = f.groupBy(F.regexp_replace("word", rf"\A[{T.WS}]+|[{T.WS}]+\z", "").alias("word")).agg(F.sum("word_count").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("word", S.corpus_zipf(F.col("n"), F.col("total")).alias("zipf"))


def _zh_words(spark, d) -> segment_zh.Words:
    return segment_zh.shipped_words(_zh_lexicon(spark, d))


def _slots(spark, d):
    """Slots in both languages, Chinese by the corpus dictionary."""
    return slots.Scanner(slots.slots_zh(_zh_words(spark, d), {}))


def segment_chinese(spark, d):
    """Words of the Chinese documents with their places in the list."""
    docs = table(spark, d, "documents").select("doc_id", "text").filter(L.any_chinese(F.col("text")) == "zh")
    cut = docs.select("doc_id", segment_zh.segmenter(_zh_words(spark, d), {})(F.col("text")).alias("words"))
    return cut.select("doc_id", F.posexplode("words").alias("pos", "token"))


def slots_zh(spark, d):
    """Slots of prompts in either language, Chinese ones by the corpus dictionary."""
    docs = table(spark, d, "history").select("id", "original").distinct()
    return slots.slot_rows(docs, "id", _slots(spark, d)(F.col("original")))


def slots_chinese(spark, d):
    """Slots of the Chinese prompts, without placeholders."""
    docs = table(spark, d, "history").select("id", "original").distinct().filter(L.is_chinese(F.coalesce("original", F.lit(""))))
    return slots.slot_rows(docs, "id", slots.slots_zh(_zh_words(spark, d), {})(F.col("original")))


def heuristic_match(spark, d):
    """Similarity of prompt and rewrite, with its band."""
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized"))
    v = h.select("id", embed.text_similarity()(F.coalesce("original", F.lit("")), F.coalesce("optimized", F.lit(""))).alias("s"))
    return v.select("id", F.round("s", 5).alias("similarity"), S.similarity_band(F.col("s")).alias("band"))


def text_hashes(spark, d):
    return table(spark, d, "history").select("id", "original").distinct().select("id", S.string_hash(F.coalesce("original", F.lit(""))).alias("h"))


def cosine_neighbours(spark, d):
    e = table(spark, d, "embeddings")
    return embed.nearest(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0")).select("query", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def history_newest(spark, d):
    h = table(spark, d, "history")
    return H.newest(H.latest_deliveries(h)).select("id", "ts_millis")


def history_import(spark, d):
    """Entries saved late count as an import into those saved in time."""
    h = table(spark, d, "history")
    late = F.col("saved_at").cast("timestamp").cast("double") - F.col("ts_millis") / 1000 > 86400
    return H.new_entries(h.filter(~F.coalesce(late, F.lit(False))), h.filter(late)).select("id", "ts_millis", "original")


def diff_counts(spark, d):
    h = table(spark, d, "history").select("id", "saved_at", "original", "optimized")
    h = H.latest_deliveries(h)
    return h.select("id", diff.op_counts(diff.diff(F.col("original"), F.col("optimized"))).alias("c")).select("id", "c.*")


def optimize_prompts(spark, d):
    """The pipeline over each entry's rewrite read as an answer: its lines are the candidates, scored as the prompt is,
    in the prompt's language, and guarded by the prompt's exact slots."""
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized"))
    h = Scratch(spark, "optimize").write(h.filter("original is not null"), "history")
    # Arrow functions run in a projection of their own, not inside the filter
    exact = slots.slot_rows(h.select("id", _slots(spark, d)(F.col("original")).alias("slots")), "id", F.filter(F.col("slots"), lambda s: S.needs_exact(s["kind"])))
    lines = rewrites.candidate_rows(h.filter("optimized is not null"), "id", "optimized").withColumn("key", F.concat_ws("/", "id", "pos"))
    checks = verify.structural_check(exact.select(F.col("id").alias("_id"), "slot_ord", "kind", "text").join(lines.select(F.col("id").alias("_id"), F.col("key").alias("id")), "_id"), lines.select(F.col("key").alias("id"), F.col("text").alias("candidate")))
    kept = checks.groupBy("id").agg(F.max((F.col("issue") == "missing").cast("int")).alias("bad")).withColumnRenamed("id", "key")
    docs = h.select(F.col("id").alias("doc_id"), F.col("original").alias("text")).unionByName(lines.select(F.col("key").alias("doc_id"), "text"))
    own = h.select("id", L.detect_language(F.col("original")).alias("lang"))
    lang = own.withColumnRenamed("id", "doc_id").unionByName(lines.join(own, "id").select(F.col("key").alias("doc_id"), "lang"))
    m = scoring.sentence_measures(docs, _scored(spark, d, docs, "answers", lang=lang), "doc_id", F.col("lang")).select("doc_id", F.round("score", 9).alias("score"))
    c = lines.join(m.withColumnRenamed("doc_id", "key"), "key").join(kept, "key", "left")
    c = c.select("id", "pos", "text", "score", F.when(F.col("bad") == 1, 0.0).otherwise(1.0).alias("preservation"), (F.coalesce("bad", F.lit(0)) == 0).alias("passes"))
    o = h.select("id", F.col("original").alias("text")).join(m.withColumnRenamed("doc_id", "id"), "id").select("id", "text", "score")
    return optimize.optimize(o, c)


def best_candidates(spark, d):
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized", "original_score", "optimized_score")).filter("original is not null and optimized is not null")
    o = h.select("id", F.col("original").alias("text"), F.coalesce("original_score", F.lit(0.0)).alias("score"))
    c = h.select("id", F.lit(0).alias("pos"), F.col("optimized").alias("text"), F.coalesce("optimized_score", F.lit(0.0)).alias("score"))
    return ranking.rank_candidates(o, c, "id")


def score_bands(spark, d):
    h = table(spark, d, "history").select("id", "original_score", "optimized_score").distinct()
    delta = F.col("optimized_score") - F.col("original_score")
    return h.select("id", S.sentence_band(F.col("optimized_score")).alias("band"), S.word_band(F.col("optimized_score")).alias("word_band"), S.delta_class(delta).alias("delta"), S.ring_share(F.col("optimized_score")).alias("ring"))


def slots_en_merged(spark, d):
    docs = table(spark, d, "history").select("id", "original").distinct()
    return slots.slot_rows(docs, "id", slots.slots_en(F.col("original")))


def verify_slots(spark, d):
    """Each English slot of a prompt against the slot at the same place of its rewrite: 1.0 if it reads the same, 0.8 if
    only its kind is the same."""
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized"))
    mine = slots.slot_rows(h, "id", slots.slots_en_raw(F.col("original")))
    theirs = slots.slot_rows(h, "id", slots.slots_en_raw(F.col("optimized"))).select("id", "slot_ord", F.col("kind").alias("_k"), F.col("text").alias("_t"))
    same = mine.join(theirs, ["id", "slot_ord"]).filter("kind = _k")
    similar = same.select("id", "slot_ord", F.col("_t").alias("text"), F.when(F.col("_t") == F.col("text"), 1.0).otherwise(0.8).alias("similarity"))
    return verify.verify_slots(mine, similar)


def slot_preservation(spark, d):
    """Sums of verify_slots a prompt."""
    return verify.preservation(verify_slots(spark, d)).select("id", F.round("preservation", 9).alias("preservation"), "passes", "total", "kept", "dropped", "bad")


def substitutions_unsafe(spark, d):
    c = table(spark, d, "concepts")
    return ontology.check_substitutions(c, _pairs(c), unsafe_only=True)


def changed_words(spark, d):
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized"))
    return ontology.changed_pairs(h.select("id", "original", F.col("optimized").alias("candidate")))


def lowest_live(spark, d):
    return ranking.lowest_live(token_scores(spark, d), "doc_id", 3).select("doc_id", "pos", "token", "zipf", "rank")


def escaped(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_html(F.col("text")).alias("html"), T.escape_attribute(F.col("source")).alias("attribute"))


def content_words(spark, d):
    w = _doc_tokens(_docs(spark, d)).select("token").distinct()
    return w.select("token", S.is_content(pos.tag_en(F.col("token"))).alias("content"))


def answer_candidates(spark, d):
    """Each rewrite read as a model's answer: its lines without list numbers."""
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "optimized"))
    return rewrites.candidate_rows(h, "id", "optimized")


def low_word_requests(spark, d):
    low = ranking.lowest_tokens(token_scores(spark, d), "doc_id", 6)
    return rewrites.low_word_requests(low.withColumn("zipf", F.round("zipf", 6)), "doc_id")


def replace_requests(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rewrites.replace_requests(docs, low_word_requests(spark, d), "doc_id")


def history_import_count(spark, d):
    h = table(spark, d, "history")
    late = F.col("saved_at").cast("timestamp").cast("double") - F.col("ts_millis") / 1000 > 86400
    return H.import_count(h.filter(~F.coalesce(late, F.lit(False))), h.filter(late))


def slot_kinds(spark, d):
    """Name, threshold and exactness of every kind of slot, on the kinds in use."""
    k = slots_en(spark, d).select("kind").distinct()
    return k.select("kind", S.kind_name(F.col("kind")).alias("name"), S.threshold(F.col("kind")).alias("threshold"), S.needs_exact(F.col("kind")).alias("exact"))


def weights_valid(spark, d):
    """The two scores of an entry and what is left of one as weights."""
    h = table(spark, d, "history").select("id", (F.col("original_score") / 10).alias("a"), (F.col("optimized_score") / 10).alias("b")).distinct()
    return h.select("id", S.weights_valid(F.col("a"), F.col("b"), F.lit(0.2)).alias("valid"))


def _both_texts(h: DataFrame) -> DataFrame:
    """(doc_id, text, id, pos): the original (pos 1) and the rewrite (pos 0) of each entry as documents to score."""
    one = lambda c, pos: h.filter(F.col(c).isNotNull()).select(F.concat(F.col("id"), F.lit(f"/{pos}")).alias("doc_id"), F.col(c).alias("text"), "id", F.lit(pos).alias("pos"))
    return one("optimized", 0).unionByName(one("original", 1))


def score_candidates(spark, d):
    """Layered scores of an entry's rewrite and original, best first; a rewrite that loses an exact English slot (a
    negation) has slot preservation 0."""
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized")).filter("original is not null")
    h = Scratch(spark, "score").write(h, "history")
    docs = _both_texts(h)
    exact = slots.slot_rows(h.select("id", slots.slots_en_raw(F.col("original")).alias("slots")), "id", F.filter(F.col("slots"), lambda s: S.needs_exact(s["kind"])))
    lost = verify.structural_check(exact, h.select("id", F.col("optimized").alias("candidate"))).filter("issue is not null").select(F.concat("id", F.lit("/0")).alias("doc_id"), F.lit(0.0).alias("kept")).distinct()
    m = scoring.sentence_measures(docs, _scored(spark, d, docs, "candidates"), "doc_id", F.col("lang"))
    m = docs.join(m, "doc_id").join(lost, "doc_id", "left")
    return ranking.score_candidates(m, "id", F.coalesce("kept", F.lit(1.0))).select("id", "pos", F.round("final_score", 9).alias("final_score"), "rank")


def json_sentences(spark, d):
    """Texts as JSON arrays of sentences; each text is sent bare too, which is no JSON and adds nothing."""
    docs = table(spark, d, "documents").filter("text is not null")
    r = docs.select("doc_id", F.to_json(F.array("text")).alias("body")).unionByName(docs.select("doc_id", F.col("text").alias("body")))
    return requests.sentences(r, "doc_id")


def json_structure(spark, d):
    h = H.latest_deliveries(table(spark, d, "history").select("id", "saved_at", "original", "optimized"))
    h = h.select("id", "optimized", slots.slots_en_raw(F.col("original")).alias("s"))
    own = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))
    return requests.structure_replies(h.select("id", F.to_json(F.struct(own.alias("original_slots"), F.col("optimized").alias("candidate_text"))).alias("body")))


def json_verify(spark, d):
    v = verify_slots(spark, d)
    given = F.array_sort(F.collect_list(F.struct("slot_ord", "kind", "text", F.struct(F.col("matched").alias("text"), F.col("similarity").alias("similarity")).alias("given"))))  # the slots of one prompt
    r = v.groupBy("id").agg(given.alias("g"))
    body = F.struct(F.transform("g", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))).alias("original_slots"), F.transform("g", lambda x: x["given"]).alias("similarities"))
    return requests.verify_replies(r.select("id", F.to_json(body).alias("body"))).select("id", F.round("preservation", 9).alias("preservation"), "passes")


def json_substitutions(spark, d):
    c = table(spark, d, "concepts")
    r = _pairs(c).select("domain_key", "lang", F.to_json(F.struct("original", "candidate")).alias("body"))
    read = requests.substitution_requests(r.withColumn("id", F.struct("domain_key", "lang"))).select("id.*", "original", "candidate")
    v = ontology.check_substitutions(c, read)
    return v.select("domain_key", "lang", "original", "candidate", requests.substitution_reply(F.col("verdict"), F.col("original").isNotNull()).alias("reply"))


QUERIES = {
    f.__name__: f
    for f in (
        lang_detect, token_counts, zipf_table, zipf_top_n, domain_tables, token_scores, sentence_measures, lowest_tokens, rank_sentences, hybrid_score, domain_detect, onto_closure, substitution_verdicts, pos_tags, slots_en, slots_merged,
        placeholder_slots, structural_check, guard_rewrites, segment_chinese, slots_zh, heuristic_match, text_hashes, cosine_neighbours, history_newest, history_import, diff_counts, optimize_prompts, best_candidates, score_bands,
        slots_en_merged, slots_chinese, verify_slots, slot_preservation, substitutions_unsafe, changed_words, lowest_live, escaped, content_words, answer_candidates, low_word_requests, replace_requests, history_import_count, slot_kinds, weights_valid, score_candidates,
        json_sentences, json_structure, json_verify, json_substitutions,
    )
}
