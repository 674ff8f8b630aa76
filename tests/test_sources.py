"""Files, stores and streams."""

import json
import time

from pyspark.sql import functions as F

import pytest
from zipfloom.sources import corpus, ontologies
from zipfloom.sources import history as H
from zipfloom.streaming import live


def test_ontology_files(spark, tmp_path):
    body = {"domain": "tech", "lang": "en", "concepts": {"a": {"id": "tech:a", "text": "a", "hypernyms": ["b"], "hyponyms": [], "siblings": [], "domain": "tech"}}}
    (tmp_path / "tech_en.json").write_text(json.dumps(body))
    (tmp_path / "general_en.json").write_text(json.dumps({"domain": "general", "lang": "en", "concepts": {"x": {"id": "g:x", "text": "x"}}}))
    (tmp_path / "bad_en.json").write_text("{not json")
    c = ontologies.read_ontologies(spark, str(tmp_path))
    got = {r["id"]: r for r in c.collect()}
    assert set(got) == {"tech:a", "g:x"} and got["tech:a"]["aliases"] == [] and got["tech:a"]["hypernyms"] == ["b"]
    want = spark.createDataFrame([("tech", "en"), ("law", "en"), ("law", "zh")], "domain_key string, lang string")
    used = {(r["domain_key"], r["lang"]): r["used"] for r in ontologies.with_fallback(want, c).collect()}
    assert used == {("tech", "en"): "tech", ("law", "en"): "general", ("law", "zh"): None}


def test_corpus_and_stores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my corpus.v2.txt").write_text("财政\nline two")
    r = corpus.read_corpus(spark, str(tmp_path / "in")).first()
    assert (r["name"], r["lang"], r["text"]) == ("my corpus.v2", "zh", "财政\nline two")
    store = corpus.TableStore(spark, str(tmp_path / "store"))
    assert store.names() == [] and store.load("a") is None
    one = lambda n, w: spark.createDataFrame([(n, w, 1)], "name string, word string, count long")
    store.save(one("a", "x"))
    store.save(one("b", "y"))
    store.save(one("a", "z"))
    assert store.names() == ["a", "b"] and [x["word"] for x in store.load("a").collect()] == ["z"]
    store.delete("a")
    assert store.names() == ["b"]
    path = str(tmp_path / "w")
    assert corpus.load_weights(spark, path)["frequency"] == 0.40
    corpus.save_weights(spark, dict.fromkeys(corpus.WEIGHTS, 0.2), path)
    assert corpus.load_weights(spark, path)["frequency"] == 0.2
    assert json.loads(corpus.defaults(spark).first()["thresholds"])["entity"] == 0.95


def test_history_round_trip(spark, tmp_path):
    h = spark.createDataFrame([("a", 5, "o", "p", 1.0, 2.0, "en")], "id string, ts_millis long, original string, optimized string, optimized_score double, original_score double, lang string")
    H.write_export(h, str(tmp_path / "out"))
    assert H.read_export(spark, str(tmp_path / "out")).collect() == h.collect()


def test_live_scores_keep_the_latest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([("s1", 1, "old"), ("s1", 2, "new"), ("s2", 1, "only")], "session string, generation int, text string")
    rows.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    seen = []
    q = live.live_scores(spark.readStream.schema(rows.schema).json(str(tmp_path / "in")), lambda df: df.withColumn("n", F.length("text")), lambda df, _: seen.extend(df.collect()), "session", "generation", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {(r["session"], r["text"], r["n"]) for r in seen} == {("s1", "new", 3), ("s2", "only", 4)}


def test_windowed_counts(spark, tmp_path):
    src = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 05:00:00", "b")], "ts string, event_type string")
    src.coalesce(1).write.json(str(tmp_path / "e"))
    s = spark.readStream.schema(src.schema).json(str(tmp_path / "e"))
    q = live.windowed_counts(s, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    time.sleep(0.5)
    q.stop()
    assert [(r["event_type"], r["n"]) for r in spark.sql("select * from w").collect()] == [("a", 2)]


def test_malformed_requests_fail_open(spark):
    from zipfloom.sources import requests as R

    bad = ["", "{", "null", "[]", '{"original": 1}', '{"candidates": ["x"]}', None]
    r = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "id int, body string")
    assert R.sentences(r).count() == 0
    originals, candidates = R.optimize_requests(r)
    assert {x["text"] for x in originals.filter("id <> 4").collect()} == {""} and candidates.count() == 0
    assert {x["reply"] for x in R.structure_replies(r).collect()} == {"[]"}
    assert {(x["preservation"], x["passes"]) for x in R.verify_replies(r).collect()} == {(1.0, True)} and R.domain_tokens(r).count() == 0
    read = R.substitution_requests(r).withColumn("reply", R.substitution_reply(F.lit("Allowed"), F.col("candidate").isNotNull()))
    assert {x["reply"] for x in read.collect()} == {'{"verdict":"Unrelated","is_safe":true,"label":"无本体关系"}'}


def test_requests_and_replies(spark):
    from zipfloom.sources import requests as R

    one = lambda b: spark.createDataFrame([("a", b)], "id string, body string")
    assert [tuple(x) for x in R.sentences(one('["x", "y"]')).collect()] == [("a", 0, "x"), ("a", 1, "y")]
    assert R.sentences(one('["x", 3]')).count() == 0
    body = '{"original_slots": [{"kind": "negation", "text": "not"}, {"kind": "object", "text": "map"}], "candidate_text": "a map", "similarities": [{"text": "not", "similarity": 0.1}, {"text": "maps", "similarity": 0.95}]}'
    assert R.structure_replies(one(body)).first()["reply"] == '[{"kind":"negation","text":"not","issue":"missing"}]'
    v = R.verify_replies(one(body)).first()
    assert v["passes"] and v["preservation"] == pytest.approx(0.975)
    strict = body[:-1] + ', "thresholds": {"object": 0.99}}'
    assert not R.verify_replies(one(strict)).first()["passes"]
