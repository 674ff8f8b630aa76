"""Hierarchies, orphan references and substitution checks against brute force on small graphs."""

import datetime as dt
import random

import pytest

from zipfloom.operators import ontology, orphans
from zipfloom.operators.names import concept_records
from zipfloom.operators.tree import Hierarchy, concept_hierarchy

LIST = "array<string>"
CONCEPT = f"id string, text string, hypernyms {LIST}, hyponyms {LIST}, siblings {LIST}, domain_key string, aliases {LIST}, lang string, created_at timestamp, deleted_at timestamp, name string, depth int"
ALIAS = "alias_id string, alias string, concept string, domain_key string, lang string, added_at timestamp, kind string"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def concept(i, up=(), down=(), sib=(), ali=(), text=None, made=0, gone=None, key="k", lang="en"):
    return (i, text or f"t{i}", None if up is None else list(up), None if down is None else list(down), list(sib), key, list(ali), lang, day(made), day(gone), "clash", 9)


def frame(spark, rows):
    return spark.createDataFrame(rows, CONCEPT)


def closure(edges):
    reach = {}
    nodes = {x for e in edges for x in e}
    for s in nodes:
        seen, todo = set(), [s]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in seen:
                    seen.add(b)
                    todo.insert(0, b)
            todo.pop()
        reach[s] = seen
    return reach


# one task and ten hops a job; several tasks, one hop a job, parents of more than two children salted
@pytest.mark.parametrize("seed, size", [(1, {}), (2, {}), (2, {"rows": 9, "hot": 2}), (3, {"rows": 20, "hot": 1})])
def test_hierarchy_against_brute_force(spark, seed, size):
    rng = random.Random(seed)
    n = 24
    edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(26)}
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string")
    h = Hierarchy(spark, nodes, spark.createDataFrame(sorted(edges), "parent string, child string"), **size)
    reach = closure(edges)
    assert {r["id"] for r in h.cyclic.collect()} == {x for x in reach if x in reach[x]}
    comp = {r["id"]: r["component"] for r in h.cyclic.collect()}
    for x, c in comp.items():
        assert c == min(y for y in comp if y == x or (y in reach[x] and x in reach[y]))
    roots = {f"n{i}" for i in range(n)} - {b for _, b in edges}
    dist = {r: 0 for r in roots}
    todo = sorted(roots)
    while todo:
        x = todo.pop(0)
        for a, b in edges:
            if a == x and b not in dist:
                dist[b] = dist[x] + 1
                todo.append(b)
    tree = {r["id"]: r for r in h.tree().collect()}
    assert len(tree) == n
    for x, r in tree.items():
        assert r["depth"] == dist.get(x)
        if r["path"] is not None:
            assert r["path"][0] == r["root"] in roots and r["path"][-1] == x and len(r["path"]) == r["depth"] + 1
            assert all(e in edges for e in zip(r["path"], r["path"][1:]))
    want = {(comp.get(a, a), comp.get(b, b)) for a in reach for b in reach[a] if comp.get(a, a) != comp.get(b, b)}
    got = [(r["ancestor"], r["descendant"]) for r in h.descendants().collect()]
    assert sorted(got) == sorted(want)


def test_links_by_text_and_alias_from_either_end(spark):
    rows = [concept("a", down=["tb", None, ""]), concept("b", up=["A1"]), concept("a2", ali=["A1"]), concept("c", up=["tc"]), concept("d", up=["te"]), concept("e", up=["td"], gone=5), concept("f", up=None, down=None), concept("a", down=["tb", None, ""]), concept("x", up=["ta"], key="other")]
    h = concept_hierarchy(frame(spark, rows))
    assert {r["id"] for r in h.cyclic.collect()} == {"c"}
    t = {r["id"]: r for r in h.tree().collect()}
    assert set(t) == {"a", "b", "a2", "c", "d", "f", "x"}
    assert t["b"]["path"] == ["a", "b"] and t["x"]["depth"] == 0 and t["c"]["path"] is None


def test_empty_concepts(spark):
    h = concept_hierarchy(frame(spark, []))
    assert h.cyclic.count() == h.tree().count() == h.descendants().count() == 0


def test_long_chain_and_cycle(spark):
    e = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(30)] + [(f"r{i:02d}", f"r{(i + 1) % 20:02d}") for i in range(20)] + [("c005", "r00")]
    h = Hierarchy(spark, spark.createDataFrame([(x,) for x in sorted({y for p in e for y in p})], "id string"), spark.createDataFrame(e, "parent string, child string"))
    t = {r["id"]: r for r in h.tree().collect()}
    assert t["c030"]["depth"] == 30 and t["r19"]["depth"] == 25 and {x for x in t if t[x]["on_cycle"]} == {f"r{i:02d}" for i in range(20)}


CONCEPTS = [
    concept("a", down=["tb", "gone", "nobody", "late", None, "", "nobody"], sib=["B1"], made=10), concept("b", ali=["B1", "late"], made=1), concept("g", text="gone", made=1, gone=50), concept("l", text="late", made=30), concept("dead", down=["nobody"], gone=20),
    concept("n", down=["tb"], made=None),
]
ALIASES = [("1", "x", "tb", "k", "en", day(5), "c"), ("1", "x", "tb", "k", "en", day(5), "c"), ("2", "y", "gone", "k", "en", day(1), "c"), ("3", "z", "late", "k", "en", day(40), "c"), ("4", "w", "tb", "zz", "en", day(40), "c"), ("5", "w", None, "k", "en", day(40), "c"), ("6", "v", "tb", "k", "en", day(0), "c"), ("7", "v", "tb", "k", "en", None, "c")]
WANT = {("concepts", "a", "hyponyms", "gone", "deleted"), ("concepts", "a", "hyponyms", "nobody", "missing"), ("concepts", "a", "hyponyms", "late", "late"), ("aliases", "2", "concept", "gone", "deleted"), ("aliases", "4", "concept", "tb", "missing"), ("aliases", "6", "concept", "tb", "late")}


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_orphans_do_not_depend_on_batches(spark, batches):
    s = orphans.replay(frame(spark, CONCEPTS), spark.createDataFrame(ALIASES, ALIAS), batches)
    got = [(r["ref_table"], r["ref_id"], r["ref_field"], r["ref_value"], r["kind"]) for r in s.orphans().collect()]
    assert sorted(got) == sorted(WANT)
    counts = {(r["ref_table"], r["month"], r["kind"]): r["n_orphans"] for r in s.counts().collect()}
    assert counts[("concepts", "2024-01", "missing")] == 1 and sum(counts.values()) == len(WANT)


def test_orphans_arrive_and_reopen(spark):
    s = orphans.OrphanState(spark)
    none = spark.createDataFrame([], ALIAS)
    kinds = lambda: {r["ref_value"]: r["kind"] for r in s.orphans().collect()}
    s.update(frame(spark, [concept("a", down=["tb", "tc"], made=5)]), none)
    assert kinds() == {"tb": "missing", "tc": "missing"}
    s.update(frame(spark, [concept("b", made=1), concept("c", made=9)]), none)
    assert kinds() == {"tc": "late"}
    s.update(frame(spark, [concept("b", made=1, gone=20)]), none)
    assert kinds() == {"tb": "deleted", "tc": "late"}
    s.update(frame(spark, [concept("a", down=["tb"], made=5, gone=30)]), none)
    assert kinds() == {}


DELIVERIES = [
    ([concept("a", down=["ghost"], made=5, gone=8)], []), ([concept("a", down=["ghost"], made=5)], []), ([concept("x", ali=["ghost"], made=9)], []), ([], [("1", "z", "ghost", "k", "en", day(7), "c")]),
]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_orphans_do_not_depend_on_the_order(spark, order):
    """A record deleted and delivered again, in any order of batches, leaves the references of the others."""
    s = orphans.OrphanState(spark, buckets=3)
    for i in order:
        s.update(frame(spark, DELIVERIES[i][0]), spark.createDataFrame(DELIVERIES[i][1], ALIAS))
    assert [(r["ref_table"], r["ref_value"], r["kind"]) for r in s.orphans().collect()] == [("aliases", "ghost", "late")]
    assert [(r["ref_table"], r["month"], r["kind"], r["n_orphans"]) for r in s.counts().collect()] == [("aliases", "2024-01", "late", 1)]


def test_orphan_state_goes_on_merges_and_appends_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(orphans, "FAN", 3)
    path, none = f"file://{tmp_path}/state", spark.createDataFrame([], ALIAS)
    s = orphans.OrphanState(spark, path, buckets=4)
    s.update(frame(spark, [concept(f"p{i}", down=[f"t{i}", f"no{i}"], made=5) for i in range(40)]), none)
    for i in range(5):
        s = orphans.OrphanState(spark, path)  # another driver
        s.update(frame(spark, [concept(f"q{i}", text=f"no{i}", made=1)]), none)
        assert s._read("refs").filter(f"v = {s.at['batch']}").count() <= 1  # what changed, not what there is
    assert all(len(x) < 6 for x in s.at["segments"].values())
    assert s.orphans().count() == 75 and {r["kind"] for r in s.orphans().collect()} == {"missing"}
    last = {r["batch"]: r["n_orphans"] for r in s.snapshots().collect()}
    assert sorted(last.values(), reverse=True) == [80, 79, 78, 77, 76, 75]


def test_orphan_stream_restarts(spark, tmp_path):
    from zipfloom.streaming.live import orphan_stream

    at = lambda x: f"file://{tmp_path}/{x}"

    def run():
        streams = orphan_stream(spark.readStream.schema(CONCEPT).parquet(at("c")), spark.readStream.schema(ALIAS).parquet(at("a")), at("state"), at("checkpoint"))
        for q in streams:
            q.awaitTermination()
        return sorted((r["ref_id"], r["kind"]) for r in orphans.OrphanState(spark, at("state")).orphans().collect())

    frame(spark, [concept("a", down=["tb", "tc"], made=5)]).write.parquet(at("c"))
    spark.createDataFrame([("1", "x", "tz", "k", "en", day(5), "c")], ALIAS).write.parquet(at("a"))
    assert run() == [("1", "missing"), ("a", "missing"), ("a", "missing")]
    frame(spark, [concept("b", made=1), concept("z", made=9)]).write.mode("append").parquet(at("c"))
    assert run() == [("1", "late"), ("a", "missing")]
    assert run() == [("1", "late"), ("a", "missing")]


def test_orphans_of_empty_tables(spark):
    s = orphans.replay(frame(spark, []), spark.createDataFrame([], ALIAS))
    assert s.orphans().count() == s.counts().count() == 0


def c(text, up=(), sib=(), ali=(), key="f"):
    return (text, text, list(up), [], list(sib), key, list(ali), "zh", None, None, "x", 1)


ONTO = [c("财政政策", sib=["货币政策"], ali=["财政举措"]), c("税收政策", up=["财政政策"], ali=["税制"]), c("国税政策", up=["税收政策"]), c("货币政策"), c("说明"), c("环甲", up=["环乙"]), c("环乙", up=["环甲"])]
VERDICTS = [("财政政策", "财政政策", "Allowed"), ("财政政策", "财政举措", "Allowed"), ("财政政策", "税收政策", "Narrowing"), ("财政政策", "国税政策", "Narrowing"), ("税收政策", "财政政策", "Widening"), ("财政政策", "货币政策", "CrossBranch"), ("财政政策", "说明", "Unrelated"), ("财政举措", "税收政策", "Unrelated"), ("财政政策", "税制", "Narrowing"), ("环甲", "环乙", "Narrowing"), ("没有", "说明", "Unrelated")]


def test_substitutions(spark):
    df = spark.createDataFrame(ONTO, CONCEPT)
    pairs = spark.createDataFrame([("f", "zh", a, b) for a, b, _ in VERDICTS], "domain_key string, lang string, original string, candidate string")
    got = {(r["original"], r["candidate"]): (r["verdict"], r["safe"]) for r in ontology.check_substitutions(df, pairs).collect()}
    assert got == {(a, b): (v, v in ("Allowed", "Widening", "Unrelated")) for a, b, v in VERDICTS}
    assert ontology.check_substitutions(df, pairs, unsafe_only=True).count() == sum(v in ("Narrowing", "CrossBranch") for _, _, v in VERDICTS)


def test_changed_pairs(spark):
    t = spark.createDataFrame([(1, "财政 政策，好", "税收 政策"), (2, "a b", "a b"), (3, None, "x")], "id int, original string, candidate string")
    assert [tuple(r) for r in ontology.changed_pairs(t).collect()] == [(1, "财政", "税收")]


def test_records_are_deterministic(spark):
    rows = [concept("a", made=1), concept("a", text="later", made=2), concept("a", made=1)]
    assert concept_records(frame(spark, rows)).first()["text"] == "later"
