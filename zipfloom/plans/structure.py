"""Queries of problems 1 and 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import replay
from ..operators.tree import concept_hierarchy


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return concept_hierarchy(table(spark, d, "concepts")).cyclic.select("id")


def p1_tree(spark: SparkSession, d: str) -> DataFrame:
    t = concept_hierarchy(table(spark, d, "concepts")).tree()
    return t.select("id", F.array_join("path", "/").alias("path"), "depth", "root", "on_cycle", "component")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return concept_hierarchy(table(spark, d, "concepts")).descendants()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(table(spark, d, "concepts"), table(spark, d, "aliases")).orphans().select("ref_table", "ref_id", "ref_field", "ref_value", "kind").distinct()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return replay(table(spark, d, "concepts"), table(spark, d, "aliases")).counts()


QUERIES = {f.__name__: f for f in (p1_found, p1_tree, p1_descendants, p2_found, p2_counts)}

_EDGES = """
WITH RECURSIVE rec AS (SELECT DISTINCT * FROM concepts WHERE id IS NOT NULL),
alias_of AS (SELECT domain_key, lang, name, min(id) AS id FROM (SELECT domain_key, lang, id, unnest(aliases) AS name FROM rec) WHERE name <> '' GROUP BY ALL),
named AS (
  SELECT domain_key, lang, text AS name, id FROM rec WHERE text <> ''
  UNION ALL
  SELECT a.domain_key, a.lang, a.name, a.id FROM alias_of a
  WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.domain_key = a.domain_key AND r.lang = a.lang AND r.text = a.name)),
target AS (SELECT n.*, r.created_at, r.deleted_at FROM named n JOIN rec r USING (id)),
refs AS (
  SELECT id, domain_key, lang, true AS up, unnest(hypernyms) AS name FROM rec WHERE deleted_at IS NULL
  UNION ALL SELECT id, domain_key, lang, false, unnest(hyponyms) FROM rec WHERE deleted_at IS NULL),
edges AS (
  SELECT DISTINCT CASE WHEN up THEN t.id ELSE r.id END AS parent, CASE WHEN up THEN r.id ELSE t.id END AS child
  FROM refs r JOIN target t ON t.domain_key = r.domain_key AND t.lang = r.lang AND t.name = r.name
  WHERE t.deleted_at IS NULL)
"""

_ORPHANS = """
WITH rec AS (SELECT DISTINCT * FROM concepts WHERE id IS NOT NULL),
alias_of AS (SELECT domain_key, lang, name, min(id) AS id FROM (SELECT domain_key, lang, id, unnest(aliases) AS name FROM rec) WHERE name <> '' GROUP BY ALL),
refs AS (
  SELECT DISTINCT 'concepts' AS ref_table, id AS ref_id, 'hyponyms' AS ref_field, unnest(hyponyms) AS ref_value, domain_key, lang, created_at AS ref_time FROM rec WHERE deleted_at IS NULL
  UNION SELECT 'concepts', id, 'siblings', unnest(siblings), domain_key, lang, created_at FROM rec WHERE deleted_at IS NULL
  UNION SELECT 'aliases', alias_id, 'concept', concept, domain_key, lang, added_at FROM aliases),
judged AS (
  SELECT r.*, CASE WHEN coalesce(t.id, u.id) IS NULL THEN 'missing'
    WHEN CASE WHEN t.id IS NOT NULL THEN t.deleted_at ELSE u.deleted_at END IS NOT NULL THEN 'deleted'
    WHEN CASE WHEN t.id IS NOT NULL THEN t.created_at ELSE u.created_at END > r.ref_time THEN 'late' END AS kind
  FROM refs r LEFT JOIN rec t ON t.domain_key = r.domain_key AND t.lang = r.lang AND t.text = r.ref_value
  LEFT JOIN alias_of a ON a.domain_key = r.domain_key AND a.lang = r.lang AND a.name = r.ref_value
  LEFT JOIN rec u ON u.id = a.id
  WHERE r.ref_value <> '')
"""

SQL = {
    "p1_found": _EDGES + ", walk AS (SELECT parent AS a, child AS b FROM edges UNION SELECT w.a, e.child FROM walk w JOIN edges e ON e.parent = w.b) SELECT DISTINCT a AS id FROM walk WHERE a = b",
    "p1_descendants": _EDGES
    + """, walk AS (SELECT parent AS a, child AS b FROM edges UNION SELECT w.a, e.child FROM walk w JOIN edges e ON e.parent = w.b),
comp AS (SELECT w.a AS id, min(w.b) AS component FROM walk w JOIN walk v ON v.a = w.b AND v.b = w.a GROUP BY 1)
SELECT DISTINCT coalesce(c.component, w.a) AS ancestor, coalesce(d.component, w.b) AS descendant
FROM walk w LEFT JOIN comp c ON c.id = w.a LEFT JOIN comp d ON d.id = w.b WHERE coalesce(c.component, w.a) <> coalesce(d.component, w.b)""",
    # every way from a root that meets no node twice, of which the shortest and then least is taken
    "p1_tree": _EDGES
    + """, walk AS (SELECT parent AS a, child AS b FROM edges UNION SELECT w.a, e.child FROM walk w JOIN edges e ON e.parent = w.b),
comp AS (SELECT a AS id, least(a, min(b)) AS component FROM (SELECT w.a, w.b FROM walk w JOIN walk v ON v.a = w.b AND v.b = w.a) GROUP BY 1),
ways AS (
  SELECT id, [id] AS way FROM rec WHERE deleted_at IS NULL AND id NOT IN (SELECT child FROM edges)
  UNION ALL SELECT e.child, list_append(w.way, e.child) FROM ways w JOIN edges e ON e.parent = w.id WHERE NOT list_contains(w.way, e.child)),
best AS (SELECT id, arg_min(way, (len(way), way)) AS way FROM ways GROUP BY id)
SELECT r.id, array_to_string(way, '/') AS path, CAST(len(way) - 1 AS INT) AS depth, way[1] AS root, component IS NOT NULL AS on_cycle, component
FROM (SELECT DISTINCT id FROM rec WHERE deleted_at IS NULL) r LEFT JOIN best USING (id) LEFT JOIN comp USING (id)""",
    "p2_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_id, ref_field, ref_value, kind FROM judged WHERE kind IS NOT NULL",
    "p2_counts": _ORPHANS + "SELECT ref_table, strftime(ref_time, '%Y-%m') AS month, kind, count(*) AS n_orphans FROM judged WHERE kind IS NOT NULL GROUP BY ALL",
}
