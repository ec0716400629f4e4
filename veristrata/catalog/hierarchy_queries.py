"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.catalog.tables import table
from veristrata.operators import hierarchy

def _full(spark: SparkSession, d: str) -> DataFrame:
    """Paths as texts, in which a slash within an id is escaped."""
    rows = hierarchy.full_hierarchy(table(spark, d, "record_edges"))
    return rows.withColumn("path", F.array_join(F.transform("path", lambda x: F.replace(x, F.lit("/"), F.lit("\\/"))), "/"))


def _ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Everything above each trace item, and whether it is a top."""
    edges = table(spark, d, "record_edges")
    items = edges.where(F.lower(hierarchy.stripped(F.col("source_kind"))) == "trace").select("run_key", hierarchy.stripped(F.col("source_id")).alias("node_id"))
    return hierarchy.ancestry(edges, items).where("relation = 'parent'").select("run_key", "node_id", "ancestor_id")


QUERIES = {
    "p1_found": lambda spark, d: hierarchy.roots_reached(table(spark, d, "record_edges")),
    "p1_hierarchy": _full,
    "p1_paths": lambda spark, d: _full(spark, d).drop("pre", "last"),
    "p1_descendants": lambda spark, d: hierarchy.descendant_pairs(table(spark, d, "record_edges")),
    "trace_ancestry": _ancestry,
}

_KNOTS = r"""
WITH RECURSIVE e AS (
  SELECT DISTINCT run_key, lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')) AS relation,
         regexp_replace(source_id, '^\s+|\s+$', '', 'g') AS child, regexp_replace(target_id, '^\s+|\s+$', '', 'g') AS parent
  FROM record_edges),
h AS (SELECT * FROM e WHERE relation IN ('derived_from', 'parent') AND length(child) > 0 AND length(parent) > 0),
up AS (
  SELECT run_key, relation, child AS node, parent AS anc FROM h
  UNION
  SELECT up.run_key, up.relation, up.node, h.parent FROM up JOIN h
    ON h.run_key IS NOT DISTINCT FROM up.run_key AND h.relation = up.relation AND h.child = up.anc),
knots AS (
  SELECT a.run_key, a.relation, a.node, min(a.anc) AS name FROM up a JOIN up b
    ON a.run_key IS NOT DISTINCT FROM b.run_key AND a.relation = b.relation AND a.node = b.anc AND a.anc = b.node GROUP BY ALL)"""

_FOREST = (
    _KNOTS
    + r""",
f AS (SELECT run_key, relation, child, min(parent) AS parent FROM h WHERE NOT EXISTS (SELECT 1 FROM knots k WHERE k.run_key IS NOT DISTINCT FROM h.run_key AND k.relation = h.relation AND k.node = h.child) GROUP BY ALL),
n AS (SELECT run_key, relation, child AS node FROM h UNION SELECT run_key, relation, parent FROM h),
t AS (
  SELECT run_key, relation, node, node AS top, 0::bigint AS depth, [node] AS path FROM n
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.run_key IS NOT DISTINCT FROM n.run_key AND f.relation = n.relation AND f.child = n.node)
  UNION ALL
  SELECT f.run_key, f.relation, f.child, t.top, t.depth + 1, list_append(t.path, f.child) FROM t JOIN f ON f.run_key IS NOT DISTINCT FROM t.run_key AND f.relation = t.relation AND f.parent = t.node),
c AS (SELECT run_key, relation, anc, count(*) AS many FROM up GROUP BY ALL),
b AS (SELECT t.run_key, t.relation, a AS node, count(*) AS size FROM t, unnest(t.path) AS u(a) GROUP BY ALL),
whole AS (
  SELECT t.run_key, t.relation, t.node AS node_id, t.top AS top_id, t.depth, array_to_string(list_transform(t.path, lambda x: replace(x, '/', '\/')), '/') AS path,
         row_number() OVER (PARTITION BY t.run_key, t.relation, t.top ORDER BY t.path) - 1 AS pre, b.size, coalesce(c.many, 0) AS descendants, k.name AS cycle_id
  FROM t JOIN b ON b.run_key IS NOT DISTINCT FROM t.run_key AND b.relation = t.relation AND b.node = t.node
  LEFT JOIN c ON c.run_key IS NOT DISTINCT FROM t.run_key AND c.relation = t.relation AND c.anc = t.node
  LEFT JOIN knots k ON k.run_key IS NOT DISTINCT FROM t.run_key AND k.relation = t.relation AND k.node = t.node)
"""
)

ORACLE = {
    "p1_found": _KNOTS
    + """,
tops AS (
  SELECT up.run_key, up.relation, up.node, up.anc AS root FROM up
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.run_key IS NOT DISTINCT FROM up.run_key AND h.relation = up.relation AND h.child = up.anc)
  UNION
  SELECT up.run_key, up.relation, up.node, k.name FROM up JOIN knots k
    ON k.run_key IS NOT DISTINCT FROM up.run_key AND k.relation = up.relation AND k.node = up.anc)
SELECT DISTINCT run_key, relation, node AS node_id, root AS root_id FROM tops
""",
    "p1_descendants": _KNOTS + "SELECT run_key, relation, anc AS ancestor_id, node AS node_id FROM up",
    "p1_paths": _FOREST + "SELECT run_key, relation, node_id, top_id, depth, path, descendants, cycle_id FROM whole",
    "p1_hierarchy": _FOREST + "SELECT run_key, relation, node_id, top_id, depth, path, pre, pre + size - 1 AS last, descendants, cycle_id FROM whole",
    "trace_ancestry": _KNOTS
    + r"""
SELECT run_key, node AS node_id, anc AS ancestor_id FROM up WHERE relation = 'parent' AND EXISTS (
  SELECT 1 FROM record_edges r WHERE r.run_key IS NOT DISTINCT FROM up.run_key AND regexp_replace(r.source_id, '^\s+|\s+$', '', 'g') = up.node AND lower(regexp_replace(r.source_kind, '^\s+|\s+$', '', 'g')) = 'trace')
""",
}
