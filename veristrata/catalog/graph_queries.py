"""Works, citations and record edges over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.catalog.hierarchy_queries import ORACLE as HIERARCHY
from veristrata.catalog.search_queries import HOSTS
from veristrata.catalog.tables import table
from veristrata.operators import graph
from veristrata.plans.lineage import cut
from veristrata.sources import providers


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parsed = cut(graph.parsed_observations(table(spark, d, "observations"), HOSTS))
    return parsed, cut(graph.alias_works(parsed))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parsed, names = _parsed(spark, d)
    return parsed, names, cut(graph.citation_edges(parsed, names, HOSTS))


def _project(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.distinct_edges(_edges(spark, d)[2])
    return edges.select("run_key", "source_work", "target_work", "relation", "provider", "resolution")


def _resolution(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)[2].groupBy("resolution", "provider").agg(F.count("*").alias("items"), F.count_distinct("edge_id").alias("edges"))


def _bfs(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.distinct_edges(_edges(spark, d)[2]).withColumn("edge_id", F.concat_ws("|", "source_work", "target_work", "relation")).select("edge_id", "source_work", "target_work").distinct()
    edges = cut(edges)
    start = edges.agg(F.min("source_work")).first()[0]
    taken, _, cut_off = graph.traverse(edges, [start] if start else [], depth=2, limit=1000)
    return taken.select("edge_id", "level", F.lit(cut_off).alias("truncated"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    """Ledger-like edges of one kind of record: the merged evidence of typed edges."""
    merged = graph.merged_record_edges(table(spark, d, "record_edges"))
    return merged.select("run_key", "source_kind", "source_id", "target_kind", "target_id", "relation", F.array_join("evidence", "|").alias("evidence"), "synced_at", "rows")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges of ledger tables that are made of the relational tables: a source for each nation, a claim for each customer."""
    region, nation, customer = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    tables = {
        "questions": region.select(name("Q", "r_regionkey").alias("id"), F.array(F.concat(F.lit("C"), F.col("r_regionkey") + 1)).alias("claim_ids")),
        "sources": nation.select(name("S", "n_nationkey").alias("id"), F.array(F.concat(F.lit("S"), F.floor(F.col("n_nationkey") / 2))).alias("derived_from")),
        "claims": customer.select(name("C", "c_custkey").alias("id"), F.array(F.concat(F.lit("Q"), F.col("c_custkey") % 7)).alias("question_ids"), F.array(F.struct(name("S", "c_nationkey").alias("source_id"), F.when(F.col("c_acctbal") > 0, "supports").alias("relation"))).alias("evidence")),
        "trace": nation.select(name("T", "n_nationkey").alias("id"), F.array(name("Q", "n_regionkey"), F.concat(F.lit("C"), F.col("n_nationkey") + 1), F.lit("X")).alias("parent_ids")),
    }
    return graph.typed_edges(tables).select("source_kind", "source_id", "target_kind", "target_id", "relation", "known")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of responses of three providers that are rebuilt from the observations."""
    rows = table(spark, d, "observations").withColumn("v", F.try_parse_json("payload")).where("v IS NOT NULL")
    got = rows.select(F.lower(F.trim("provider")).alias("p"), *[F.expr(f"try_variant_get(v, '$.{n}', 'string')").alias(n) for n in ("provider_id", "doi", "title", "published")])
    body = lambda f, path: F.to_json(F.struct(F.struct(F.array(f).alias(path[1])).alias(path[0]))) if len(path) == 2 else F.to_json(F.struct(F.array(f).alias(path[0])))
    cross = got.where("p = 'crossref'").select(body(F.struct(F.col("doi").alias("DOI"), F.array("title").alias("title")), ("message", "items")).alias("body"))
    alex = got.where("p = 'openalex'").select(body(F.struct(F.col("provider_id").alias("id"), "doi", "title", F.col("published").alias("publication_date")), ("results",)).alias("body"))
    two = F.split("provider_id", ":")
    epmc = got.where("p = 'europepmc'").select(body(F.struct(F.get(two, F.lit(0)).alias("source"), F.get(two, F.lit(1)).alias("id"), "doi", "title", F.col("published").alias("firstPublicationDate")), ("resultList", "result")).alias("body"))
    return providers.all_candidates(providers.crossref(cross, HOSTS), providers.openalex(alex, HOSTS), providers.europepmc(epmc, HOSTS))


def _open_copies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("url IS NOT NULL")
    one = docs.select(F.col("doc_id").alias("rank"), F.to_json(F.struct(F.array(F.struct(F.concat("url", F.lit(".pdf")).alias("url_for_pdf"), F.substring_index("url", "/", 3).alias("url_for_landing_page"), F.lit("v1").alias("version"))).alias("oa_locations"))).alias("body"))
    code = F.when(F.col("source") == "openalex", "OA").otherwise("S")
    two = docs.select(F.col("doc_id").alias("rank"), F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.substring_index("url", "/", 4).alias("url"), code.alias("availabilityCode"))).alias("fullTextUrl")).alias("fullTextUrlList"))).alias("result")).alias("resultList"))).alias("body"))
    return providers.open_copies(one, two)


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lookups of works: an attempt for each document, candidates where it was read in full."""
    docs = table(spark, d, "documents").where("work_key IS NOT NULL").withColumn("read", F.get_json_object("metadata", "$.status"))
    attempts = docs.select("work_key", F.when(F.col("read") == "metadata", "blocked").otherwise("ok").alias("status"))
    return providers.lookup_status(attempts, docs.where("read = 'full'").select("work_key"), "work_key")


_LATEST = "o AS (SELECT run_key, candidate_id, r.* FROM (SELECT run_key, candidate_id, arg_max({'provider': provider, 'payload': payload}, {'a': observed_at, 'p': payload}) AS r FROM observations WHERE candidate_id IS NOT NULL GROUP BY ALL))"
_DOI = r"(CASE WHEN regexp_full_match(regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^(doi:\s*|https?://(doi\.example|dx\.doi\.example)/)', '', 'i'), '10\.\d{{4,9}}/\S+') THEN lower(regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^(doi:\s*|https?://(doi\.example|dx\.doi\.example)/)', '', 'i')) END)"
_ALEX = r"(CASE WHEN regexp_full_match(string_split(regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '/+$', ''), '/')[-1], '[wW]\d+') THEN 'openalex:' || upper(string_split(regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '/+$', ''), '/')[-1]) END)"
_NAMES = f"""
RECURSIVE {_LATEST},
v AS (SELECT run_key, candidate_id, lower(trim(provider)) AS provider, payload, json_extract_string(payload, '$.provider_id') AS pid, json_extract_string(payload, '$.doi') AS rawdoi, json_extract_string(payload, '$.title') AS title FROM o WHERE json_valid(payload)),
p AS (SELECT *, {_DOI.format("rawdoi")} AS doi FROM v),
n AS (SELECT run_key, candidate_id, unnest(list_distinct(list_filter([provider || ':' || regexp_replace(pid, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), 'doi:' || doi, {_ALEX.format("pid")}], lambda x: x IS NOT NULL))) AS alias FROM p),
f AS (SELECT run_key, candidate_id, min(alias) AS first FROM n GROUP BY ALL),
l AS (SELECT DISTINCT n.alias AS a, f.first AS b FROM n JOIN f ON n.run_key IS NOT DISTINCT FROM f.run_key AND n.candidate_id = f.candidate_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS id, a AS to_ FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.to_),
names AS (SELECT id AS alias, arg_min(to_, {{'r': CASE WHEN to_ LIKE 'doi:%' THEN 0 WHEN to_ LIKE 'openalex:%' THEN 1 ELSE 2 END, 'a': to_}}) AS work_key FROM reach GROUP BY id)
"""
_CITES = f"""{_NAMES},
w AS (SELECT f.run_key, f.candidate_id, names.work_key FROM f JOIN names ON names.alias = f.first),
x AS (SELECT p.run_key, p.candidate_id, p.provider, unnest(json_extract(p.payload, '$.references[*]')) AS ev FROM p),
t AS (SELECT x.*, CASE WHEN json_type(ev) = 'OBJECT' THEN coalesce(nullif(json_extract_string(ev, '$.DOI'), ''), nullif(json_extract_string(ev, '$.doi'), ''), nullif(json_extract_string(ev, '$.id'), '')) WHEN json_type(ev) = 'VARCHAR' THEN json_extract_string(ev, '$') END AS target FROM x),
a AS (SELECT t.*, coalesce('doi:' || {_DOI.format("target")}, {_ALEX.format("target")}) AS alias FROM t),
c AS (SELECT a.run_key, w.work_key AS source_work, coalesce(names.work_key, a.alias, 'unresolved:' || substr(sha256(a.ev::varchar), 1, 24)) AS target_work, 'references' AS relation, a.provider, a.ev::varchar AS evidence,
  CASE WHEN names.work_key IS NOT NULL THEN 'resolved_local' WHEN a.alias IS NOT NULL THEN 'external_identifier' ELSE 'unresolved_metadata' END AS resolution, coalesce(json_type(ev) NOT IN ('OBJECT', 'VARCHAR'), true) AS malformed
  FROM a JOIN w ON w.run_key IS NOT DISTINCT FROM a.run_key AND w.candidate_id = a.candidate_id LEFT JOIN names ON names.alias = a.alias)
"""

QUERIES = {
    "alias_components": lambda s, d: _parsed(s, d)[1],
    "citation_project": _project,
    "citation_audit": lambda s, d: graph.citation_audit(_edges(s, d)[2]),
    "citation_resolution": _resolution,
    "citation_works": lambda s, d: graph.works(*_edges(s, d)).select("work_key", "title", "doi", F.array_join("providers", ",").alias("providers"), "observations", "external"),
    "graph_bfs": _bfs,
    "record_edges_typed": _typed,
    "record_edges_merged": _latest,
    "provenance_roots": lambda s, d: graph.provenance_roots(table(s, d, "record_edges")),
    "provider_candidates": lambda s, d: _candidates(s, d).select("candidate_id", "work_key", "provider", "provider_id", "doi", "title", "published").distinct(),
    "work_dedupe": lambda s, d: providers.independent_works(_candidates(s, d)),
    "resolver_candidates": _open_copies,
    "lookup_status": _lookup,
    "candidate_page": lambda s, d: providers.next_page(_candidates(s, d).select("candidate_id").distinct(), "candidate_id", "P-8", 50),
}

_CANDS = rf"""
v AS (SELECT lower(trim(provider)) AS p, json_extract_string(payload, '$.provider_id') AS pid, json_extract_string(payload, '$.doi') AS rd, json_extract_string(payload, '$.title') AS title, json_extract_string(payload, '$.published') AS pub FROM observations WHERE json_valid(payload)),
w AS (SELECT *, {_DOI.format("rd")} AS doi FROM v),
k AS (
  SELECT 'crossref' AS provider, doi AS provider_id, doi, title, NULL::varchar AS published FROM w WHERE p = 'crossref' AND doi IS NOT NULL
  UNION ALL SELECT 'openalex', pid, doi, title, pub FROM w WHERE p = 'openalex' AND pid IS NOT NULL
  UNION ALL SELECT 'europepmc', string_split(pid, ':')[1] || ':' || string_split(pid, ':')[2], doi, title, pub FROM w WHERE p = 'europepmc' AND string_split(pid, ':')[2] IS NOT NULL),
cand AS (SELECT DISTINCT 'P-' || substr(sha256(provider || ':' || provider_id), 1, 16) AS candidate_id, coalesce('doi:' || doi, provider || ':' || provider_id) AS work_key, provider, provider_id, doi, coalesce(title, doi, provider_id) AS title, published FROM k)
"""

ORACLE = {
    "provenance_roots": "SELECT run_key, node_id AS source_id, root_id FROM (" + HIERARCHY["p1_found"] + ") WHERE relation = 'derived_from'",
    "alias_components": f"WITH {_NAMES} SELECT alias, work_key FROM names",
    "citation_project": f"WITH {_CITES} SELECT run_key, source_work, target_work, relation, provider, resolution FROM (SELECT DISTINCT run_key, source_work, target_work, relation, provider, evidence, resolution FROM c)",
    "citation_audit": f"WITH {_CITES}, g AS (SELECT run_key, source_work, target_work, relation, provider, evidence, resolution, count(*) AS n, sum(malformed::int) AS bad FROM c GROUP BY ALL) SELECT run_key, sum(n)::bigint AS expected, sum(bad)::bigint AS malformed, count(*) AS indexed, sum((resolution <> 'resolved_local')::int)::bigint AS unresolved, (sum(n) - count(*))::bigint AS duplicates FROM g GROUP BY run_key",
    "citation_resolution": f"WITH {_CITES} SELECT resolution, provider, count(*) AS items, count(DISTINCT {{'a': run_key, 'b': source_work, 'c': target_work, 'd': evidence}}) AS edges FROM c GROUP BY ALL",
    "citation_works": f"""WITH {_CITES},
r AS (SELECT w.work_key, p.run_key, p.candidate_id, p.provider, p.title, p.doi FROM p JOIN w ON w.run_key IS NOT DISTINCT FROM p.run_key AND w.candidate_id = p.candidate_id)
SELECT work_key, f.title AS title, f.doi AS doi, providers, n AS observations, false AS external FROM (SELECT work_key, arg_min({{'title': title, 'doi': doi}}, {{'a': run_key, 'b': candidate_id}}) AS f, array_to_string(list_sort(list_distinct(list(provider))), ',') AS providers, count(*) AS n FROM r GROUP BY work_key)
UNION ALL SELECT DISTINCT target_work, NULL, CASE WHEN target_work LIKE 'doi:%' THEN substr(target_work, 5) END, '', 0, true FROM c WHERE resolution <> 'resolved_local'""",
    "graph_bfs": f"""WITH {_CITES},
g AS (SELECT DISTINCT source_work AS s, target_work AS t, source_work || '|' || target_work || '|' || relation AS edge_id FROM c),
z AS (SELECT min(s) AS n FROM g),
near AS (SELECT DISTINCT g.* FROM g, z WHERE s = n OR t = n),
one AS (SELECT * FROM near ORDER BY edge_id LIMIT 1000),
mid AS (SELECT s AS n FROM one UNION SELECT t FROM one),
next AS (SELECT DISTINCT g.edge_id FROM g JOIN mid ON g.s = mid.n OR g.t = mid.n WHERE g.edge_id NOT IN (SELECT edge_id FROM one)),
two AS (SELECT edge_id, row_number() OVER (ORDER BY edge_id) AS k FROM next)
SELECT edge_id, level, (SELECT count(*) FROM near) > 1000 OR (SELECT count(*) FROM next) > 1000 - (SELECT count(*) FROM one) AS truncated
FROM (SELECT edge_id, 1 AS level FROM one UNION ALL SELECT edge_id, 2 FROM two WHERE k <= 1000 - (SELECT count(*) FROM one))""",
    "record_edges_typed": """
WITH q AS (SELECT 'Q' || r_regionkey AS id, 'C' || (r_regionkey + 1) AS c FROM region), s AS (SELECT 'S' || n_nationkey AS id, 'S' || (n_nationkey // 2) AS d FROM nation),
c AS (SELECT 'C' || c_custkey AS id, 'Q' || (c_custkey % 7) AS q, 'S' || c_nationkey AS s, CASE WHEN c_acctbal > 0 THEN 'supports' ELSE 'evidence' END AS r FROM customer),
t AS (SELECT 'T' || n_nationkey AS id, unnest(['Q' || n_regionkey, 'C' || (n_nationkey + 1), 'X']) AS p FROM nation)
SELECT 'sources' AS source_kind, id AS source_id, 'sources' AS target_kind, d AS target_id, 'derived_from' AS relation, d IN (SELECT id FROM s) AS known FROM s
UNION ALL SELECT 'claims', id, 'questions', q, 'addresses', q IN (SELECT id FROM q) FROM c
UNION ALL SELECT 'claims', id, 'sources', s, r, s IN (SELECT id FROM s) FROM c
UNION ALL SELECT 'questions', id, 'claims', c, 'answered_by', c IN (SELECT id FROM c) FROM q
UNION ALL SELECT 'trace', id, CASE WHEN p IN (SELECT id FROM q) THEN 'questions' WHEN p IN (SELECT id FROM c) THEN 'claims' ELSE 'questions' END, p, 'parent', p IN (SELECT id FROM q) OR p IN (SELECT id FROM c) FROM t
""",
    "record_edges_merged": "SELECT run_key, source_kind, source_id, target_kind, target_id, relation, coalesce(string_agg(DISTINCT evidence, '|' ORDER BY evidence), '') AS evidence, max(synced_at) AS synced_at, count(*) AS rows FROM record_edges GROUP BY ALL",
    "provider_candidates": f"WITH {_CANDS} SELECT * FROM cand",
    "work_dedupe": f"WITH {_CANDS} SELECT work_key, count(DISTINCT candidate_id) AS observations, array_to_string(list_sort(list_distinct(list(provider))), ',') AS providers FROM cand GROUP BY work_key",
    "resolver_candidates": """
WITH d AS (SELECT doc_id, source, url, string_split(url, '/') AS p FROM documents WHERE url IS NOT NULL)
SELECT DISTINCT url || '.pdf' AS url, 'unpaywall' AS resolver, 'v1' AS version, 'pdf' AS format FROM d
UNION SELECT DISTINCT array_to_string(p[1:3], '/'), 'unpaywall', 'v1', 'landing' FROM d
UNION SELECT DISTINCT array_to_string(p[1:4], '/'), 'europepmc', 'unspecified', 'landing' FROM d WHERE source = 'openalex'
""",
    "lookup_status": "SELECT work_key, CASE WHEN bool_or(coalesce(r = 'full', false)) THEN 'candidates_found' WHEN bool_and(coalesce(r <> 'metadata', true)) THEN 'no_candidates_in_checked_indexes' ELSE 'lookup_incomplete' END AS status FROM (SELECT work_key, json_extract_string(metadata, '$.status') AS r FROM documents WHERE work_key IS NOT NULL) GROUP BY work_key",
    "candidate_page": f"WITH {_CANDS} SELECT DISTINCT candidate_id FROM cand WHERE candidate_id > 'P-8' ORDER BY 1 LIMIT 50",
}
