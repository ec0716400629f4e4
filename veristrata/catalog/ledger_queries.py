"""Validation, incremental maintenance, sources and time windows over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.catalog.hierarchy_queries import _KNOTS as KNOTS
from veristrata.catalog.search_queries import _TEXTS, texts_of
from veristrata.catalog.tables import table
from veristrata.functions.records import canonical_json, date_of_parts, text_of
from veristrata.functions.text import locators
from veristrata.operators import incremental, validation
from veristrata.operators.hierarchy import stripped
from veristrata.sources import documents as sources
from veristrata.streaming import refresh

#: Points in time at which tables are looked at.
CUTOFF = "TIMESTAMP_NTZ '2024-12-01 00:00:00'"
EVENTS_CUTOFF, EVENTS_NOW = "TIMESTAMP_NTZ '2024-01-20 00:00:00'", "TIMESTAMP_NTZ '2024-01-30 12:00:00'"
LENSES = ("breadth", "primary", "counter", "applicability")


def _candidates_of_works(spark: SparkSession, d: str) -> DataFrame:
    """Works that aliases name, with the candidates that state them."""
    works = table(spark, d, "aliases").where("work_key IS NOT NULL").select("work_key").distinct()
    seen = table(spark, d, "observations").groupBy("work_key").agg(F.collect_set("candidate_id").alias("candidates"))
    return works.join(seen, "work_key", "left")


def _unknown(spark: SparkSession, d: str) -> DataFrame:
    """Works that observations and documents name and no alias row has."""
    names = table(spark, d, "aliases").select(F.col("alias").alias("id")).unionByName(table(spark, d, "aliases").select(F.col("work_key").alias("id")))
    seen = table(spark, d, "documents").select("global_id", "work_key")
    return validation.unknown_references(seen, "documents", "global_id", "work_key", names, listed=False)


def _unread(spark: SparkSession, d: str) -> DataFrame:
    """Works of documents that no observation of the same run has."""
    seen = table(spark, d, "observations").select("run_key", F.col("work_key").alias("id"))
    return validation.unknown_references(table(spark, d, "documents"), "documents", "global_id", "work_key", seen, listed=False, within=["run_key"])


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicate_ids({"documents": table(spark, d, "documents").select(F.col("global_id").alias("id")), "texts": table(spark, d, "texts").select(F.col("text_id").alias("id"))})


def _one_sided(spark: SparkSession, d: str) -> DataFrame:
    """Aliases that name a work which does not name them back."""
    pairs = table(spark, d, "aliases").where("alias IS NOT NULL AND work_key IS NOT NULL")
    left = pairs.select(F.col("alias").alias("k"), F.array("work_key").alias("refs"))
    right = pairs.select(F.col("alias").alias("w"), F.array("work_key").alias("back"))
    return validation.one_sided_links(left, right, "aliases", "k", "refs", "w", "back")


def _uncovered(spark: SparkSession, d: str) -> DataFrame:
    """Lenses that no row covers, for every question that has any row; outer blanks and the case of the relation do not count."""
    relation = F.lower(stripped(F.col("relation")))
    edges = table(spark, d, "record_edges").withColumn("id", stripped(F.col("source_id"))).where("source_kind = 'questions' AND length(id) > 0")
    rows = edges.select(F.concat_ws("/", "run_key", "id").alias("question"), F.when(relation.startswith("covered_by:"), F.substring(relation, 12, 99)).alias("lens"))
    return validation.uncovered(rows, "questions", "question", "lens", LENSES)


def _no_support(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "record_edges").where("source_id IS NOT NULL").withColumn("claim", F.concat_ws("/", "run_key", F.trim("source_id")))
    return validation.unsupported(edges.where("source_kind = 'claims'").select("claim").distinct(), edges.where("source_kind = 'claims' AND relation = 'supports'"), "NO_SUPPORT", "claims", "claim")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Record edges with relations and ids as they compare: (run_key, source_kind, id, relation)."""
    return table(spark, d, "record_edges").select("run_key", "source_kind", F.concat_ws("/", "run_key", stripped(F.col("source_id"))).alias("id"), F.lower(stripped(F.col("relation"))).alias("relation"), (F.length(stripped(F.col("source_id"))) > 0).alias("named")).where("named")


def _no_refutation(spark: SparkSession, d: str) -> DataFrame:
    claims = _edges(spark, d).where("source_kind = 'claims'").select(F.col("id").alias("claim"), "relation")
    return validation.unsupported(claims.select("claim").distinct(), claims.where("relation = 'refutes'"), "NO_REFUTATION", "claims", "claim")


def _coverage_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Lenses for which a question names sources but no search."""
    cells = _edges(spark, d).where("source_kind = 'questions'").select("id", F.split_part("relation", F.lit(":"), F.lit(1)).alias("what"), F.split_part("relation", F.lit(":"), F.lit(2)).alias("lens"))
    return validation.unequal_cells(cells.where("what = 'coverage_source'"), cells.where("what = 'covered_by'"), "COVERAGE_SOURCE_MISMATCH", "questions", "id", "lens")


def _undated(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of runs whose latest row states no date."""
    last = validation.last_by(table(spark, d, "observations").where("candidate_id IS NOT NULL"), ["run_key", "candidate_id"], ["observed_at", "payload"], ["payload"])
    return validation.undated(last.withColumn("k", F.concat_ws("/", "run_key", "candidate_id")), "observations", "k", F.get_json_object("payload", "$.published"))


def _not_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = validation.not_lists(table(spark, d, "record_edges"), "record_edges", "source_id", "evidence")
    return rows.groupBy("code", "table", "detail").agg(F.count("*").alias("records"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are no part of their document's text."""
    docs = table(spark, d, "documents")
    return validation.missing_passages(docs.where("title IS NOT NULL").select("doc_id", "title"), docs.select("doc_id", "text"), "documents", "doc_id", "title", "doc_id", "text")


def _changed(spark: SparkSession, d: str) -> DataFrame:
    return validation.changed_content(table(spark, d, "documents"), "documents", "doc_id", F.col("text"), "sha256")


def _report(spark: SparkSession, d: str) -> DataFrame:
    docs, texts = table(spark, d, "documents"), table(spark, d, "texts")
    return validation.report(
        validation.missing_ids(table(spark, d, "record_edges"), "record_edges", "source_id"),
        validation.required_text(docs, "documents", "doc_id", ["text", "title", "source", "work_key"]),
        validation.allowed_values(texts, "texts", "text_id", "kind", ("document", "evidence", "report", "query")),
        _unknown(spark, d),
        _uncovered(spark, d),
    ).groupBy("code", "table").agg(F.count("*").alias("findings"))


def _subset(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "record_edges").withColumn("k", F.concat_ws("/", "run_key", "source_id", "target_id"))
    return validation.subset_violations(edges, "record_edges", "k", locators(F.col("evidence")), F.array(*[F.lit(f"page:{i}") for i in range(1, 21)]))


def _last_review(spark: SparkSession, d: str) -> DataFrame:
    return validation.last_by(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


def _states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("state", F.when(F.col("event_type") != "view", F.col("event_type")))
    return validation.state_at(rows, ["user_id"], ["ts", "event_id"], "state").select("event_id", "last_state")


def _two_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The candidates of every run as they were known at CUTOFF, and as the latest rows have them."""
    rows = table(spark, d, "observations").where("candidate_id IS NOT NULL")
    state = lambda r: validation.last_by(r, ["run_key", "candidate_id"], ["observed_at", "payload"], ["provider", "work_key", "payload"])
    return state(rows.where(f"observed_at < {CUTOFF}")), state(rows)


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return incremental.difference(*_two_versions(spark, d), ["run_key", "candidate_id"])


def _event_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The last event of each kind of each user before EVENTS_CUTOFF, and the events from then on."""
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "value", "event_id")
    old = rows.where(f"ts < {EVENTS_CUTOFF}")
    return incremental.replaced(old.limit(0), old, ["user_id", "event_type"], ["ts", "event_id"]), rows.where(f"ts >= {EVENTS_CUTOFF}")


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    """Registrations of runs: the first row of each, then the latest over it; a null fingerprint leaves the old one."""
    runs = table(spark, d, "runs").where("run_key IS NOT NULL")
    last = validation.last_by(runs, ["run_key"], ["synced_at", "fingerprint"], ["root", "fingerprint"])
    first = runs.groupBy("run_key").agg(F.min_by(F.struct("root", "fingerprint"), F.struct("synced_at", "fingerprint")).alias("r")).select("run_key", "r.*")
    return incremental.coalesced(first, last, ["run_key"])


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of each run's documents; rows are counted with repeats, in whatever order and partitions they come."""
    docs = table(spark, d, "documents").select("run_key", "global_id", "sha256")
    return incremental.fingerprints(docs.unionByName(docs).repartition(7), ["run_key"], ["sha256", "global_id"])


def _forget(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs")
    gone = runs.agg(F.min("run_key").alias("run_key"))
    tables = {n: table(spark, d, n) for n in ("documents", "texts", "observations", "record_edges")}
    return validation.record_counts(incremental.without_runs(tables, gone))


def _run_states(spark: SparkSession, d: str) -> DataFrame:
    """Runs as registered at CUTOFF against their latest fingerprints."""
    runs = table(spark, d, "runs")
    now = runs.where("run_key IS NOT NULL").groupBy("run_key").agg(F.max("fingerprint").alias("fingerprint"))
    return incremental.run_states(runs.where(f"synced_at < {CUTOFF}"), now)


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """Events as cached answers that are valid for as many hours as their value."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("ts") + F.expr("make_dt_interval(0, cast(floor(value) AS int))")).alias("expires"))
    return incremental.latest_valid(rows, "user_id", "ts", "expires", F.expr(EVENTS_NOW)).select("user_id", "event_id")


def _delays(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    out = incremental.slot_delays(table(spark, d, "events"), "user_id", "ts", 86400.0, F.lit(now))
    return out.select("user_id", F.round("delay", 3).alias("delay"))


def _html(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of HTML, and back to text."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>T</title><script>var a = 1;</script></head><body><p class='x'>"), safe, F.lit("</p><!-- note --><div>End &copy;</div></body></html>"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(sources.html_text(html), 256).alias("sha"))


def _formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 6
    head = F.when(k == 0, "  %PDF-1.7 x").when(k == 1, "<!doctype HTML><p>").when(k == 2, " <?xml version='1.0'?>").otherwise(F.substring(F.coalesce("text", F.lit("")), 1, 200))
    mime = F.when(k == 3, "application/pdf").when(k == 4, "text/html; charset=utf-8").otherwise(F.get_json_object("metadata", "$.mime"))
    return table(spark, d, "documents").select("doc_id", sources.format_of(head, F.when(k < 3, None).when(k < 5, mime)).alias("format"))


def _ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = texts_of(spark, d).where("object_id IS NOT NULL").select("object_id", F.concat_ws(":", F.lit("page"), "ordinal").alias("locator"), "text")
    return sources.ingest_summary(rows, "object_id").withColumn("empty_pages", F.array_join("empty_pages", ","))


def _register(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("pages", F.coalesce(F.get_json_object("metadata", "$.pages").cast("int"), F.lit(0)))
    docs = docs.withColumn("available", F.transform(F.when(F.col("pages") > 0, F.sequence(F.lit(1), "pages")).otherwise(F.array()), lambda i: F.concat(F.lit("page:"), i))).withColumn("scope", F.concat(F.lit("read page:1 and page:"), (F.col("doc_id") % 3 + 1).cast("string")))
    return sources.registrable(docs.withColumn("level", F.get_json_object("metadata", "$.status")), "scope", "available", "level").select("doc_id")


def _text_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("metadata IS NOT NULL")
    return rows.select("doc_id", text_of("metadata").alias("strings"), canonical_json(F.col("metadata")).alias("canonical"))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    parts = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.year("o_orderdate"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.year("o_orderdate"), F.month("o_orderdate"))).otherwise(F.array(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate")))
    return o.select("o_orderkey", date_of_parts(parts).alias("published"))


QUERIES = {
    "missing_ids": lambda s, d: validation.missing_ids(table(s, d, "record_edges").withColumn("where", F.concat_ws("/", "run_key", "target_id")), "record_edges", "source_id").groupBy("code", "table").agg(F.count("*").alias("n")),
    "duplicate_ids": _duplicates,
    "required_text": lambda s, d: validation.required_text(table(s, d, "documents"), "documents", "doc_id", ["text", "title", "source"]),
    "enum_violations": lambda s, d: validation.allowed_values(table(s, d, "documents"), "documents", "doc_id", "lang", ("en", "de", "fr", "es", "pt", "ru", "ko", "ja", "zh", "th")),
    "timestamp_invalid": lambda s, d: validation.timestamps(table(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit("yesterday")).when(F.col("event_type") == "view", F.lit("2024-05-01T10:00:00")).when(F.col("event_type") == "signup", None).otherwise(F.lit("2024-05-01T10:00:00Z")).alias("at")), "events", "event_id", "at"),
    "empty_refs": lambda s, d: validation.empty_references(_candidates_of_works(s, d), "aliases", "work_key", "candidates"),
    "unknown_refs": _unknown,
    "unread_evidence": _unread,
    "question_claim_mismatch": _one_sided,
    "coverage_missing": _uncovered,
    "no_support": _no_support,
    "no_refutation": _no_refutation,
    "coverage_mismatch": _coverage_mismatch,
    "undated_sources": _undated,
    "invalid_lists": _not_lists,
    "trace_without_claim": lambda s, d: validation.rootless(table(s, d, "record_edges")),
    "report_text_missing": _passages,
    "hash_integrity": _changed,
    "register_subset": _subset,
    "validation_report": _report,
    "cycle_detection": lambda s, d: validation.cycles(table(s, d, "record_edges")),
    "latest_review": _last_review,
    "finding_last_state": _states,
    "reconcile_diff": _diff,
    "text_delta": lambda s, d: incremental.change_counts(_diff(s, d), ["run_key"]),
    "reconcile_writes": lambda s, d: incremental.reconciled(*_two_versions(s, d), ["run_key", "candidate_id"]).select("run_key", "candidate_id", "payload"),
    "insert_or_replace": lambda s, d: incremental.replaced(*_event_versions(s, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id"),
    "insert_or_ignore": lambda s, d: incremental.kept_first(_event_versions(s, d)[1], _event_versions(s, d)[0], ["user_id", "event_type", "event_id"], ["ts"]).groupBy("user_id").agg(F.count("*").alias("n")),
    "upsert_coalesce": _upsert,
    "run_fingerprint": _fingerprints,
    "forget_run": _forget,
    "run_identity_conflicts": lambda s, d: incremental.registered_twice(table(s, d, "runs").unionByName(table(s, d, "runs").withColumn("root", F.regexp_replace("root", "/[^/]*$", "")))),
    "run_states": _run_states,
    "status_counts": lambda s, d: validation.record_counts({n: table(s, d, n) for n in ("runs", "record_edges", "observations", "documents", "texts", "text_embeddings", "aliases")}),
    "access_counts": lambda s, d: table(s, d, "documents").groupBy(F.get_json_object("metadata", "$.status").alias("access")).agg(F.count("*").alias("n")),
    "cache_latest_valid": _cache,
    "rate_slot_delay": _delays,
    "html_extract": _html,
    "format_sniff": _formats,
    "ingest_summary": _ingest,
    "register_gate": _register,
    "record_text": _text_of,
    "published_dates": _dates,
    "event_windows": lambda s, d: refresh.window_counts(table(s, d, "events"), "ts", ["event_type"], "1 day", "1 hour"),
    "event_windows_sliding": lambda s, d: refresh.window_counts(table(s, d, "events"), "ts", ["event_type"], "2 days", "1 hour", "1 day"),
    "event_sessions": lambda s, d: refresh.session_counts(table(s, d, "events"), "ts", ["user_id"], "6 hours", "1 hour"),
}

_SP = r"[\s\p{Z}\x{85}]+"
_BLANK = "coalesce(length(regexp_replace({0}, '" + _SP + "', '', 'g')), 0) = 0"
_STATE = "SELECT run_key, candidate_id, arg_max({'provider': provider, 'work_key': work_key, 'payload': payload}, {'a': observed_at, 'p': payload}) AS r FROM observations WHERE candidate_id IS NOT NULL"
_VERSIONS = f"""
old AS ({_STATE} AND observed_at < TIMESTAMP '2024-12-01' GROUP BY ALL), new AS ({_STATE} GROUP BY ALL),
df AS (SELECT coalesce(o.run_key, n.run_key) AS run_key, coalesce(o.candidate_id, n.candidate_id) AS candidate_id, CASE WHEN o.candidate_id IS NULL THEN 'added' WHEN n.candidate_id IS NULL THEN 'removed'
  WHEN o.r IS NOT DISTINCT FROM n.r THEN 'unchanged' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.candidate_id = n.candidate_id AND o.run_key IS NOT DISTINCT FROM n.run_key)"""
_UNKNOWN = "SELECT DISTINCT 'UNKNOWN_REF' AS code, 'documents' AS \"table\", global_id AS record, work_key AS detail FROM documents WHERE work_key IS NOT NULL AND work_key NOT IN (SELECT alias FROM aliases WHERE alias IS NOT NULL UNION ALL SELECT work_key FROM aliases WHERE work_key IS NOT NULL)"
_COVER = r"""
SELECT 'COVERAGE_MISSING' AS code, 'questions' AS "table", k AS record, lens AS detail FROM
 (SELECT DISTINCT concat_ws('/', run_key, regexp_replace(source_id, '^\s+|\s+$', '', 'g')) AS k FROM record_edges WHERE source_kind = 'questions' AND length(regexp_replace(source_id, '^\s+|\s+$', '', 'g')) > 0) q,
 (VALUES ('breadth'), ('primary'), ('counter'), ('applicability')) l(lens)
WHERE NOT EXISTS (SELECT 1 FROM record_edges e WHERE e.source_kind = 'questions' AND lower(regexp_replace(e.relation, '^\s+|\s+$', '', 'g')) = 'covered_by:' || lens AND concat_ws('/', e.run_key, regexp_replace(e.source_id, '^\s+|\s+$', '', 'g')) = k)"""
_REQ = "SELECT 'REQUIRED_TEXT' AS code, 'documents' AS \"table\", doc_id::varchar AS record, '{0}' AS detail FROM documents WHERE " + _BLANK
_LOC = r"regexp_extract_all(evidence, '\bpage:\d+\b|\bdocument\b')"

_EDGES = r"""WITH e AS (SELECT source_kind, concat_ws('/', run_key, regexp_replace(source_id, '^\s+|\s+$', '', 'g')) AS id, lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')) AS relation
  FROM record_edges WHERE length(regexp_replace(source_id, '^\s+|\s+$', '', 'g')) > 0)
"""

ORACLE = {
    "missing_ids": f"SELECT 'MISSING_ID' AS code, 'record_edges' AS \"table\", count(*) AS n FROM record_edges WHERE {_BLANK.replace("{0}", "source_id")}",
    "duplicate_ids": "SELECT 'DUPLICATE_ID' AS code, array_to_string(list_sort(list_distinct(list(t))), ',') AS \"table\", id AS record, count(*)::varchar AS detail FROM (SELECT 'documents' AS t, global_id AS id FROM documents UNION ALL SELECT 'texts', text_id FROM texts) WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
    "required_text": " UNION ALL ".join(_REQ.replace("{0}", c) for c in ("text", "title", "source")),
    "enum_violations": "SELECT 'INVALID_VALUE' AS code, 'documents' AS \"table\", doc_id::varchar AS record, coalesce(lang, 'null') AS detail FROM documents WHERE coalesce(lang NOT IN ('en', 'de', 'fr', 'es', 'pt', 'ru', 'ko', 'ja', 'zh', 'th'), true)",
    "timestamp_invalid": "SELECT 'INVALID_TIMESTAMP' AS code, 'events' AS \"table\", event_id::varchar AS record, CASE event_type WHEN 'error' THEN 'yesterday' WHEN 'view' THEN '2024-05-01T10:00:00' ELSE 'null' END AS detail FROM events WHERE event_type IN ('error', 'view', 'signup')",
    "empty_refs": "SELECT DISTINCT 'EMPTY_REFS' AS code, 'aliases' AS \"table\", work_key AS record, 'candidates' AS detail FROM aliases WHERE work_key IS NOT NULL AND work_key NOT IN (SELECT work_key FROM observations WHERE work_key IS NOT NULL AND candidate_id IS NOT NULL)",
    "unknown_refs": _UNKNOWN,
    "unread_evidence": "SELECT DISTINCT 'UNKNOWN_REF' AS code, 'documents' AS \"table\", global_id AS record, work_key AS detail FROM documents t WHERE work_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM observations x WHERE x.run_key = t.run_key AND x.work_key = t.work_key)",
    "question_claim_mismatch": "SELECT DISTINCT 'ONE_SIDED_LINK' AS code, 'aliases' AS \"table\", alias AS record, work_key AS detail FROM aliases t WHERE alias IS NOT NULL AND work_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM aliases b WHERE b.alias = t.work_key AND b.work_key = t.alias)",
    "coverage_missing": _COVER,
    "no_refutation": _EDGES + "SELECT DISTINCT 'NO_REFUTATION' AS code, 'claims' AS \"table\", id AS record, 'claim' AS detail FROM e WHERE source_kind = 'claims' AND id NOT IN (SELECT id FROM e WHERE source_kind = 'claims' AND relation = 'refutes')",
    "coverage_mismatch": _EDGES + "SELECT DISTINCT 'COVERAGE_SOURCE_MISMATCH' AS code, 'questions' AS \"table\", id AS record, split_part(relation, ':', 2) AS detail FROM e WHERE source_kind = 'questions' AND relation LIKE 'coverage_source:%' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.source_kind = 'questions' AND x.id = e.id AND x.relation = 'covered_by:' || split_part(e.relation, ':', 2))",
    "undated_sources": """WITH l AS (SELECT run_key, candidate_id, arg_max(payload, {'at': observed_at, 'p': payload}) AS payload FROM observations WHERE candidate_id IS NOT NULL GROUP BY ALL)
SELECT 'UNDATED_SOURCE' AS code, 'observations' AS "table", concat_ws('/', run_key, candidate_id) AS record, 'published' AS detail FROM l WHERE CASE WHEN json_valid(payload) THEN trim(coalesce(json_extract_string(payload, '$.published'), '')) = '' ELSE true END""",
    "invalid_lists": """SELECT 'INVALID_LIST' AS code, 'record_edges' AS "table", coalesce(evidence, 'null') AS detail, count(*) AS records FROM record_edges
WHERE NOT coalesce(json_valid(evidence) AND json_type(evidence) = 'ARRAY' AND coalesce(list_bool_and(list_transform(json_extract(evidence, '$[*]'), lambda x: json_type(x) = 'VARCHAR')), true), false) GROUP BY ALL""",
    "trace_without_claim": KNOTS + r"""
, i AS (SELECT DISTINCT run_key, regexp_replace(source_id, '^\s+|\s+$', '', 'g') AS node FROM record_edges WHERE lower(trim(source_kind)) = 'trace' AND length(regexp_replace(source_id, '^\s+|\s+$', '', 'g')) > 0),
g AS (SELECT DISTINCT run_key, regexp_replace(target_id, '^\s+|\s+$', '', 'g') AS node FROM record_edges WHERE lower(trim(target_kind)) = 'claims' AND lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')) = 'parent')
SELECT 'TRACE_WITHOUT_CLAIM' AS code, 'trace' AS "table", concat_ws('/', run_key, node) AS record, 'claims' AS detail FROM i WHERE NOT EXISTS (
  SELECT 1 FROM up JOIN g ON g.run_key IS NOT DISTINCT FROM up.run_key AND g.node = up.anc WHERE up.relation = 'parent' AND up.run_key IS NOT DISTINCT FROM i.run_key AND up.node = i.node)""",
    "no_support": "WITH e AS (SELECT concat_ws('/', run_key, trim(source_id)) AS claim, relation FROM record_edges WHERE source_kind = 'claims' AND source_id IS NOT NULL) SELECT DISTINCT 'NO_SUPPORT' AS code, 'claims' AS \"table\", claim AS record, 'claim' AS detail FROM e WHERE claim NOT IN (SELECT claim FROM e WHERE relation = 'supports')",
    "report_text_missing": "SELECT 'TEXT_MISSING' AS code, 'documents' AS \"table\", doc_id::varchar AS record, 'doc_id' AS detail FROM documents WHERE title IS NOT NULL AND NOT coalesce(contains(text, title), false)",
    "hash_integrity": "SELECT 'CONTENT_CHANGED' AS code, 'documents' AS \"table\", doc_id::varchar AS record, coalesce(sha256(text), 'null') AS detail FROM documents WHERE sha256(text) IS DISTINCT FROM sha256",
    "register_subset": f"""WITH r AS (SELECT concat_ws('/', run_key, source_id, target_id) AS k, list_filter({_LOC}, lambda x, i: list_position({_LOC}, x) = i) AS l FROM record_edges),
v AS (SELECT k, l, list_filter(l, lambda x: NOT list_contains(list_transform(range(1, 21), lambda i: 'page:' || i), x)) AS extra FROM r)
SELECT 'NOT_A_SUBSET' AS code, 'record_edges' AS "table", k AS record, coalesce(array_to_string(extra, ','), '') AS detail FROM v WHERE coalesce(len(l), 0) = 0 OR len(extra) > 0""",
    "validation_report": f"""SELECT code, "table", count(*) AS findings FROM (
SELECT 'MISSING_ID' AS code, 'record_edges' AS "table" FROM record_edges WHERE {_BLANK.replace("{0}", "source_id")}
UNION ALL SELECT code, "table" FROM ({" UNION ALL ".join(_REQ.replace("{0}", c) for c in ("text", "title", "source", "work_key"))})
UNION ALL SELECT 'INVALID_VALUE', 'texts' FROM texts WHERE coalesce(kind NOT IN ('document', 'evidence', 'report', 'query'), true)
UNION ALL SELECT code, "table" FROM ({_UNKNOWN}) UNION ALL SELECT code, "table" FROM ({_COVER})) GROUP BY ALL""",
    "cycle_detection": KNOTS + " SELECT CASE relation WHEN 'parent' THEN 'TRACE_CYCLE' ELSE 'SOURCE_CYCLE' END AS code, relation AS \"table\", concat_ws('/', run_key, node) AS record, name AS detail FROM knots",
    "latest_review": "SELECT user_id, event_type, r.event_id AS event_id, r.value AS value FROM (SELECT user_id, event_type, arg_max({'event_id': event_id, 'value': value}, {'t': ts, 'e': event_id}) AS r FROM events GROUP BY ALL)",
    "finding_last_state": "SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_state FROM events",
    "reconcile_diff": f"WITH {_VERSIONS} SELECT * FROM df",
    "text_delta": f"WITH {_VERSIONS} SELECT run_key, " + ", ".join(f"sum((change = '{k}')::int)::bigint AS {k}" for k in ("added", "removed", "changed", "unchanged")) + " FROM df GROUP BY run_key",
    "reconcile_writes": f"WITH {_VERSIONS} SELECT n.run_key, n.candidate_id, n.r.payload AS payload FROM new n JOIN df ON df.candidate_id = n.candidate_id AND df.run_key IS NOT DISTINCT FROM n.run_key WHERE change IN ('added', 'changed')",
    "insert_or_replace": """WITH last AS (SELECT *, 0 AS g FROM events WHERE ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1), a AS (SELECT * FROM last UNION ALL SELECT *, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT user_id, event_type, event_id FROM a QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY g DESC, ts DESC, event_id DESC) = 1""",
    "insert_or_ignore": """WITH last AS (SELECT user_id, event_type, event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, count(*) AS n FROM (SELECT user_id, event_type, event_id FROM last UNION SELECT user_id, event_type, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20') GROUP BY user_id""",
    "upsert_coalesce": """WITH f AS (SELECT run_key, arg_min({'root': root, 'fingerprint': fingerprint}, {'a': synced_at, 'b': fingerprint}) AS r, arg_max({'root': root, 'fingerprint': fingerprint}, {'a': synced_at, 'b': coalesce(fingerprint, '')}) AS l FROM runs WHERE run_key IS NOT NULL GROUP BY run_key)
SELECT run_key, coalesce(l.root, r.root) AS root, coalesce(l.fingerprint, r.fingerprint) AS fingerprint FROM f""",
    "run_fingerprint": """WITH h AS (SELECT run_key, sha256(to_json({'global_id': global_id, 'sha256': sha256})::varchar) AS h, 2 * count(*) AS n FROM documents GROUP BY ALL)
SELECT run_key, sum(n)::bigint AS rows, sha256(concat_ws(',', sum(('0x' || h[1:16])::ubigint::hugeint)::varchar, sum(('0x' || h[17:32])::ubigint::hugeint)::varchar, sum(('0x' || h[33:48])::ubigint::hugeint)::varchar, sum(('0x' || h[49:64])::ubigint::hugeint)::varchar)) AS fingerprint FROM h GROUP BY run_key""",
    "forget_run": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t} WHERE run_key IS NULL OR run_key <> (SELECT min(run_key) FROM runs)" for t in ("documents", "texts", "observations", "record_edges")),
    "run_identity_conflicts": "WITH r AS (SELECT run_key, root FROM runs UNION ALL SELECT run_key, regexp_replace(root, '/[^/]*$', '') FROM runs) SELECT 'path' AS kind, root AS value, count(DISTINCT run_key) AS conflicts FROM r WHERE root IS NOT NULL GROUP BY root HAVING count(DISTINCT run_key) > 1 UNION ALL SELECT 'run', run_key, count(DISTINCT root) FROM r WHERE run_key IS NOT NULL GROUP BY run_key HAVING count(DISTINCT root) > 1",
    "run_states": """WITH l AS (SELECT run_key, fingerprint AS recorded FROM runs WHERE run_key IS NOT NULL AND synced_at < TIMESTAMP '2024-12-01' QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY synced_at DESC NULLS LAST, fingerprint DESC NULLS LAST) = 1),
p AS (SELECT run_key, max(fingerprint) AS f FROM runs WHERE run_key IS NOT NULL GROUP BY run_key)
SELECT run_key, CASE WHEN f IS NULL THEN 'missing' WHEN recorded IS NULL THEN 'new' WHEN recorded = f THEN 'current' ELSE 'stale' END AS status FROM l FULL JOIN p USING (run_key)""",
    "status_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("runs", "record_edges", "observations", "documents", "texts", "text_embeddings", "aliases")),
    "access_counts": "SELECT json_extract_string(metadata, '$.status') AS access, count(*) AS n FROM documents GROUP BY 1",
    "cache_latest_valid": """WITH e AS (SELECT user_id, ts, event_id, ts + to_hours(floor(value)::bigint) AS expires FROM events)
SELECT user_id, event_id FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, expires DESC) = 1) WHERE expires > TIMESTAMP '2024-01-30 12:00:00'""",
    "rate_slot_delay": "SELECT user_id, round(greatest(0.0, least(86400.0, epoch(max(ts)) + 86400.0 - (SELECT epoch(max(ts)) FROM events))), 3)::double AS delay FROM events GROUP BY user_id",
    "html_extract": "SELECT doc_id, sha256('T' || chr(10) || text || chr(10) || 'End ©') AS sha FROM documents WHERE text IS NOT NULL",
    "format_sniff": r"""SELECT doc_id, CASE WHEN k = 0 THEN 'pdf' WHEN k = 1 THEN 'html' WHEN k = 2 THEN 'xml' WHEN regexp_matches(h, '^\s*%PDF-') THEN 'pdf' WHEN k = 3 THEN 'invalid_content' WHEN k = 4 OR contains(lower(h), '<html') OR contains(lower(h), '<!doctype html') THEN 'html' WHEN regexp_matches(lower(h), '^\s*<\?xml') THEN 'xml' ELSE 'text' END AS format
FROM (SELECT doc_id, doc_id % 6 AS k, substr(coalesce(text, ''), 1, 200) AS h FROM documents)""",
    "ingest_summary": rf"WITH {_TEXTS} SELECT object_id, count(*) AS pages, coalesce(sum(length(text)), 0)::bigint AS characters, coalesce(string_agg('page:' || ordinal, ',' ORDER BY 'page:' || ordinal) FILTER (WHERE length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) = 0), '') AS empty_pages FROM t WHERE object_id IS NOT NULL GROUP BY object_id",
    "register_gate": "SELECT doc_id FROM documents WHERE coalesce(json_extract_string(metadata, '$.pages')::int, 0) >= doc_id % 3 + 1 AND coalesce(json_extract_string(metadata, '$.status') NOT IN ('metadata', 'abstract', 'ai_summary'), true)",
    "record_text": """SELECT doc_id, array_to_string(list_filter([json_extract_string(metadata, '$.mime'), json_extract_string(metadata, '$.status')], lambda x: trim(x) <> ''), chr(10)) AS strings,
  '{"mime":' || json_extract(metadata, '$.mime') || ',"pages":' || json_extract(metadata, '$.pages') || ',"status":' || json_extract(metadata, '$.status') || '}' AS canonical FROM documents WHERE metadata IS NOT NULL""",
    "published_dates": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published FROM orders",
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_windows_sliding": "SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
}
