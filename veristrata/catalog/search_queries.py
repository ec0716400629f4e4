"""Full-text search, text functions and identifiers over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.catalog.tables import table
from veristrata.functions import identifiers, records
from veristrata.functions.text import ACCENTED, MARKS, PLAIN, chunked, highlighted, locators, nonempty, search_tokens, stripped
from veristrata.operators import search

HOSTS = ("doi.example", "dx.doi.example")
QUERY = "benchmark table"


def texts_of(spark: SparkSession, d: str) -> DataFrame:
    """Every text once: the latest of repeated rows."""
    rows = table(spark, d, "texts").where("text_id IS NOT NULL")
    return rows.groupBy("text_id").agg(F.max_by(F.struct("run_key", "kind", "object_id", "locator", "ordinal", "text", "text_sha256", "lang"), F.struct("synced_at", "text")).alias("r")).select("text_id", "r.*")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with a recorded fingerprint."""
    return table(spark, d, "runs").where("fingerprint IS NOT NULL").select("run_key").distinct()


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(texts_of(spark, d)).groupBy("term").agg(F.count("*").alias("texts"), F.sum("tf").alias("occurrences"), F.sum(F.element_at("positions", 1).cast("long")).alias("first_positions"))


def _in_postings(spark: SparkSession, d: str) -> DataFrame:
    texts = texts_of(spark, d)
    lengths = search.token_index(texts).select("text_id", F.coalesce(F.size("tokens"), F.lit(0)).alias("len"))
    return search.find_in_postings(search.postings(texts), lengths, QUERY.split())


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages: one for each paragraph, with the locator page:n."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select(F.col("doc_id"), F.posexplode(F.split("text", r"\n\n")).alias("n", "text")).select("doc_id", F.concat(F.lit("page:"), F.col("n") + 1).alias("locator"), "text")


def _page_find(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).withColumn("key", F.concat_ws("/", "doc_id", "locator"))
    return search.find(pages, "cached copy", limit=30, key="key", keep=("doc_id", "locator")).drop("snippet", "key")


def _payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").select("run_key", "candidate_id", "provider", "payload")


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    v = _payload(spark, d).withColumn("v", F.try_parse_json("payload"))
    return v.select("candidate_id", F.expr("try_variant_get(v, '$.doi', 'string')").alias("raw")).where("raw IS NOT NULL").distinct().select("candidate_id", "raw", identifiers.normalized_doi(F.col("raw"), HOSTS).alias("doi"))


def _openalex(spark: SparkSession, d: str) -> DataFrame:
    v = _payload(spark, d).withColumn("v", F.try_parse_json("payload"))
    return v.select("candidate_id", F.expr("try_variant_get(v, '$.provider_id', 'string')").alias("raw")).where("raw IS NOT NULL").distinct().select("candidate_id", "raw", identifiers.openalex_alias(F.col("raw")).alias("alias"))


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.replace("url", F.lit("https://"), F.lit("https://user:pw@")), F.lit("?Token=abc&q="), F.col("doc_id"), F.lit("&email=x#part"))
    return table(spark, d, "documents").where("url IS NOT NULL").select("doc_id", identifiers.redacted(url).alias("url"))


_FOLD = f"lower(translate(regexp_replace(text, '[{MARKS}]', '', 'g'), '{ACCENTED}', '{PLAIN}'))"
_TOKENS = rf"regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+')"
_TEXTS = "t AS (SELECT text_id, r.* FROM (SELECT text_id, arg_max({'run_key': run_key, 'kind': kind, 'object_id': object_id, 'locator': locator, 'ordinal': ordinal, 'text': text, 'text_sha256': text_sha256}, {'s': synced_at, 't': text}) AS r FROM texts WHERE text_id IS NOT NULL GROUP BY text_id))"


def _bm25(source: str, key: str, keep: str, words: list[str], limit: int, extra: str = "", where: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(tk, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    parts = " + ".join(
        f"(CASE WHEN ln((n - d{i} + 0.5::double) / (d{i} + 0.5::double)) <= 0 THEN 1e-6::double ELSE ln((n - d{i} + 0.5::double) / (d{i} + 0.5::double)) END) * f{i} * 2.2::double / (f{i} + 1.2::double * (0.25::double + 0.75::double * len / avglen))"
        for i in range(len(words))
    )
    return f"""
WITH {source}, tok AS (SELECT {key}, {keep}, {_TOKENS} AS tk FROM t WHERE text IS NOT NULL),
c AS (SELECT {key}, {keep}, len(tk) AS len, {tf} FROM tok),
s AS (SELECT count(*)::double AS n, avg(len)::double AS avglen, {", ".join(f"sum((f{i} > 0)::int)::double AS d{i}" for i in range(len(words)))} FROM c)
SELECT {key}, {keep}, round(-({parts}), 6) AS score FROM c, s WHERE {" AND ".join(f"f{i} > 0" for i in range(len(words)))} AND {where} {extra} ORDER BY score, {key} LIMIT {limit}
"""


_KEEP = "run_key, kind, object_id, locator"

QUERIES = {
    "lexical_find": lambda s, d: search.find(texts_of(s, d).where("text IS NOT NULL"), QUERY).drop("snippet"),
    "lexical_find_run_scoped": lambda s, d: search.find(texts_of(s, d).where("text IS NOT NULL"), QUERY, eligible=_runs(s, d)).drop("snippet"),
    "lexical_phrase": lambda s, d: search.find(texts_of(s, d).where("text IS NOT NULL"), "benchmark_table search", limit=50).select("text_id"),
    "lexical_postings": _postings,
    "lexical_find_in_postings": _in_postings,
    "page_find": _page_find,
    "snippet_highlight": lambda s, d: table(s, d, "documents").where("title IS NOT NULL").select("doc_id", highlighted(F.col("title"), [["review"], ["limits"]]).alias("snippet")),
    "search_tokens": lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(search_tokens(F.col("text"))).alias("tokens"), F.array_join(F.slice(search_tokens(F.col("text")), 1, 5), " ").alias("first_tokens")),
    "chunk_texts": lambda s, d: chunked(table(s, d, "documents"), ["doc_id"]).select("doc_id", "ordinal", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha")),
    "text_ids": lambda s, d: table(s, d, "texts").where("text IS NOT NULL").select(identifiers.text_id(*[F.col(c) for c in ("run_key", "kind", "object_id", "locator", "ordinal", "text")]).alias("derived_id"), "text_id").distinct(),
    "run_keys": lambda s, d: table(s, d, "runs").select("root", identifiers.run_key(F.nullif(F.substring_index("run_key", ":", -1), F.lit("")), F.col("root"), F.col("query_sha256")).alias("run_key"), identifiers.run_key(F.lit(None).cast("string"), F.col("root"), F.col("query_sha256")).alias("legacy_key")).distinct(),
    "candidate_ids": lambda s, d: table(s, d, "observations").select("work_key", "provider", identifiers.candidate_id(F.col("provider"), F.col("work_key")).alias("derived_id")).where("work_key IS NOT NULL AND provider IS NOT NULL").distinct(),
    "doi_normalize": _normalized,
    "openalex_alias": _openalex,
    "url_redact": _redacted,
    "nonempty_text": lambda s, d: table(s, d, "documents").select("doc_id", nonempty(F.col("text")).alias("has_text"), F.length(stripped(F.coalesce("title", F.lit("")))).alias("title_chars")),
    "read_scope_locators": lambda s, d: table(s, d, "record_edges").where("evidence IS NOT NULL").select(F.col("evidence"), F.array_join(locators(F.col("evidence")), ",").alias("places")).distinct(),
    "strict_json_errors": lambda s, d: _payload(s, d).where(~records.is_strict_object(F.col("payload"))).select("run_key", "candidate_id"),
    "zoned_timestamps": lambda s, d: table(s, d, "events").select("event_id", records.zoned_timestamp(F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))).alias("at")),
    "http_status_codes": lambda s, d: table(s, d, "events").select((F.col("event_id") % 600).cast("int").alias("status")).groupBy("status").agg(F.count("*").alias("n")).select("status", "n", records.problem_code(F.col("status")).alias("problem")),
}

ORACLE = {
    "lexical_find": _bm25(_TEXTS, "text_id", _KEEP, QUERY.split(), 20),
    "lexical_find_run_scoped": _bm25(_TEXTS, "text_id", _KEEP, QUERY.split(), 20, where="run_key IN (SELECT run_key FROM runs WHERE fingerprint IS NOT NULL)"),
    "lexical_phrase": f"""
WITH {_TEXTS}, tok AS (SELECT text_id, {_TOKENS} AS tk FROM t WHERE text IS NOT NULL),
w AS (SELECT text_id, len(tk) AS len, len(list_filter(range(1, len(tk)), lambda i: tk[i] = 'benchmark' AND tk[i + 1] = 'table')) AS f0, len(list_filter(tk, lambda x: x = 'search')) AS f1 FROM tok),
s AS (SELECT count(*)::double AS n, avg(len)::double AS a, sum((f0 > 0)::int)::double AS d0, sum((f1 > 0)::int)::double AS d1 FROM w)
SELECT text_id FROM (SELECT text_id, round(-(greatest(ln((n - d0 + 0.5::double) / (d0 + 0.5::double)), 1e-6::double) * f0 * 2.2::double / (f0 + 1.2::double * (0.25::double + 0.75::double * len / a))
 + greatest(ln((n - d1 + 0.5::double) / (d1 + 0.5::double)), 1e-6::double) * f1 * 2.2::double / (f1 + 1.2::double * (0.25::double + 0.75::double * len / a))), 6) AS score FROM w, s WHERE f0 > 0 AND f1 > 0 ORDER BY score, text_id LIMIT 50)
""",
    "lexical_postings": f"""
WITH {_TEXTS}, tok AS (SELECT text_id, {_TOKENS} AS tk FROM t), p AS (SELECT text_id, unnest(tk) AS term, generate_subscripts(tk, 1) - 1 AS pos FROM tok)
SELECT term, count(*) AS texts, sum(tf)::bigint AS occurrences, sum(f)::bigint AS first_positions FROM (SELECT term, text_id, count(*) AS tf, min(pos) AS f FROM p GROUP BY ALL) GROUP BY term
""",
    "lexical_find_in_postings": f"SELECT text_id, score FROM ({_bm25(_TEXTS, 'text_id', _KEEP, QUERY.split(), 20)})".replace("WHERE text IS NOT NULL)", ")").replace("len(tk) AS len", "coalesce(len(tk), 0) AS len"),
    "page_find": "SELECT doc_id, locator, score FROM ("
    + _bm25(r"t AS (SELECT doc_id, 'page:' || generate_subscripts(p, 1) AS locator, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL))", "doc_id || '/' || locator AS key", "doc_id, locator", ["cached", "copy"], 30).replace("SELECT doc_id || '/' || locator AS key, doc_id, locator, len(tk)", "SELECT key, doc_id, locator, len(tk)").replace("SELECT doc_id || '/' || locator AS key, doc_id, locator, round", "SELECT key, doc_id, locator, round").replace("ORDER BY score, doc_id || '/' || locator AS key", "ORDER BY score, key")
    + ")",
    "snippet_highlight": f"""
SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(title, '\\s+', ' ', 'g'), ' '), lambda w: CASE WHEN regexp_matches({_FOLD.replace("text", "w")}, '(^|[^\\p{{L}}\\p{{N}}])(review|limits)($|[^\\p{{L}}\\p{{N}}])') THEN '[' || w || ']' ELSE w END), ' ') AS snippet
FROM documents WHERE title IS NOT NULL
""",
    "search_tokens": f"SELECT doc_id, len(tk)::int AS tokens, array_to_string(tk[1:5], ' ') AS first_tokens FROM (SELECT doc_id, {_TOKENS} AS tk FROM documents WHERE text IS NOT NULL)",
    "chunk_texts": r"""
WITH RECURSIVE ws AS (SELECT ' ' || chr(10) || chr(13) || chr(12) || chr(11) || chr(12288) || chr(160) || chr(133) || chr(8232) || chr(8233) || chr(8239) || chr(8195) || chr(8201) AS w),
n AS (SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), w) AS x FROM documents, ws WHERE text IS NOT NULL),
m AS (SELECT doc_id, x, length(x) AS n FROM n WHERE length(x) > 0),
c AS (
  SELECT doc_id, x, n, 0 AS pos, 0::bigint AS k FROM m
  UNION ALL
  SELECT doc_id, x, n, greatest(pos + 1, stop - 160), k + 1 FROM (
    SELECT doc_id, x, n, pos, k, CASE WHEN pos + 1400 >= n THEN n ELSE pos + 700 + greatest(last, 0) + (CASE WHEN last > 0 THEN 0 ELSE 700 END) END AS stop FROM (
      SELECT *, greatest(CASE WHEN strpos(r, chr(10)) > 0 THEN 701 - strpos(r, chr(10)) ELSE 0 END, CASE WHEN strpos(r, ' .') > 0 THEN 700 - strpos(r, ' .') ELSE 0 END) AS last
      FROM (SELECT *, reverse(substr(x, pos + 701, 700)) AS r FROM c))) WHERE stop < n),
cut AS (SELECT doc_id, k, pos, x, n, CASE WHEN pos + 1400 >= n THEN n ELSE pos + 700 + greatest(last, 0) + (CASE WHEN last > 0 THEN 0 ELSE 700 END) END AS stop FROM (
      SELECT *, greatest(CASE WHEN strpos(r, chr(10)) > 0 THEN 701 - strpos(r, chr(10)) ELSE 0 END, CASE WHEN strpos(r, ' .') > 0 THEN 700 - strpos(r, ' .') ELSE 0 END) AS last
      FROM (SELECT *, reverse(substr(x, pos + 701, 700)) AS r FROM c))),
p AS (SELECT doc_id, k, trim(substr(x, pos + 1, stop - pos), w) AS piece FROM cut, ws)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::int AS ordinal, length(piece)::int AS chars, sha256(piece) AS sha FROM p WHERE length(piece) > 0
""",
    "text_ids": """
SELECT DISTINCT 'txt:' || substr(sha256(concat(coalesce(run_key, ''), chr(0), coalesce(kind, ''), chr(0), coalesce(object_id, ''), chr(0), coalesce(locator, ''), chr(0), coalesce(ordinal::varchar, ''), chr(0), sha256(text))), 1, 28) AS derived_id, text_id FROM texts WHERE text IS NOT NULL
""",
    "run_keys": """
SELECT DISTINCT root, coalesce('run:' || nullif(string_split(run_key, ':')[-1], ''), 'run:' || substr(sha256(concat(coalesce(root, ''), chr(0), coalesce(query_sha256, ''))), 1, 24)) AS run_key, 'run:' || substr(sha256(concat(coalesce(root, ''), chr(0), coalesce(query_sha256, ''))), 1, 24) AS legacy_key FROM runs
""",
    "candidate_ids": "SELECT DISTINCT work_key, provider, 'P-' || substr(sha256(provider || ':' || work_key), 1, 16) AS derived_id FROM observations WHERE work_key IS NOT NULL AND provider IS NOT NULL",
    "doi_normalize": r"""
WITH r AS (SELECT DISTINCT candidate_id, json_extract_string(payload, '$.doi') AS raw FROM observations WHERE json_valid(payload)),
b AS (SELECT *, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^(doi:\s*|https?://(doi\.example|dx\.doi\.example)/)', '', 'i') AS bare FROM r WHERE raw IS NOT NULL)
SELECT candidate_id, raw, CASE WHEN regexp_full_match(bare, '10\.\d{4,9}/\S+') THEN lower(bare) END AS doi FROM b
""",
    "openalex_alias": r"""
WITH r AS (SELECT DISTINCT candidate_id, json_extract_string(payload, '$.provider_id') AS raw FROM observations WHERE json_valid(payload))
SELECT candidate_id, raw, CASE WHEN regexp_full_match(last, '[wW]\d+') THEN 'openalex:' || upper(last) END AS alias
FROM (SELECT *, string_split(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '/+$', ''), '/')[-1] AS last FROM r WHERE raw IS NOT NULL)
""",
    "url_redact": "SELECT doc_id, url || '?Token=REDACTED&q=' || doc_id || '&email=REDACTED' AS url FROM documents WHERE url IS NOT NULL",
    "nonempty_text": r"SELECT doc_id, coalesce(length(regexp_replace(text, '[\s\p{Z}\x{85}]+', '', 'g')) > 0, false) AS has_text, length(regexp_replace(coalesce(title, ''), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g'))::int AS title_chars FROM documents",
    "read_scope_locators": r"""
SELECT DISTINCT evidence, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS places FROM (SELECT evidence, regexp_extract_all(evidence, '\bpage:\d+\b|\bdocument\b') AS l FROM record_edges WHERE evidence IS NOT NULL)
""",
    "strict_json_errors": "SELECT run_key, candidate_id FROM observations WHERE payload IS NULL OR NOT json_valid(payload) OR json_type(payload) <> 'OBJECT'",
    "zoned_timestamps": "SELECT event_id, CASE WHEN event_type <> 'view' THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at FROM events",
    "http_status_codes": "SELECT status::int AS status, count(*) AS n, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 401 THEN 'auth_required' WHEN status = 403 THEN 'blocked' WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limited' ELSE 'http_error' END AS problem FROM (SELECT event_id % 600 AS status FROM events) GROUP BY status",
}
