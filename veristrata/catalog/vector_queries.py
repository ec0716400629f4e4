"""Vector search, stored vectors and windows over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.catalog.search_queries import _TEXTS, texts_of
from veristrata.catalog.tables import table
from veristrata.functions.text import window_snippet
from veristrata.functions.vectors import dot, vector_problem, vector_sha
from veristrata.operators import semantic

MODEL, REVISION, VERSION = "evidence-small", "r2", 2


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of the model as windows of their object: (run_key, object_id, window, vector)."""
    usable = table(spark, d, "text_embeddings").where((F.col("model") == MODEL) & (F.col("revision") == REVISION) & vector_problem(F.col("vector"), F.col("dimension")).isNull())
    vectors = usable.groupBy("text_id").agg(F.min("vector").alias("vector"))
    return vectors.join(texts_of(spark, d).select("text_id", "run_key", "object_id", "ordinal"), "text_id").select("text_id", "run_key", "object_id", F.col("ordinal").alias("window"), "vector").where("object_id IS NOT NULL")


def _max_similarity(spark: SparkSession, d: str) -> DataFrame:
    windows = _windows(spark, d)
    asked = windows.orderBy("text_id").limit(2).select("vector")
    return semantic.max_similarity(windows, asked, key="object_id")


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    windows = _windows(spark, d)
    asked = windows.orderBy(F.desc("text_id")).limit(1).select("vector")
    runs = table(spark, d, "runs").where("fingerprint IS NOT NULL")
    return semantic.max_similarity(windows, asked, limit=50, key="object_id", eligible=runs)


def _characters() -> semantic.Tokenizer:
    """Each character is a token, and two frame a window."""
    return (lambda text: range(1, len(text) + 1)), 2


def _token_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return semantic.token_windows(docs, ["doc_id"], _characters, 512)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Windows of up to 512 tokens held against a budget of 400."""
    lengths = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").alias("length"))
    return semantic.span_problems(_token_windows(spark, d).drop("window"), ["doc_id"], lengths, 400)


def _window_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", window_snippet(F.col("text"), F.lit(100), F.lit(900)).alias("snippet"))


def _new_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All texts, and those that were known by the end of November 2024; contents repeat across runs, so kinds stand in for them."""
    texts = texts_of(spark, d).withColumn("run_key", F.col("kind"))
    known = table(spark, d, "texts").where("synced_at < TIMESTAMP_NTZ '2024-12-01 00:00:00'").select("text_id").distinct()
    return texts, texts.join(known, "text_id", "left_semi")


def _reuse(spark: SparkSession, d: str) -> DataFrame:
    new, old = _new_texts(spark, d)
    return semantic.reusable_vectors(new, old, table(spark, d, "text_embeddings"), VERSION)


_PROBLEM = """CASE WHEN vector IS NULL OR dimension IS NULL THEN 'missing' WHEN len(vector) <> dimension THEN 'dimension'
  WHEN list_bool_or(list_transform(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) THEN 'not_finite'
  WHEN abs(sqrt(list_sum(list_transform(vector::double[], lambda x: x * x))) - 1) > 1e-4 THEN 'not_unit' END"""
_WINDOWS = f"""{_TEXTS}, u AS (SELECT text_id, min(vector) AS vector FROM text_embeddings WHERE model = '{MODEL}' AND revision = '{REVISION}' AND ({_PROBLEM}) IS NULL GROUP BY text_id),
w AS (SELECT u.text_id, t.run_key, t.object_id, t.ordinal AS window, u.vector::double[] AS vector FROM u JOIN t USING (text_id) WHERE t.object_id IS NOT NULL)"""


def _max_sql(queries: str, where: str, limit: int) -> str:
    return f"""WITH {_WINDOWS}, q AS ({queries}),
s AS (SELECT w.object_id, max({{'score': round(greatest(-1, least(1, list_dot_product(w.vector, q.vector))), 6), 'window': w.window}}) AS m FROM w, q WHERE {where} GROUP BY w.object_id)
SELECT object_id, m.score AS score, m.window AS "window" FROM s ORDER BY score DESC, object_id LIMIT {limit}"""


QUERIES = {
    "semantic_maxsim": _max_similarity,
    "semantic_maxsim_run_scoped": _scoped,
    "vector_validity": lambda s, d: semantic.vector_problems(table(s, d, "text_embeddings")),
    "vector_norms": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.length(vector_sha(F.col("embedding"))).alias("sha_digits")),
    "vector_centroids": lambda s, d: table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("column", "x")).groupBy("label", "column").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count("*").alias("n")),
    "embedding_pending": lambda s, d: semantic.pending_texts(texts_of(s, d), table(s, d, "text_embeddings"), MODEL, REVISION, VERSION),
    "embedding_ready_status": lambda s, d: semantic.readiness(texts_of(s, d), table(s, d, "text_embeddings"), MODEL, REVISION, VERSION),
    "embedding_not_configured": lambda s, d: semantic.readiness(texts_of(s, d), table(s, d, "text_embeddings"), None, None, VERSION),
    "vector_reuse": _reuse,
    "token_windows": _token_windows,
    "span_validation": _spans,
    "window_snippets": _window_snippets,
}

_PENDING = f"t2 AS (SELECT DISTINCT run_key, text_id, text_sha256 FROM t), r AS (SELECT DISTINCT text_id, text_sha256 FROM text_embeddings WHERE model = '{MODEL}' AND revision = '{REVISION}' AND chunk_version = {VERSION} AND vector IS NOT NULL), p AS (SELECT * FROM t2 WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.text_id = t2.text_id AND r.text_sha256 = t2.text_sha256))"

_SPANS = """WITH RECURSIVE d AS (SELECT doc_id, text AS x, length(text) AS n FROM documents WHERE text IS NOT NULL),
c AS (
  SELECT doc_id, x, n, 0 AS s, 0 AS k FROM d
  UNION ALL
  SELECT doc_id, x, n, greatest(s + 1, e - 16), k + 1 FROM (SELECT *, CASE WHEN s + 510 >= n THEN n WHEN last > 0 THEN s + 255 + last ELSE s + 510 END AS e FROM (
    SELECT *, greatest(CASE WHEN strpos(r, ' ') > 0 THEN 256 - strpos(r, ' ') ELSE 0 END, CASE WHEN strpos(r, chr(10)) > 0 THEN 256 - strpos(r, chr(10)) ELSE 0 END) AS last FROM (SELECT *, reverse(substr(x, s + 256, 255)) AS r FROM c))) WHERE e < n),
w AS (SELECT doc_id, k, s, n, CASE WHEN s + 510 >= n THEN n WHEN last > 0 THEN s + 255 + last ELSE s + 510 END AS e FROM (
    SELECT *, greatest(CASE WHEN strpos(r, ' ') > 0 THEN 256 - strpos(r, ' ') ELSE 0 END, CASE WHEN strpos(r, chr(10)) > 0 THEN 256 - strpos(r, chr(10)) ELSE 0 END) AS last FROM (SELECT *, reverse(substr(x, s + 256, 255)) AS r FROM c)))
"""

ORACLE = {
    "token_windows": _SPANS + 'SELECT doc_id, k AS "window", s AS start, e AS "end", e - s + 2 AS tokens FROM w',
    "span_validation": _SPANS + "SELECT DISTINCT doc_id, 'budget' AS problem FROM w WHERE e - s + 2 > 400",
    "semantic_maxsim": _max_sql("SELECT vector FROM w ORDER BY text_id LIMIT 2", "true", 20),
    "semantic_maxsim_run_scoped": _max_sql("SELECT vector FROM w ORDER BY text_id DESC LIMIT 1", "w.run_key IN (SELECT run_key FROM runs WHERE fingerprint IS NOT NULL)", 50),
    "vector_validity": f"SELECT text_id, backend, model, revision, {_PROBLEM} AS problem FROM text_embeddings WHERE ({_PROBLEM}) IS NOT NULL",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) AS norm, 64 AS sha_digits FROM embeddings",
    "vector_centroids": 'SELECT label, "column", round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding::double[]) AS x, (generate_subscripts(embedding, 1) - 1)::int AS "column" FROM embeddings) GROUP BY ALL',
    "embedding_pending": f"WITH {_TEXTS}, {_PENDING} SELECT run_key, text_id, text_sha256 FROM p",
    "embedding_ready_status": f"WITH {_TEXTS}, {_PENDING}, a AS (SELECT run_key, count(*) AS total FROM t2 GROUP BY 1), b AS (SELECT run_key, count(*) AS pending FROM p GROUP BY 1) SELECT a.run_key, total, total - coalesce(pending, 0) AS ready, coalesce(pending, 0) AS pending, CASE WHEN coalesce(pending, 0) > 0 THEN 'pending' ELSE 'ready' END AS status FROM a LEFT JOIN b ON a.run_key IS NOT DISTINCT FROM b.run_key",
    "embedding_not_configured": f"WITH {_TEXTS} SELECT run_key, count(*) AS total, 0::bigint AS ready, count(*) AS pending, 'not_configured' AS status FROM t GROUP BY run_key",
    "vector_reuse": f"""WITH {_TEXTS}, tk AS (SELECT * REPLACE (kind AS run_key) FROM t), old AS (SELECT * FROM tk WHERE text_id IN (SELECT text_id FROM texts WHERE synced_at < TIMESTAMP '2024-12-01')),
w AS (SELECT DISTINCT run_key, text_id, text_sha256 FROM tk WHERE text_id NOT IN (SELECT text_id FROM old)),
st AS (SELECT DISTINCT o.run_key, o.text_sha256, e.backend, e.model, e.revision, o.text_id FROM old o JOIN text_embeddings e ON e.text_id = o.text_id AND e.text_sha256 = o.text_sha256 WHERE e.vector IS NOT NULL AND e.chunk_version = {VERSION}),
dn AS (SELECT run_key, text_sha256, backend, model, revision, min(text_id) AS from_text_id FROM st GROUP BY ALL)
SELECT w.text_id, from_text_id, backend, model, revision FROM w JOIN dn ON w.run_key = dn.run_key AND w.text_sha256 = dn.text_sha256""",
    "window_snippets": "SELECT doc_id, substr(text, 101, 500) AS snippet FROM documents WHERE text IS NOT NULL",
}
