"""Building an index from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.catalog.graph_queries import _NAMES
from veristrata.catalog.search_queries import HOSTS
from veristrata.catalog.search_queries import ORACLE as SEARCH
from veristrata.catalog.tables import table
from veristrata.operators import index, search


def _desired(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("run_key", F.col("global_id").alias("object_id"), F.lit("document").alias("locator"), "text", "title")
    return index.desired_texts({"document": docs, "query": docs.withColumns({"locator": F.lit("title"), "text": F.col("title")})})


def _changes(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "texts").where("text_id IS NOT NULL").select("text_id").distinct()
    added, removed = index.text_changes(stored, _desired(spark, d))
    return added.groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit("add "), "kind").alias("change"), "n").unionByName(removed.agg(F.count("*").alias("n")).select(F.lit("remove").alias("change"), "n"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """The index of the texts of November 2024, brought to that of all texts."""
    rows = table(spark, d, "texts").where("text_id IS NOT NULL").groupBy("text_id").agg(F.min("text").alias("text"), F.min("synced_at").alias("at"))
    old, new = rows.where("at < TIMESTAMP_NTZ '2024-12-01 00:00:00'"), rows.where("at >= TIMESTAMP_NTZ '2024-06-01 00:00:00'")
    added, removed = index.text_changes(old, new)
    return index.refreshed_postings(search.postings(old), added, removed).groupBy("term").agg(F.count("*").alias("texts"), F.sum("tf").alias("occurrences"))


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    docs, texts = table(spark, d, "documents"), table(spark, d, "texts")
    columns = {"documents": (docs, ["global_id", "sha256", "title"]), "texts": (texts, ["text_id", "text_sha256"])}
    one = index.snapshot(columns)
    two = index.snapshot({n: (df.unionByName(df).repartition(5), c) for n, (df, c) in columns.items()}).select(F.col("run_key").alias("__run"), F.col("fingerprint").alias("again"))
    same = one.run_key.eqNullSafe(two["__run"])
    return one.join(two, same).select("run_key", "tables", "rows", (F.col("fingerprint") == F.col("again")).alias("same"))


QUERIES = {
    "index_texts": lambda s, d: _desired(s, d).select("text_id", "kind", "object_id", "ordinal", F.length("text").alias("chars"), "text_sha256"),
    "index_text_changes": _changes,
    "index_postings_refreshed": _postings,
    "index_snapshot": _snapshot,
    "index_graph_identities": lambda s, d: index.graph_tables(table(s, d, "observations"), HOSTS)["identities"],
}

_CHUNKS = SEARCH["chunk_texts"]
_BASE = _CHUNKS[: _CHUNKS.index("SELECT doc_id, (row_number()")]
_DESIRED = (
    _BASE.replace("FROM documents, ws WHERE text IS NOT NULL", "FROM src, ws WHERE text IS NOT NULL").replace(
        "n AS (SELECT doc_id",
        "src AS (SELECT {'r': run_key, 'k': 'document', 'o': global_id, 'l': 'document'} AS doc_id, text FROM documents UNION ALL SELECT {'r': run_key, 'k': 'query', 'o': global_id, 'l': 'title'}, title FROM documents),\nn AS (SELECT doc_id",
        1,
    )
    + """,
g AS (SELECT DISTINCT doc_id.r AS run_key, doc_id.k AS kind, doc_id.o AS object_id, doc_id.l AS locator, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::int AS ordinal, piece FROM p WHERE length(piece) > 0),
q AS (SELECT 'txt:' || substr(sha256(concat(coalesce(run_key, ''), chr(0), kind, chr(0), coalesce(object_id, ''), chr(0), locator, chr(0), ordinal::varchar, chr(0), sha256(piece))), 1, 28) AS text_id, * FROM g)
"""
)

ORACLE = {
    "index_texts": _DESIRED + "SELECT text_id, kind, object_id, ordinal, length(piece)::int AS chars, sha256(piece) AS text_sha256 FROM q",
    "index_text_changes": _DESIRED
    + "SELECT 'add ' || kind AS change, count(*) AS n FROM q WHERE text_id NOT IN (SELECT text_id FROM texts WHERE text_id IS NOT NULL) GROUP BY kind UNION ALL SELECT 'remove', count(DISTINCT text_id) FROM texts WHERE text_id IS NOT NULL AND text_id NOT IN (SELECT text_id FROM q)",
    "index_postings_refreshed": SEARCH["lexical_postings"][: SEARCH["lexical_postings"].index("SELECT term,")].replace(
        SEARCH["lexical_postings"][SEARCH["lexical_postings"].index("t AS (") : SEARCH["lexical_postings"].index(", tok AS")],
        "t AS (SELECT text_id, min(text) AS text FROM texts WHERE text_id IS NOT NULL GROUP BY text_id HAVING min(synced_at) >= TIMESTAMP '2024-06-01')",
    )
    + "SELECT term, count(DISTINCT text_id) AS texts, count(*) AS occurrences FROM p GROUP BY term",
    "index_graph_identities": f"WITH {_NAMES} SELECT f.run_key, f.candidate_id, names.work_key FROM f JOIN names ON names.alias = f.first",
    "index_snapshot": "SELECT run_key, sum((n > 0)::int)::bigint AS tables, sum(n)::bigint AS rows, true AS same FROM (SELECT run_key, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT run_key, count(*) FROM texts GROUP BY 1) GROUP BY run_key",
}
