"""Building and refreshing the derived tables of an index: texts, postings, graph, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.functions.identifiers import DOI_HOSTS, sha, text_id
from veristrata.functions.text import chunked
from veristrata.operators import graph, incremental, search
from veristrata.plans.lineage import cut

TEXT_COLUMNS = ("text_id", "run_key", "kind", "object_id", "locator", "ordinal", "text", "text_sha256")


def desired_texts(sources: dict[str, DataFrame]) -> DataFrame:
    """The stored texts that an index of ``sources`` should have, each once.

    sources: kind -> (run_key, object_id, locator, text), such as documents, evidence, reports, queries
    and the strings of records. Texts are cut into chunks; a text_id is derived from all that
    identifies a chunk and from its content. Null and blank texts have none.
    """
    keys = ["run_key", "kind", "object_id", "locator"]
    rows = reduce(DataFrame.unionByName, [df.select("run_key", F.lit(kind).alias("kind"), F.col("object_id").cast("string").alias("object_id"), "locator", "text") for kind, df in sources.items()])
    pieces = chunked(rows, keys)
    made = pieces.select(text_id(*[F.col(c) for c in (*keys, "ordinal", "text")]).alias("text_id"), *keys, "ordinal", "text", sha(F.col("text")).alias("text_sha256"))
    return made.dropDuplicates(["text_id"]).select(*TEXT_COLUMNS)


def text_changes(stored: DataFrame, desired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts to add and text_ids to remove; a text_id stands for its content, so nothing is changed in place."""
    return desired.join(stored.select("text_id"), "text_id", "left_anti"), stored.select("text_id").join(desired.select("text_id"), "text_id", "left_anti")


def refreshed_postings(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The inverted index after texts are added and removed; the postings of other texts are kept as they are."""
    return index.join(removed.select("text_id"), "text_id", "left_anti").select("term", "text_id", "tf", "positions").unionByName(search.postings(added).select("term", "text_id", "tf", "positions"))


def graph_tables(observations: DataFrame, hosts: tuple[str, ...] = DOI_HOSTS) -> dict[str, DataFrame]:
    """All tables of the citation graph, rebuilt from the observations alone: names, identities, edges, audits, works."""
    parsed = cut(graph.parsed_observations(observations, hosts))
    names = cut(graph.alias_works(parsed))
    items = cut(graph.citation_edges(parsed, names, hosts))
    edges = graph.distinct_edges(items)
    return {"names": names, "identities": graph.observation_works(parsed, names), "edges": edges, "audits": graph.citation_audit(items), "works": graph.works(parsed, names, items)}


def snapshot(tables: dict[str, tuple[DataFrame, list[str]]], by: str = "run_key") -> DataFrame:
    """(by, tables, rows, fingerprint): one fingerprint for each run over the named columns of several tables."""
    parts = [incremental.fingerprints(df, [by], columns).select(by, F.lit(name).alias("t"), "rows", "fingerprint") for name, (df, columns) in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(by).agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"), F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("t", "fingerprint")))), 256).alias("fingerprint"))


def initialized(df: DataFrame, path: str) -> None:
    """Write a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)
