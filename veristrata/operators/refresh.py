"""Refreshing the stored tables of an index in one call, and who may be read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.identifiers import DOI_HOSTS, sha
from veristrata.functions.vectors import vector_problem
from veristrata.operators import incremental, index, search, semantic

VECTOR_COLUMNS = ("text_id", "backend", "model", "revision", "dimension", "vector", "text_sha256", "chunk_version")
VECTORS = "text_id string, backend string, model string, revision string, dimension int, vector array<float>, text_sha256 string, chunk_version int"


def whole_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """One fingerprint of all distinct rows, whatever their order."""
    row = incremental.fingerprints(df.withColumn("__all", F.lit(1)), ["__all"], columns).first()
    return row.fingerprint if row else "empty"


class Index:
    """The stored tables of an index below ``root``: texts, postings, vectors, and the tables of the citation graph.

    ``refresh`` brings them up to date with their sources. Readers see a table as it was before until
    its next generation is complete.
    """

    TABLES = ("texts", "postings", "vectors", "names", "identities", "edges", "audits", "works")

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.stores = {n: incremental.Generations(spark, f"{self.root}/{n}") for n in self.TABLES}

    def table(self, name: str) -> DataFrame | None:
        return self.stores[name].read()

    def refresh(self, sources: dict[str, DataFrame], observations: DataFrame | None = None, hosts: tuple[str, ...] = DOI_HOSTS, chunk_version: int = 1) -> dict[str, str]:
        """table -> committed or unchanged.

        sources: see ``index.desired_texts``. Texts are compared by text_id: only new ones get
        postings, vectors of texts that left go, and new texts of the same run and content take the
        vectors of old ones over. The graph is rebuilt only if observations have changed. If a source
        changes while it is read, nothing of it becomes live and RuntimeError is raised.
        """
        done: dict[str, str] = {}
        of_sources = lambda: whole_fingerprint(reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), *[F.col(c).cast("string").alias(c) for c in ("run_key", "object_id", "locator", "text")]) for k, df in sources.items()]), ["kind", "run_key", "object_id", "locator", "text"])
        before = of_sources()
        if self.stores["texts"].manifest()["fingerprint"] == before:
            done |= {n: "unchanged" for n in ("texts", "postings", "vectors")}
        else:
            done |= self._refresh_texts(index.desired_texts(sources), before, lambda: of_sources() == before, chunk_version)
        if observations is not None:
            columns = ["run_key", "candidate_id", "provider", "payload", "observed_at"]
            of_graph = lambda: whole_fingerprint(observations, columns)
            before = of_graph()
            graph_names = ("names", "identities", "edges", "audits", "works")
            if all(self.stores[n].manifest()["fingerprint"] == before for n in graph_names):
                done |= {n: "unchanged" for n in graph_names}
            else:
                for name, df in index.graph_tables(observations, hosts).items():
                    done[name] = self.stores[name].commit(df, before, (), lambda: of_graph() == before)
        return done

    def _refresh_texts(self, desired: DataFrame, fingerprint: str, guard: Callable[[], bool], chunk_version: int) -> dict[str, str]:
        from veristrata.plans.lineage import cut, release

        desired = cut(desired)
        stored = self.table("texts")
        old = stored if stored is not None else desired.limit(0)
        added, removed = index.text_changes(old, desired)
        added, removed = cut(added), cut(removed)
        postings = self.table("postings")
        postings = search.postings(added).select("term", "text_id", "tf", "positions") if postings is None else index.refreshed_postings(postings, added, removed)
        vectors = self.table("vectors")
        vectors = vectors if vectors is not None else self.spark.createDataFrame([], VECTORS)
        taken = semantic.reusable_vectors(desired, old, vectors, chunk_version)
        donor = vectors.where(F.col("chunk_version") == chunk_version).select(F.col("text_id").alias("from_text_id"), "backend", "model", "revision", "dimension", "vector", "text_sha256", "chunk_version").dropDuplicates(["from_text_id", "backend", "model", "revision"])
        carried = taken.join(donor, ["from_text_id", "backend", "model", "revision"]).select(*VECTOR_COLUMNS)
        vectors = vectors.join(removed, "text_id", "left_anti").select(*VECTOR_COLUMNS).unionByName(carried)
        out = {"postings": self.stores["postings"].commit(postings, fingerprint, (), guard), "vectors": self.stores["vectors"].commit(vectors, fingerprint, (), guard)}
        out["texts"] = self.stores["texts"].commit(desired, fingerprint, (), guard)  # last: what it names has then been written
        release(desired, added, removed)
        return out

    def embed(self, encode: Callable[[], Callable[[list[str]], list[list[float]]]], backend: str, model: str, revision: str, dimension: int, chunk_version: int = 1, batch: int = 32) -> int:
        """Make the vectors that texts lack and store them; returns their number. A second call makes none."""
        texts, vectors = self.table("texts"), self.table("vectors")
        if texts is None:
            return 0
        vectors = vectors if vectors is not None else self.spark.createDataFrame([], VECTORS)
        from veristrata.plans.lineage import cut, release, seen

        made = cut(embedded(texts, vectors, encode, backend, model, revision, dimension, chunk_version, batch))
        count = seen(made)
        if count:
            self.stores["vectors"].commit(vectors.unionByName(made), whole_fingerprint(made, ["text_id", "model", "revision"]), ())
        release(made)
        return count

    def find(self, words: list[str], limit: int = 20) -> DataFrame:
        """Ranked search over the stored postings; hits whose stored text no longer has its hash are left out."""
        texts, postings = self.table("texts"), self.table("postings")
        lengths = texts.select("text_id").join(postings.groupBy("text_id").agg(F.sum("tf").alias("len")), "text_id", "left").select("text_id", F.coalesce("len", F.lit(0)).alias("len"))
        return search.find_in_postings(postings, lengths, words, limit).join(verified(texts).select("text_id"), "text_id", "left_semi").orderBy("score", "text_id")


def embedded(texts: DataFrame, vectors: DataFrame, encode: Callable[[], Callable[[list[str]], list[list[float]]]], backend: str, model: str, revision: str, dimension: int, chunk_version: int, batch: int = 32) -> DataFrame:
    """Vectors (VECTOR_COLUMNS) of the texts that have none for their present content.

    encode: makes, once in each worker, what turns a list of texts into as many vectors. A wrong
    number of vectors or a vector that is not finite, of another dimension or of another length than 1
    is an error.
    """
    pending = semantic.pending_texts(texts, vectors, model, revision, chunk_version).select("text_id", "text_sha256").distinct()
    wanted = texts.select("text_id", "text_sha256", "text").dropDuplicates(["text_id", "text_sha256"]).join(pending, ["text_id", "text_sha256"], "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encode()
        for rows in batches:
            for a in range(0, len(rows), batch):
                part = rows.iloc[a : a + batch]
                got = [[float(x) for x in v] for v in made(part["text"].tolist())]
                if len(got) != len(part) or any(len(v) != dimension or not abs(sum(x * x for x in v) - 1) <= 2e-4 for v in got):
                    raise ValueError("the encoder broke its protocol")
                yield pd.DataFrame({"text_id": part["text_id"].tolist(), "backend": backend, "model": model, "revision": revision, "dimension": dimension, "vector": got, "text_sha256": part["text_sha256"].tolist(), "chunk_version": chunk_version})

    return wanted.mapInPandas(run, VECTORS)


def verified(df: DataFrame, text: str = "text", recorded: str = "text_sha256") -> DataFrame:
    """Rows whose text has its recorded hash; others were changed and are not shown."""
    return df.where(sha(F.col(text)) == F.col(recorded))


def read_pages(documents: DataFrame, pages: DataFrame, document_id: Column | str, locator: str | None = None) -> DataFrame:
    """The pages (document_id, locator, text, sha256) of one document, or one page of it; RuntimeError if one was changed."""
    one = pages.join(documents.where(F.col("document_id") == document_id).select("document_id"), "document_id", "left_semi")
    one = one.where(F.col("locator") == locator) if locator else one
    if not one.where(~F.coalesce(sha(F.col("text")) == F.col("sha256"), F.lit(False))).isEmpty():
        raise RuntimeError("a stored page was changed")
    return one


def eligible_runs(states: DataFrame, blocks: DataFrame, allow_stale: bool = False) -> DataFrame:
    """(run_key, status, eligible): current runs, stale ones on request; never blocked ones, or ones registered at several paths.

    states: (run_key, status); blocks: (run_key, scope), of which ``local`` and ``off`` block and
    ``identity_conflict`` names a run that is registered twice.
    """
    barred = blocks.where(F.col("scope").isin("local", "off", "identity_conflict")).groupBy("run_key").agg(F.min("scope").alias("scope"))
    rows = states.join(barred, "run_key", "left")
    wanted = ("current", "stale") if allow_stale else ("current",)
    return rows.select("run_key", F.coalesce("scope", "status").alias("status"), (F.col("scope").isNull() & F.coalesce(F.col("status").isin(*wanted), F.lit(False))).alias("eligible"))


def with_scope(runs: DataFrame, run_key: str, scope: str) -> DataFrame:
    """``runs`` (run_key, scope, ..) with the scope of one run changed to global, local or off."""
    if scope not in ("global", "local", "off"):
        raise ValueError("unknown scope")
    return runs.withColumn("scope", F.when(F.col("run_key") == run_key, scope).otherwise(F.col("scope")))


def relocated(runs: DataFrame, run_key: str, new_root: str, exists: Callable[[str], bool]) -> DataFrame:
    """``runs`` with one run at another path. Refused while its old path exists, or if the new one belongs to another run."""
    rows = runs.where((F.col("run_key") == run_key) | (F.col("root") == new_root)).select("run_key", "root").distinct().limit(100).collect()
    old = {r.root for r in rows if r.run_key == run_key}
    if not old:
        raise ValueError("unknown run")
    if any(r.root == new_root and r.run_key != run_key for r in rows) or any(exists(p) for p in old - {new_root}):
        raise RuntimeError("identity conflict")
    return runs.withColumn("root", F.when(F.col("run_key") == run_key, new_root).otherwise(F.col("root")))


def forked(runs: DataFrame, root: str, new_key: str, synced_at: Column) -> DataFrame:
    """``runs`` with a copy at an unregistered path as a run of its own."""
    if not runs.where((F.col("root") == root) | (F.col("run_key") == new_key)).isEmpty():
        raise RuntimeError("identity conflict")
    fresh = {"run_key": F.lit(new_key), "root": F.lit(root), "synced_at": synced_at}
    one = runs.sparkSession.range(1).select(*[fresh.get(c, F.lit(None)).cast(t).alias(c) for c, t in runs.dtypes])
    return runs.unionByName(one)


def migrated(df: DataFrame, wanted: str, backfill: dict[str, Column] | None = None) -> DataFrame:
    """A stored table of an older schema with the columns of ``wanted`` (DDL): missing ones are backfilled, or null; others are dropped."""
    from pyspark.sql.types import StructType

    have, backfill = set(df.columns), backfill or {}
    return df.select(*[(F.col(f.name) if f.name in have else backfill.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(wanted)])


def windows_of_vectors(windows: DataFrame) -> DataFrame:
    """(text_id, problem) of stored windows (text_id, window, vector, dimension) that cannot be searched: gaps in their numbers, or a vector that does not fit."""
    bad = windows.withColumn("problem", vector_problem(F.col("vector"), F.col("dimension")))
    gaps = windows.groupBy("text_id").agg(F.count("*").alias("n"), F.max("window").alias("last"), F.count_distinct("window").alias("d")).where("last + 1 <> n OR d <> n")
    return bad.where("problem IS NOT NULL").select("text_id", "problem").unionByName(gaps.select("text_id", F.lit("windows").alias("problem"))).distinct()
