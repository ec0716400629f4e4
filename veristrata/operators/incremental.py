"""Differences, upserts and fingerprints of tables, and generations of stored tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _hash(df: DataFrame, columns: list[str]) -> F.Column:
    """Hash of a row; equal exactly for equal rows, nulls and types included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., change) for every key of either table: added, removed, changed or unchanged.

    One full outer join on keys and row hashes; only hashes are shuffled beside the keys. Keys
    compare null-safely. Repeated keys must not occur.
    """
    values = sorted(set(old.columns) - set(keys))
    tag = F.xxhash64(*keys, *[F.col(k).isNull() for k in keys])
    one = old.select(*[F.col(k).alias(f"__o_{k}") for k in keys], tag.alias("__ok"), _hash(old, values).alias("__old"))
    two = new.select(*[F.col(k).alias(f"__n_{k}") for k in keys], tag.alias("__nk"), _hash(new, values).alias("__new"))
    same = F.col("__ok") == F.col("__nk")
    for k in keys:
        same = same & F.col(f"__o_{k}").eqNullSafe(F.col(f"__n_{k}"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return one.join(two, same, "full_outer").select(*[F.coalesce(f"__o_{k}", f"__n_{k}").alias(k) for k in keys], change.alias("change"))


def change_counts(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    kinds = ("added", "removed", "changed", "unchanged")
    return changes.groupBy(*(by or [])).agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def reconciled(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to write so that the stored table equals ``new``: added and changed ones; removed keys are in ``difference``."""
    todo = difference(old, new, keys).where("change IN ('added', 'changed')")
    same = None
    a, b = new.alias("n"), todo.alias("t")
    for k in keys:
        part = F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}"))
        same = part if same is None else same & part
    return a.join(b, same, "left_semi")


def replaced(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace: of each key the new row, else the old; of several new rows the last in ``order``."""
    rows = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)))
    window = Window.partitionBy(*keys).orderBy(F.desc("__g"), *[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n", "__g")


def kept_first(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or ignore: of each key the old row, else the first new one in ``order``."""
    rows = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)))
    window = Window.partitionBy(*keys).orderBy("__g", *order)
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n", "__g")


def coalesced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert in which a null of the new row leaves the old value. Keys are unique in either table."""
    values = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    return rows.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in values])


def fingerprints(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by.., rows, fingerprint): a fingerprint of the distinct rows of each group, whatever their order.

    The four quarters of the row hashes are summed up, which partial aggregation does without
    gathering anything, however many rows a group has; the fingerprint is the hash of these sums.
    """
    rows = df.select(*by, _hash(df, sorted(columns)).alias("h")).groupBy(*by, "h").agg(F.count("*").alias("n"))
    quarter = lambda i: F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy(*by).agg(F.sum("n").alias("rows"), *[F.sum(quarter(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)])
    return sums.select(*by, "rows", F.sha2(F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


class Generations:
    """A stored table in generations: readers see the latest one that has a manifest, a writer adds the next and then its manifest.

    Paths are used through Hadoop's file system, so any shared storage works. Every write goes to a
    folder of its own and manifests are numbered and only ever created: of two writers that start from
    the same generation one succeeds, and a writer that dies leaves the live generation as it was.
    """

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of all manifests, the latest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted((int(n[9:-5]) for n in names if n.startswith("MANIFEST-") and n.endswith(".json")), reverse=True)

    def manifest(self) -> dict:
        """The live manifest: generation (0 before the first), folder, fingerprint, at. One that a writer died over is passed over."""
        for number in self._numbers():
            text = "\n".join(r.value for r in self.spark.read.text(f"{self.root}/MANIFEST-{number:08d}.json").collect())
            try:
                return json.loads(text)
            except ValueError:
                continue
        return {"generation": 0, "fingerprint": None, "folder": None}

    def read(self) -> DataFrame | None:
        """The live generation, or None before the first."""
        folder = self.manifest()["folder"]
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else None

    def commit(self, df: DataFrame, fingerprint: str, partition_by: tuple[str, ...] = ("run_key",), guard: Callable[[], bool] | None = None) -> str:
        """Write the next generation and make it live; ``unchanged`` without a write if the fingerprint is that of the live one.

        guard: asked after the write; if it says no (the inputs have changed meanwhile), nothing becomes live.
        """
        before, number = self.manifest(), max(self._numbers(), default=0) + 1
        if before["generation"] and before["fingerprint"] == fingerprint:
            return "unchanged"
        folder = f"gen-{number:08d}-{uuid4().hex}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{folder}")
        value = {"generation": number, "fingerprint": fingerprint, "folder": folder, "at": time.time()}
        if (guard is not None and not guard()) or not self._created(f"MANIFEST-{number:08d}.json", json.dumps(value)):
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise RuntimeError("the inputs changed or another writer has committed; read again and retry")
        return "committed"

    def _created(self, name: str, text: str) -> bool:
        """Create the manifest, unless there is one of that number."""
        try:
            out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Exception as error:
            if self._fs.exists(self._path(f"{self.root}/{name}")):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True


def without_runs(tables: dict[str, DataFrame], runs: DataFrame) -> dict[str, DataFrame]:
    """Forget runs: every table without the rows of ``runs`` (run_key). Rows with a null run_key stay."""
    return {n: t.join(runs.select("run_key").distinct(), "run_key", "left_anti") for n, t in tables.items()}


def latest_valid(cache: DataFrame, key: str, at: str, expires: str, now: F.Column) -> DataFrame:
    """The latest row of each key, if it has not expired."""
    last = cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), F.struct(at, expires)).alias("r")).select(key, "r.*")
    return last.where(F.col(expires) > now)


def slot_delays(requests: DataFrame, provider: str, at: str, interval: float, now: F.Column) -> DataFrame:
    """(provider, delay): seconds to wait before the next request, from 0 to ``interval``."""
    left = F.unix_micros(F.max(F.col(at).cast("timestamp"))) / 1e6 + interval - F.unix_micros(now.cast("timestamp")) / 1e6
    return requests.groupBy(provider).agg(F.greatest(F.lit(0.0), F.least(F.lit(float(interval)), left)).alias("delay"))


def registered_twice(runs: DataFrame) -> DataFrame:
    """(kind, value, conflicts): paths under several run keys and run keys at several paths."""
    roots = runs.where("root IS NOT NULL").groupBy("root").agg(F.count_distinct("run_key").alias("n")).where("n > 1")
    keys = runs.where("run_key IS NOT NULL").groupBy("run_key").agg(F.count_distinct("root").alias("n")).where("n > 1")
    return roots.select(F.lit("path").alias("kind"), F.col("root").alias("value"), F.col("n").alias("conflicts")).unionByName(keys.select(F.lit("run").alias("kind"), F.col("run_key").alias("value"), F.col("n").alias("conflicts")))


def run_states(runs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(run_key, status): new, current or stale, from the recorded and the present fingerprint; the latest registration counts."""
    last = runs.where("run_key IS NOT NULL").groupBy("run_key").agg(F.max_by("fingerprint", F.struct("synced_at", "fingerprint")).alias("recorded"))
    rows = last.join(fingerprints.select("run_key", "fingerprint"), "run_key", "full_outer")
    status = F.when(F.col("fingerprint").isNull(), "missing").when(F.col("recorded").isNull(), "new").when(F.col("recorded") == F.col("fingerprint"), "current").otherwise("stale")
    return rows.select("run_key", status.alias("status"))
