"""Cutting the lineage of iterative plans in storage that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made_here: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session for tables between the rounds of a plan.

    ``spark.checkpoint.dir`` names it. Only where that is unset and the master is local (tests, a
    laptop) a temporary folder is made, which is removed when Python ends; a cluster without the
    setting is refused, as a folder of one machine is not seen by the others.
    """
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if wanted:
        return wanted.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "local" not in _made_here:
        _made_here["local"] = tempfile.mkdtemp(prefix="veristrata-")
        atexit.register(shutil.rmtree, _made_here["local"], ignore_errors=True)
    return "file://" + _made_here["local"]


def cut(df: DataFrame, *spent: DataFrame, **counted: Column) -> DataFrame:
    """``df``, written as a table of the shared folder and read back: without its lineage, with its real size.

    A lost executor costs at most the reading of the table. ``spent`` are results of earlier cuts
    that nothing but ``df`` still reads; their files are removed once ``df`` is written. ``counted``
    are aggregates that are taken along while writing; ``seen`` has them, and the number of ``rows``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid4().hex}"
    watch = Observation()
    df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counted.items()]).write.parquet(path)
    release(*spent)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path, made._cut_seen = path, watch
    return made


def seen(df: DataFrame, name: str = "rows"):
    """What ``cut`` counted while it wrote ``df``."""
    return df._cut_seen.get[name]


def release(*spent: DataFrame) -> None:
    """Remove the tables of cuts that nothing reads any more; other frames are left alone."""
    for df in spent:
        path = getattr(df, "_cut_path", None)
        if path is not None:
            remove(df.sparkSession, path)
            df._cut_path = None


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the shared folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query are removed when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
