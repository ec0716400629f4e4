"""A session with settings that suit the engine; every operator also runs on any other classic session.

Iterative operators, generations and models that are broadcast use the driver's JVM, so Spark Connect is not supported.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "veristrata", master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster leave ``partitions`` unset: adaptive execution sizes them from the default of the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
