"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of at most so many rows is left to one task; there are at most rows / HOT_ROWS larger ones.
HOT_ROWS = 1_000_000
SALTS = 64


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which is unique on ``key``; ``rows``: rows of left.

    Keys with more than ``hot_rows`` rows are counted by partial sums; their rows are spread over
    SALTS parts by a hash of the row, and the one row of the right side is repeated for each part.
    Where left has no more rows than that, no key can be hot and nothing is counted.
    """
    if rows <= hot_rows:
        return left.join(right, key, how)
    hot = left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(key, F.lit(True).alias("__hot"))
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)  # at most rows / hot_rows keys
    part = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
    spread = left.join(hot, key, "left").withColumn("__part", F.when(F.col("__hot"), part).otherwise(F.lit(0))).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(hot, key, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return spread.join(copies, [key, "__part"], how).drop("__part")
