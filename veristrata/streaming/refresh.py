"""Streams (an extension): incremental refresh of derived tables and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def refresh_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give all new rows to ``apply`` in micro-batches and stop; a batch that was applied is not given again after a restart."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or sliding) window; rows later than ``late`` behind the latest are left out. Works on streams and tables."""
    window = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of each key: events with less than ``gap`` between them."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(F.col(ts), gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once, as far as repeats come within ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)
