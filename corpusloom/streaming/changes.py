"""A feed of file changes: bursts of edits become one update, and the index follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounce(changes: DataFrame, quiet: str = "250 milliseconds", late: str = "1 second") -> DataFrame:
    """(note_path, first, last, edits): edits of a path that follow within ``quiet`` are one; works on streams and tables."""
    timed = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return timed.groupBy(F.session_window("ts", quiet).alias("w"), "note_path").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("edits")).drop("w")


def without_own_writes(changes: DataFrame, ttl: str = "1500 milliseconds") -> DataFrame:
    """Drops repeats of (note_path, sha) within ``ttl``: what was written by this side comes back as an equal change."""
    return changes.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["note_path", "sha"])


def follow(changes: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``upsert`` with each batch of debounced changes. Batches come in order, so a path's updates do too."""
    return debounce(changes).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()
