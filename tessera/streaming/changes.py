"""Change logs: replay into a table, in one pass or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ADD, MODIFY, DELETE = "add", "modify", "delete"


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each key's last change, by grouped aggregation: a busy key's changes are combined where they lie."""
    rest = [c for c in log.columns if c not in key]
    place = F.struct(*order)
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), place).alias("__last")).select(*key, "__last.*")


def replay(log: DataFrame, key: list[str], order: list[str], kind: str) -> DataFrame:
    """The table that a log of whole rows leaves: last changes that are no deletions."""
    return latest(log, key, order).filter(F.col(kind) != DELETE).drop(kind)


def apply(table: DataFrame, log: DataFrame, key: list[str], order: list[str], kind: str) -> DataFrame:
    """A table moved on by a log."""
    last = latest(log, key, order)
    kept = table.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.filter(F.col(kind) != DELETE).select(*table.columns))


def stream_replay(log: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of a streamed log to ``write`` exactly once in effect: batches are numbered."""
    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, size: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Extension: aggregates by time window, of a table or (with ``late`` as watermark) a stream."""
    own = events.withWatermark(time, late) if late else events
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = own.groupBy(window.alias("window"), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in grouped.columns if c != "window"])


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Extension: aggregates by session, which a gap ends."""
    grouped = events.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggregates)
    return grouped.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *[c for c in grouped.columns if c != "session"])
