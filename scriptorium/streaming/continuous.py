"""Results over streams that equal those of the batch operators.

Every sink publishes snapshots tagged with the number of the batch: a batch that
comes again after a fault adds nothing, and the target is never read to know it.

Defined results: rows with a null time are in no window; rows of windows
that the watermark had passed before the batch are dropped and counted; of rows that share a key in one batch the
first in order counts, of rows in different batches the one that came first; a
null key is a key; an empty source publishes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.incremental import latest
from ..sources.snapshots import Snapshots
from .fetching import STATE_STORE, idle


@dataclass
class Report:
    """What a run did: batches with rows, rows read, rows that came too late."""

    batches: int
    rows: int
    late: int


def report(query: StreamingQuery) -> Report:
    seen = query.recentProgress
    late = sum(s["numRowsDroppedByWatermark"] for p in seen for s in p["stateOperators"])
    return Report(sum(p["numInputRows"] > 0 for p in seen), sum(p["numInputRows"] for p in seen), late)


def publish_stream(rows: DataFrame, target: str, table: str, checkpoint: str, mode: str = "append", before_publish: Callable[[int], None] = lambda batch: None, timers: bool = False) -> Report:
    """Process all that is there and stop; each batch is published once, with its number as ``batch``.

    A stream with ``timers`` has no end by itself; it is stopped when no rows come any more.
    """
    spark = rows.sparkSession

    def publish(batch: DataFrame, number: int) -> None:
        before_publish(number)
        known = Snapshots(spark, target)
        if known.version().batches.get(table, -1) >= number:  # its state has to be made all the same
            batch.write.format("noop").mode("overwrite").save()
            return
        known.publish(append={table: batch.withColumn("batch", F.lit(number).cast("long"))}, batch=(table, number))

    stream = rows.writeStream.outputMode(mode).foreachBatch(publish).option("checkpointLocation", checkpoint)
    if not timers:
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
        return report(query)
    query = stream.trigger(processingTime="200 milliseconds").start()
    try:
        while not idle(query):
            if query.exception():
                raise query.exception()
            time.sleep(0.2)
        return report(query)
    finally:
        query.stop()


def timed(events: DataFrame, time_col: str) -> DataFrame:
    """A time without a zone is one of the session's zone: watermarks need an instant."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def window_stats(events: DataFrame, time_col: str, keys: list[str], value: str, width: str) -> DataFrame:
    """``window_start, *keys, n, total, least, most`` of each event-time window; for tables and streams alike."""
    # Grouped by the window itself: its fields alone do not tell Spark when the watermark has passed it.
    rows = events if events.isStreaming else timed(events, time_col)
    rows = rows.where(F.col(time_col).isNotNull())
    stats = rows.groupBy(F.window(time_col, width).alias("_window"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return stats.select(F.col("_window.start").alias("window_start"), *keys, "n", "total", "least", "most")


def run_window_stats(events: DataFrame, target: str, table: str, checkpoint: str, time_col: str, keys: list[str], value: str, width: str = "1 day", lateness: str = "1 hour") -> Report:
    """The statistics of a stream so far: each batch publishes the windows that it changed.

    State is held for windows that the watermark has not passed.
    """
    stats = window_stats(timed(events, time_col).withWatermark(time_col, lateness), time_col, keys, value, width)
    return publish_stream(stats, target, table, checkpoint, "update")


def current_stats(spark: SparkSession, target: str, table: str, keys: list[str]) -> DataFrame:
    """The newest published row of each window."""
    rows = Snapshots(spark, target).read(table)
    key = F.struct("window_start", *keys)
    newest = latest(rows.withColumn("_window", key), "_window", "batch", "n")
    return newest.drop("_window", "batch")


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key pass; the key is forgotten after ``expiry_ms``, if that is given."""

    def __init__(self, expiry_ms: int | None):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = min(rows, key=lambda r: r["_at"])
        if not self.seen.exists():
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def run_first_seen(rows: DataFrame, target: str, table: str, checkpoint: str, key: Column, order: Column, expiry_ms: int | None = None, before_publish: Callable[[int], None] = lambda batch: None) -> Report:
    """Publish the first row of each key of a stream, whole.

    ``order`` is a long.  The state holds a 128-bit digest of each key and a
    bit; with ``expiry_ms`` keys that have not come for so long since they first
    did are let go, and would count as new.
    """
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        digest = F.coalesce(F.md5(key.cast("string").cast("binary")), F.lit(""))
        marked = rows.withColumns({"_key": digest, "_at": order.cast("long")})
        first = marked.groupBy("_key").transformWithState(FirstSeen(expiry_ms), marked.schema, "Append", "ProcessingTime" if expiry_ms else "None")
        return publish_stream(first.drop("_key", "_at"), target, table, checkpoint, before_publish=before_publish, timers=expiry_ms is not None)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
