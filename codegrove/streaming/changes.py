"""Change detection and sessions over event time (inventory I2, I3).

``detect_changes`` keeps what was seen of every path in the state store and compares each listing with it; a path that a listing leaves out
never shows up in the stream, so a timer tells that it is gone. ``sessions`` drops redelivered events while the watermark may still
bring them, and closes a session once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

CHANGES = "path string, change_type string, timestamp timestamp"


def _time(ms: int) -> datetime:
    return (_EPOCH + timedelta(milliseconds=ms)).replace(tzinfo=None)


class Seen(StatefulProcessor):
    """State of one path: modification time and the last listing that had it. ``gap_ms``: time between two listings."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "mtime long, poll long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.seen.get() if self.seen.exists() else None
        mtime, last = (known[0], known[1]) if known else (None, None)
        if last is not None:
            self.handle.deleteTimer(last + self.gap)
        out = []
        for poll, at in sorted((r["poll"], r["mtime"]) for r in rows):
            if last is not None and poll - last > self.gap:
                # the listings in between did not have it, and its timer had no time to fire
                out.append(Row(path=key[0], change_type="deleted", timestamp=_time(last + self.gap)))
                last = None
            if last is None or at != mtime:
                out.append(Row(path=key[0], change_type="created" if last is None else "modified", timestamp=_time(poll)))
            mtime, last = at, poll
        self.seen.update((mtime, last))
        self.handle.registerTimer(last + self.gap)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.seen.get() if self.seen.exists() else None
        if known is None:
            return iter([])
        self.seen.clear()
        return iter([Row(path=key[0], change_type="deleted", timestamp=_time(known[1] + self.gap))])

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """State with timers needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def detect_changes(listings: DataFrame, gap: timedelta) -> DataFrame:
    """The stream of changes (path, change_type, timestamp) in a stream of listings (path, mtime, at), one every ``gap``.

    A path counts as deleted at the first listing without it, told once a later listing has moved the watermark on. Start the stream within
    ``rocks``.
    """
    timed = listings.select("path", F.col("mtime").cast("long").alias("mtime"), F.col("at").cast("timestamp").alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("poll"))
    return timed.withWatermark("at", "0 seconds").groupBy("path").transformWithState(
        Seen(int(gap.total_seconds() * 1000)), CHANGES, "Append", "EventTime"
    )


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """(user_id, started, ended, events, errors) of every closed session of a stream of events (event_id, user_id, ts, event_type).

    A session ends ``gap`` after its last event. Events may come ``delay`` late and more than once; what is later than that is left out.
    """
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    grouped = once.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).select(
        "user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "errors"
    )


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a stream gives now to a parquet table and stops; the checkpoint lets the next call go on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
