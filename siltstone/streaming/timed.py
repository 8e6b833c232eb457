"""Changes of a key's value, by keyed state and event-time timers.

Rows may come out of order. Each key holds the rows that came and can still be
overtaken, and its last settled row. A timer at the earliest waiting row fires
once the watermark has passed it: no earlier row can come any more, so all rows up
to the watermark are compared in order of time, and go; where rows come with a
batch, this is done as they come. Keys are dealt by hash over buckets that share a
timer and are read and written as one. A batch so reads and writes the buckets of
the keys that came and of those whose timers fire, once each, and no others.
"""

from __future__ import annotations

import json
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from siltstone.sources.shared import file_system

_PROVIDER, _EMPTY_BATCHES = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
#: The state store that keeps timers; it spills to local disk and is saved with the checkpoint.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A time after all others, as far as times in nanoseconds go.
_END = "2261-01-01"
#: Marks a row that only moves the watermark.
_CLOCK = -(1 << 62)
#: Changes that leave Python as one row of arrays, at most.
_CHANGES = 1000
_FOUND = Row("key", "us", "tie", "old", "new")


class _Changes(StatefulProcessor):
    """The state of a bucket of keys is one packed value: its only timer, and each key's last settled row and waiting rows.

    Each call of the state costs a round trip to the JVM, some of which a timer takes
    too; so these are made for buckets, not for each key or row.
    """

    def __init__(self, forget_ms: int | None):
        self.forget_us = None if forget_ms is None else forget_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "packed binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        came = [r for row in rows if (r := row[-4:])[1] != _CLOCK]  # key, us, tie, value
        if came:
            yield from self._settled(came, timerValues, None)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._settled([], timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def _compared(self, key: Any, last: tuple | None, rows: list[tuple]) -> Iterator[tuple]:
        for row in rows:
            if last is not None and self.forget_us is not None and row[0] - last[0] >= self.forget_us:
                last = None  # whether or not a timer has cleared it yet
            if last is not None and None not in (last[2], row[2]) and last[2] != row[2]:
                yield key, row[0], row[1], last[2], row[2]
            last = row

    def _settled(self, came: list[tuple], timerValues: TimerValues, fired: int | None) -> Iterator[Row]:
        """Compare all rows that the watermark has passed, those that came with this batch too, and keep the others."""
        passed, packed = timerValues.getCurrentWatermarkInMs() * 1000, self.held.get()
        timer, keys = pickle.loads(packed[0]) if packed else (None, {})
        for key, *row in came:
            # Told apart by what is written, as not all keys that Spark holds equal are so in Python.
            keys.setdefault(repr(key), (key, None, []))[2].append(tuple(row))
        found, kept, wake = [], {}, None
        for name, (key, last, held) in keys.items():
            held.sort(key=itemgetter(0, 1))
            n = bisect_right(held, passed, key=itemgetter(0))
            found.extend(self._compared(key, last, held[:n]))
            last, rest = held[n - 1] if n else last, held[n:]
            until = rest[0][0] if rest else None if self.forget_us is None else last[0] + self.forget_us
            if rest or until is None or until > passed:
                kept[name] = (key, last, rest)
                wake = until if wake is None else wake if until is None else min(wake, until)
        wake = None if wake is None else -(-wake // 1000)  # when the watermark has passed a time, in whole milliseconds
        if wake != timer:
            if timer not in (None, fired):  # one that fired is deleted by Spark
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if kept:
            self.held.update((pickle.dumps((wake, kept), -1),))
        elif packed:
            self.held.clear()
        for k in range(0, len(found), _CHANGES):
            yield _FOUND(*zip(*found[k : k + _CHANGES], strict=True))

    def close(self) -> None:
        pass


class StateChanges:
    """A row for each change of a key's value: ``key, at, tie, old, new``; the first one is no change.

    Rows that come at most ``late`` behind the latest time seen are put in order;
    rows that come later change nothing and are counted in ``dropped``. A null
    value is no change, nor is what follows it. With ``forget`` (an interval) a key
    that was silent for so long is new again, so that state ends; without it the
    last row of each key is kept. State, timers and what was written are the
    checkpoint's, so a run goes on where the last one stopped and writes no change
    twice. A task holds the waiting rows and those of a batch of one bucket, of which
    there are ``buckets``: as many as divide the keys into some hundreds each. A
    checkpoint's number of buckets can't be changed.
    """

    def __init__(self, folder: str, key: str, at: str, tie: str, value: str, late: str = "1 hour", forget: str | None = None, buckets: int = 2048):
        self.folder, self.key, self.at, self.tie, self.value, self.late, self.forget, self.buckets = folder, key, at, tie, value, late, forget, buckets
        self.dropped, self.progress = 0, []

    def _clock(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """Rows that only move the watermark: a stream of files of its own."""
        path = f"{self.folder}/clock"
        fs, where = file_system(spark, path)
        fs.mkdirs(where)
        return spark.readStream.schema(rows.schema).parquet(path)

    def _run(self, stream: DataFrame, checkpoint: str, fire: bool = True) -> None:
        """Take all that is there; with ``fire`` the timers that the last batch's rows set off are run too."""
        spark, kinds = stream.sparkSession, dict(stream.dtypes)
        at = F.col(self.at).cast("timestamp")
        key = F.col(self.key)
        if kinds[self.key] in ("float", "double"):
            key = F.when(key == 0, F.lit(0).cast(kinds[self.key])).otherwise(key)  # zero has one sign
        rows = stream.where(at.isNotNull()).select(at.alias("at"), key.alias("key"), F.unix_micros(at).alias("us"), F.col(self.tie).alias("tie"), F.col(self.value).cast("string").alias("value"))
        rows = rows.unionByName(self._clock(spark, rows)).withWatermark("at", self.late)
        rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket"), "at", "key", "us", "tie", "value")
        forget = None if self.forget is None else int(spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {self.forget}"))).first()[0])
        changes = rows.groupBy("bucket").transformWithState(_Changes(forget), f"key array<{kinds[self.key]}>, us array<bigint>, tie array<{kinds[self.tie]}>, old array<string>, new array<string>", "append", "EventTime")
        changes = changes.select(F.inline(F.arrays_zip("key", "us", "tie", "old", "new")))
        found = changes.select(F.col("key").alias(self.key), F.timestamp_micros("us").cast(kinds[self.at]).alias(self.at), F.col("tie").alias(self.tie), "old", "new")
        wanted = {_PROVIDER: _ROCKS, _EMPTY_BATCHES: str(fire).lower()}
        before = {k: spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            spark.conf.set(k, v)
        try:
            running = found.writeStream.format("parquet").option("path", f"{self.folder}/changes").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            running.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        self.progress = [json.loads(p.json) for p in running.recentProgress]
        self.dropped += sum(op["numRowsDroppedByWatermark"] for p in self.progress for op in p["stateOperators"])

    def drain(self, stream: DataFrame, checkpoint: str, complete: bool = False) -> DataFrame:
        """Take all that is there and return all changes so far.

        After ``complete`` input nothing waits any more: the clock goes to the end
        of time, and whatever came after that would be late.
        """
        spark, kinds = stream.sparkSession, dict(stream.dtypes)
        if complete:
            end = spark.range(1).select(F.lit(None).cast(kinds[self.key]).alias("key"), F.lit(_END).cast("timestamp").alias("at"), F.lit(_CLOCK).cast("long").alias("us"), F.lit(None).cast(kinds[self.tie]).alias("tie"), F.lit(None).cast("string").alias("value"))
            self._run(stream, checkpoint, fire=False)  # the end of time fires them all
            end.coalesce(1).write.mode("append").parquet(f"{self.folder}/clock")
        self._run(stream, checkpoint)
        schema = StructType.fromDDL(f"`{self.key}` {kinds[self.key]}, `{self.at}` {kinds[self.at]}, `{self.tie}` {kinds[self.tie]}, old string, new string")
        fs, where = file_system(spark, f"{self.folder}/changes/_spark_metadata")
        return spark.read.schema(schema).parquet(f"{self.folder}/changes") if fs.exists(where) else spark.createDataFrame([], schema)
