"""Standing work as streams: each drains what is there and goes on where it stopped.

Sources are file streams; a run with ``availableNow`` takes all new files and
ends, so the same code serves a schedule and an endless stream.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.latest import first_by
from siltstone.sources.shared import drop_folder, versions
from siltstone.streaming.percolator import Percolator


def file_stream(spark: SparkSession, folder: str, schema: object, names: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """Files of a folder whose names match, as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Write all that is there to ``out`` (exactly once) and return it."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def first_of_key(stream: DataFrame, key: str, at: str, within: str | None = "7 days") -> DataFrame:
    """One row for each key, if its copies come within a span of time.

    A key is remembered for ``within`` after the latest time seen, and then its
    state ends: a copy that comes later is a row again, or is dropped if its time
    ``at`` lies behind the watermark. So is a first row that comes so late. Only an
    explicit None remembers every key, and its state has no end.
    """
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


class StandingQueries:
    """Saved searches with a watermark each, matched against every new batch.

    ``percolator`` knows the searches and finds their matches. A match is newer
    than the search's watermark, or than ``first`` for a search that was never
    checked (by default all are new). ``deliver`` gets a batch's matches and its
    number, and may return the ids of searches whose delivery failed; if it raises,
    all have. What it raised is logged, and kept as ``failures``. After a delivery
    the watermark of a search moves to the latest time seen less ``late``, and the
    matches delivered since are remembered: so a row that comes late, but no more
    than that, is delivered too, and none twice. A search that failed keeps its
    watermark, and its matches are delivered again with the next batch. All this is
    in tables of each batch's number under ``folder``, which outlive the driver; of
    these the last two are kept.
    """

    def __init__(self, percolator: Percolator, deliver: Callable[[DataFrame, int], Iterable | None], folder: str, most: int = 10, first: Column | None = None, late: str = "1 hour"):
        self.percolator, self.deliver, self.folder, self.most, self.late = percolator, deliver, folder, most, late
        self.first = F.lit("0001-01-01").cast("timestamp_ntz") if first is None else first

    def _before(self, spark: SparkSession, name: str, number: int) -> DataFrame | None:
        past = [n for n in versions(spark, f"{self.folder}/{name}") if n < number]
        return spark.read.parquet(f"{self.folder}/{name}/{max(past)}") if past else None

    def watermarks(self, spark: SparkSession, number: int = 1 << 60) -> DataFrame:
        """``search_id, last_checked_at`` as they stand before a batch; searches added since have their own."""
        own = self.percolator.searches.select("search_id", "last_checked_at")
        stored = self._before(spark, "watermarks", number)
        return own if stored is None else stored.unionByName(own.join(stored, "search_id", "left_anti"))

    def failures(self, spark: SparkSession) -> list[tuple[int, str]]:
        """The batches whose delivery raised, as far as they are kept, and what it raised."""
        found = versions(spark, f"{self.folder}/failures")
        return [(n, r["reason"]) for n in found for r in spark.read.schema("reason string").parquet(f"{self.folder}/failures/{n}").collect()]

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, at, tie = batch.sparkSession, self.percolator.at, self.percolator.tie
        batch.persist()
        try:
            marks, again, known = self.watermarks(spark, number), self._before(spark, "undelivered", number), self._before(spark, "delivered", number)
            found = self.percolator.matches(batch, marks, self.first, self.most)
            if again is not None:
                found = found.unionByName(again.join(found.select("search_id", tie), ["search_id", tie], "left_anti"))
            if known is not None:
                found = found.join(known.select("search_id", tie), ["search_id", tie], "left_anti").select(*found.columns)
            order = [F.col("distance").asc_nulls_last(), F.when(F.col("distance").isNull(), F.col(at)).desc_nulls_last(), F.col(tie)]
            first_by(found, ["search_id"], order, self.most).write.mode("overwrite").parquet(f"{self.folder}/found/{number}")
            found = spark.read.schema(found.schema).parquet(f"{self.folder}/found/{number}")
            failed, reason = [], []
            try:
                failed = list(self.deliver(found, number) or [])
            except Exception as error:  # noqa: BLE001  whatever the delivery met, its matches wait for the next batch
                logging.getLogger(__name__).exception("batch %s was not delivered", number)
                failed, reason = None, [(f"{type(error).__name__}: {error}",)]
            spark.createDataFrame(reason, "reason string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/failures/{number}")
            kept = F.lit(True) if failed is None else F.col("search_id").isin(failed) if failed else F.lit(False)
            found.where(kept).write.mode("overwrite").parquet(f"{self.folder}/undelivered/{number}")
            seen = batch.agg(F.max(at).alias("m")).first()["m"]
            moved = F.greatest("last_checked_at", F.lit(seen).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.late}")) if seen is not None else F.col("last_checked_at")
            marks = marks.select("search_id", F.when(kept, F.col("last_checked_at")).otherwise(moved).alias("last_checked_at"))
            marks.write.mode("overwrite").parquet(f"{self.folder}/watermarks/{number}")
            done = found.where(~kept).select("search_id", tie, at)
            done = done if known is None else done.unionByName(known.select("search_id", tie, at))
            now = spark.read.schema(marks.schema).parquet(f"{self.folder}/watermarks/{number}")
            # What the watermark has passed can't match again.
            held = done.join(now, "search_id").where(F.col("last_checked_at").isNull() | (F.col(at) > F.col("last_checked_at"))).select("search_id", tie, at)
            held.write.mode("overwrite").parquet(f"{self.folder}/delivered/{number}")
            for name in ("found", "undelivered", "delivered", "watermarks"):
                for old in versions(spark, f"{self.folder}/{name}")[:-2]:
                    drop_folder(spark, f"{self.folder}/{name}/{old}")
        finally:
            batch.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def signed(body: Column, signature: Column, secret: bytes) -> Column:
    """Whether ``signature`` is the hexadecimal HMAC-SHA256 of ``body`` under ``secret``; nulls are not."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)
    return F.coalesce(F.lower(F.regexp_replace(signature, "^sha256=", "")) == digest, F.lit(False))


def webhook_changes(stream: DataFrame, secret: bytes, schema: str, key: str, at: str, body: str = "body", signature: str = "signature", within: str | None = "7 days") -> DataFrame:
    """The changes that signed deliveries report, one row each: ``key, at`` and the fields of ``schema``.

    A stream of deliveries as they came, of which those with another signature and
    those whose body is no object of the schema are left out. A delivery that comes
    again within the span (see ``first_of_key``) counts once. What is left is a
    stream to append to a table of changes.
    """
    genuine = stream.where(signed(F.col(body), F.col(signature), secret))
    read = genuine.select(F.col(key), F.col(at), F.from_json(body, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("__o"))
    rows = read.where("__o IS NOT NULL AND __o._corrupt_record IS NULL").select(key, at, "__o.*").drop("_corrupt_record")
    return first_of_key(rows, key, at, within)


def due_schedules(schedules: DataFrame, now: Column, cadences: dict[str, str]) -> DataFrame:
    """Jobs of the schedules that are due: never run, or not for their cadence (an interval of each name).

    ``schedule_id, queued_at``; schedules that are switched off, or of no known cadence, are never due.
    """
    since = [F.when(F.col("cadence") == name, F.col("last_run_at") + F.expr(f"INTERVAL {length}") <= now) for name, length in cadences.items()]
    due = F.coalesce(F.col("last_run_at").isNull() & F.col("cadence").isin(*cadences), F.lit(False)) | F.coalesce(*since, F.lit(False))
    return schedules.where(F.coalesce(F.col("enabled"), F.lit(True)) & due).select("schedule_id", now.alias("queued_at"))


def requeued(jobs: DataFrame, now: Column, stuck: str, attempts: int = 3) -> DataFrame:
    """Jobs ``running`` for longer than ``stuck`` wait again, or have failed after so many attempts."""
    hung = (F.col("status") == "running") & (F.col("started_at") + F.expr(f"INTERVAL {stuck}") < now)
    hung = F.coalesce(hung, F.lit(False))
    status = F.when(hung & (F.col("attempts") >= attempts), "failed").when(hung, "queued").otherwise(F.col("status"))
    return jobs.withColumn("status", status).withColumn("started_at", F.when(~hung, F.col("started_at")))


def windowed_counts(stream: DataFrame, at: str, keys: list[str], length: str, late: str) -> DataFrame:
    """Tumbling windows with a bound on lateness (an extension)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Session windows (an extension)."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The backlog: rows of the source that the result lacks."""
    return source.join(done.select(key).distinct(), key, "left_anti")
