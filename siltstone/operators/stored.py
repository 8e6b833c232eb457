"""Stored tables that change by the bucket: copy-on-write, with a manifest of each version.

Rows lie in buckets by a hash of their key. A merge works out and writes anew only
the buckets that the new rows' keys fall into, under the number of the next
version; then a manifest that names every bucket's folder is written, and with its
last file, Spark's success mark, the version stands. Whoever read the version
before goes on reading it, and a merge that fails leaves nothing that is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.sources.shared import drop_folder, file_system, versions

BUCKETS = 64
_MANIFEST = "bucket int, version int, rows bigint"


class StoredTable:
    """The table at a folder that driver and executors share; ``keys`` tell its rows apart."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/meta").first()
        self.keys, self.buckets, self.schema = list(meta["keys"]), meta["buckets"], StructType.fromJson(json.loads(meta["schema"]))

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> StoredTable:
        """Write a new table; its first version is 1. Raises where one stands."""
        spark = rows.sparkSession
        meta = spark.createDataFrame([(keys, buckets, rows.schema.json())], "keys array<string>, buckets int, schema string")
        meta.coalesce(1).write.mode("error").parquet(f"{path}/meta")
        table = cls(spark, path)
        table._put(rows, {}, 0)
        return table

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The latest version; 0 before the first."""
        return max(versions(self.spark, f"{self.path}/manifests"), default=0)

    def manifest(self, version: int | None = None) -> dict[int, tuple[int, int]]:
        """Of each bucket that has rows: the version that wrote it, and its rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{version}").collect()  # one row for each bucket
        return {r["bucket"]: (r["version"], r["rows"]) for r in rows}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets; by default of the latest."""
        held = self.manifest(version)
        found = [f"{self.path}/data/{v}/__bucket={b}" for b, (v, _) in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """``how(old, new)`` over the buckets that ``new`` falls into; returns these.

        ``how`` gets the old rows of these buckets and all of ``new``, and returns
        what they become; it must not change the key of a row. Any function of
        ``upserts`` that goes by the table's keys will do.
        """
        base = self.version()
        touched = {r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect()}  # at most as many as buckets
        if touched:
            self._put(how(self.read(base, touched), new), {b: v for b, v in self.manifest(base).items() if b not in touched}, base, touched)
        return touched

    def rewrite(self, how: Callable[[DataFrame], DataFrame]) -> None:
        """``how(old)`` over the whole table, for changes that go by no key."""
        base = self.version()
        self._put(how(self.read(base)), {}, base)

    def _put(self, rows: DataFrame, kept: dict[int, tuple[int, int]], base: int, touched: set[int] | None = None) -> None:
        """Write the next version: buckets of ``rows``, and the others as they are."""
        spark, number = self.spark, self._claim(base)
        folder = f"{self.path}/data/{number}"
        tasks = min(self.buckets if touched is None else len(touched), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
        placed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("__bucket", self._bucket())
        placed.repartition(tasks, "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(folder)
        counts = spark.read.schema("__bucket int").option("basePath", folder).parquet(folder).groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
        written = {r["__bucket"]: (number, r["n"]) for r in counts.collect()}
        if touched is not None and not set(written) <= touched:
            raise ValueError("a merge changed the key of a row")
        if self.version() != base:
            raise RuntimeError(f"version {self.version()} was written meanwhile; merge again")
        rows = [(b, v, n) for b, (v, n) in sorted((kept | written).items())]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{number}")

    def _claim(self, base: int) -> int:
        """A number for the next version that no other writer has: a file that only one can create."""
        number = base + 1
        while True:
            fs, where = file_system(self.spark, f"{self.path}/claims/{number}")
            if fs.createNewFile(where):
                return number
            number += 1

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete data that the last ``keep`` versions don't name, and older manifests; returns the data deleted."""
        known = versions(self.spark, f"{self.path}/manifests")
        needed = {v for n in known[-keep:] for v, _ in self.manifest(n).values()}
        gone = [v for v in versions(self.spark, f"{self.path}/data") if v not in needed and v <= known[-1]]
        for v in gone:
            drop_folder(self.spark, f"{self.path}/data/{v}")
        for n in known[:-keep]:
            drop_folder(self.spark, f"{self.path}/manifests/{n}")
        return gone
