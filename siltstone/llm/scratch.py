"""Intermediate tables in the folder that driver and executors share.

Operators cut long lineages by writing a table here and reading it again, so a
lost executor costs a re-read, never a re-run of everything before. The folder
is the session's ``spark.checkpoint.dir``; only a local session without that
setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


_used: set[str] = set()


def sweep(spark: SparkSession) -> None:
    """Delete the tables of all operator calls of this process.

    Results that are not yet written or collected read them: call it after that.
    """
    while _used:
        fs, where = _hadoop(spark, _used.pop())
        fs.delete(where, True)


class Scratch:
    """The tables of one operator call, under one fresh folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/siltstone/{label}-{uuid.uuid4().hex}"
        _used.add(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return it as read back; the job's shuffle files go at once."""
        path, before = self.path(name), self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            fs, where = _hadoop(self.spark, self.path(name))
            fs.delete(where, True)
