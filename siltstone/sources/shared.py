"""Folders that driver and executors share: stream checkpoints, sinks and intermediate tables.

Every folder has an owner, a ``Workspace``, which drops it; ``sweep`` drops those
of all owners of this process once their results are written.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_owned: set[str] = set()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local session without one gets a temporary one.

    ``sweep`` deletes it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="siltstone-stream-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = f"file://{_local[0]}"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _owned.add(path)
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete all shared folders of this process. Call it once the results that read them are written."""
    while _owned:
        drop_folder(spark, _owned.pop())


class Workspace:
    """The tables of one operator call, under one fresh folder that ``drop`` deletes."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, shared_folder(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return it as read back: a lost executor costs a re-read, and the lineage ends."""
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete these tables, or without names all."""
        for path in [self.path(n) for n in names] or [self.root]:
            drop_folder(self.spark, path)
        if not names:
            _owned.discard(self.root)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the tables that were written whole under ``folder``, in order."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
