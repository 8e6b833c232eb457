"""Flat token files with 64-bit document offsets (operator 10).

Each partition writes ``<part>.bin``, its documents' ids end to end as unsigned
little-endian integers (16 bits if the vocabulary allows, else 32), and
``<part>.idx``, 64-bit pairs of document id and local end offset. Partitions
follow each other in ascending document id; a table of them holds each one's
base, the prefix sum of the token counts before it. So any document is found by
its base plus a local offset, and readers map the files into memory.

A task writes under a name of its own attempt and the table lists only files of
tasks that ended well, so a lost executor leaves unread files, never wrong ones.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, parts_for, quoted
from siltstone.llm.pieces import library_store, load

SLICE_BYTES = 4 << 20
PART_BYTES = 64 << 20
#: Stands for a null document id in an index file.
NO_ID = -(1 << 63)
_TABLE = "part int, name string, bits int, docs bigint, tokens bigint, base bigint"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files under ``path``.

    ``path`` is a URI that driver and executors share. Documents are ordered by
    id, nulls last, equal ids by a hash of their text, so that no single id
    decides a partition's size. Null texts count as empty: their only id is
    ``end_id``. An empty table gives an empty parts table. Returns the parts
    table, which is also written as Parquet under ``path/parts``; other columns
    of ``docs`` are not read.
    """
    spark = docs.sparkSession
    bits = 16 if max(load(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part = library_store(vocabulary), TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        with fs.open_output_stream(f"{root}/{name}.bin") as flat, fs.open_output_stream(f"{root}/{name}.idx") as index:
            for piece in arrays.slices(batches, "text", SLICE_BYTES):
                ids, rows = store(piece.column(1))
                at = rows[1:] + np.arange(len(rows) - 1)
                out = np.full(len(ids) + len(at), end_id, f"<u{bits // 8}")
                out[np.arange(len(ids)) + np.repeat(np.arange(len(at)), np.diff(rows))] = ids
                flat.write(out.tobytes())
                keys = piece.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                index.write(np.column_stack([keys, n_tokens + at + 1]).astype("<i8").tobytes())
                n_docs, n_tokens = n_docs + len(at), n_tokens + len(out)
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": n_docs, "tokens": n_tokens}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
        else:
            for end in ("bin", "idx"):
                fs.delete_file(f"{root}/{name}.{end}")

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("place")]  # the row's place parts even equal rows
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts_for(rows, "text", part_bytes), *order)
    ordered = ordered.sortWithinPartitions(*order).select("doc_id", "text")
    # One row for each partition: the prefix sums need no more than the counts.
    parts = sorted(map_arrow(ordered, run, "part int, name string, docs bigint, tokens bigint").collect(), key=lambda r: r.part)
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in parts], dtype=np.int64)]).tolist()
    table = spark.createDataFrame([(r.part, r.name, bits, r.docs, r.tokens, b) for r, b in zip(parts, bases, strict=False)], _TABLE)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    return spark.read.schema(_TABLE).parquet(f"{path}/parts")


def _mapped(fs: pyarrow.fs.FileSystem, name: str, kind: str) -> np.ndarray:
    """A file as an array: mapped if it is local, else read."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(name, kind, "r")
    with fs.open_input_stream(name) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is of the
    ids as little-endian unsigned 32-bit integers. One task reads one part.
    """
    table = spark.read.schema(_TABLE).parquet(f"{path}/parts")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for part in (p for frame in frames for p in frame.itertuples()):
            flat = _mapped(fs, f"{root}/{part.name}.bin", f"<u{part.bits // 8}")
            index = _mapped(fs, f"{root}/{part.name}.idx", "<i8").reshape(-1, 2)
            for a in range(0, part.docs, 4096):
                keys, ends = index[a : a + 4096, 0], np.asarray(index[a : a + 4096, 1])
                starts = np.concatenate([[index[a - 1, 1] if a else 0], ends[:-1]])
                lists = [flat[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "start": part.base + starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in lists]})
                out.loc[np.asarray(keys) == NO_ID, "doc_id"] = pd.NA
                if with_ids:
                    out["ids"] = [x.astype(np.int32) for x in lists]
                yield out

    return table.repartition(max(1, table.count())).mapInPandas(run, schema)
