"""Sum-of-squares packing of documents into training sequences (operator 5).

A document is its token ids and an end id; one that is longer than a sequence
is cut into whole sequences and a rest. Each piece goes where the sum of the
squared counts of open sequences per residual gap becomes smallest: an exact
fill takes a square away, a gap that many open sequences share adds to one. The
counts stay spread over all gaps, so later pieces of any length find a fit.

Pieces are counted, dealt by hash into groups of bounded size and each group is packed
by one task; only piece lengths and checksums are shuffled, never texts or ids. The
last open sequences of a group are its only loss, a few in tens of thousands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, quoted, type_of
from siltstone.llm.pieces import library_store
from siltstone.llm.scratch import Scratch

SLICE_BYTES = 4 << 20
#: Pieces that are packed together.
GROUP_PIECES = 40_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pack pieces in the order given: each one's sequence number and its place there.

    Lengths lie in 1..capacity. Among equal sums the smallest gap is filled.
    """
    counts = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, place, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        gap, least = capacity, 2 * counts[capacity - size] + 1 if size < capacity else 0
        if size < capacity:
            # The change of the sum if a gap g >= size becomes g - size; no count is kept for gap 0.
            change = 2 * (counts[: capacity - size] - counts[size:capacity]) + 2
            change[0] -= 1
            change[counts[size:capacity] == 0] = 1 << 60
            best = int(change.argmin())
            if change[best] <= least:
                gap = best + size
        if gap == capacity:
            sequence, used = used, used + 1
        else:
            sequence = waiting[gap].pop()
            counts[gap] -= 1
        where[k], place[k] = sequence, capacity - gap
        if rest := gap - size:
            waiting[rest].append(sequence)
            counts[rest] += 1
    return where, place


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document; one row for each piece.

    Returns ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.
    A null or empty text is the end id alone. Repeated rows, and rows that share
    an id or have none, are documents of their own. Texts of any length are cut
    whole. An empty table gives an empty result; columns besides the two named are
    not read, whatever their names.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seen = library_store(vocabulary), 0
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            ids, rows = store(part.column(1))
            bounds = (rows + np.arange(len(rows))).tolist()
            out = np.full(bounds[-1], end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(len(rows) - 1), np.diff(rows))] = ids
            doc, piece, start, length, crc = [], [], [], [], []
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):  # noqa: B905
                for number, s in enumerate(range(a, b, capacity)):
                    e = min(b, s + capacity)
                    doc.append(k), piece.append(number), start.append(s - a), length.append(e - s)
                    crc.append(zlib.crc32(out[s:e]))
            keys = part.column(0).take(pa.array(doc, pa.int32()))
            salt = pa.array(np.array(doc, np.int64) + seen)
            seen += part.num_rows
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), salt], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "salt", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        where, place = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["part"].astype("int64") * (1 << 32) + where, offset=place)[columns]

    kind = type_of(docs, id_col)
    rows = docs.selectExpr(f"{quoted(id_col)} AS doc_id", f"coalesce({quoted(text_col)}, '') AS text")
    pieces = map_arrow(rows, cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint")
    pieces = Scratch(docs.sparkSession, "packing").keep(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "salt", "ids_crc32"), F.lit(groups)).cast("int"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return pieces.groupBy("part").applyInPandas(pack, schema).withColumnRenamed("doc_id", id_col)
