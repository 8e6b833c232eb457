"""Target-distribution importance resampling over hashed n-grams (operator 12).

Two passes over Arrow batches. The first counts the features of each partition
with one ``bincount`` into a vector as long as there are buckets; ``treeReduce``
merges these vectors, so the driver gets one of fixed length. From the vectors of
all documents and of the target texts each bucket gets a gain. The second pass
broadcasts the gains, again of fixed length, and adds them up over a document's
features by a weighted ``bincount``. What is drawn is the top of the scores with
Gumbel noise that follows from the id alone.

A feature's bucket is the CRC-32 of its bytes. That of a run of words comes from
those of its words: appending bytes to a string maps its CRC by a linear function
of their number, which a few table lookups apply to whole arrays.

Ranks need no sort in one task: rows above a cut that is low enough are sorted in
ranges, numbered inside each, and shifted by the lengths of the ranges before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, quoted, without
from siltstone.llm.scratch import Scratch

SLICE_BYTES = 1 << 20
BUCKETS = 10_000
LONGEST = 3
#: Documents with fewer words aren't drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: A range of ranked rows has about so many.
RANGE_ROWS = 200_000
#: The cut lies so much of all rows below the last one drawn, and is found this exactly.
ROOM, CUT_ACCURACY = 0.002, 5_000

# Words are digits, letters and whatever is not ASCII; A to Z count as a to z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_APART = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _APART[_first : _last + 1] = False


def _zero_step() -> np.ndarray:
    """What CRC-32 (reflected, 0xEDB88320) becomes by each value of its low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear function of 32 bits, given for each byte, of every value."""
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


#: Lengths below this have a table of their own; others are made of it and its doubles.
_SHORT = 64


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for 0 to 63 appended bytes, and for 64, 128 and so on up to 2**31."""
    step = _zero_step()
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = []
    for _ in range(_SHORT):
        short.append(now)
        now = (now >> np.uint32(8)) ^ step[now & 255]
    doubles = [now]
    for _ in range(25):
        doubles.append(_applied(doubles[-1], doubles[-1]))
    return np.stack(short), doubles


_SHORT_SHIFTS, _DOUBLES = _shifts()


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The CRC's share of strings that go on for so many bytes; the rest's own CRC is to be added by xor."""
    flat, base = _SHORT_SHIFTS.ravel(), (n_bytes % _SHORT) * 1024
    out = flat[base + (crc & 255)] ^ flat[base + 256 + ((crc >> 8) & 255)] ^ flat[base + 512 + ((crc >> 16) & 255)] ^ flat[base + 768 + (crc >> 24)]
    high = n_bytes // _SHORT
    for tables in _DOUBLES:
        if not high.any():
            break
        odd = np.flatnonzero(high & 1)
        out[odd] = _applied(tables, out[odd])
        high = high >> 1
    return out


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all runs of one to three words, their buckets, and each row's number of words."""
    data, offsets = arrays.utf8(column)
    w = arrays.words(_LOWER[data], offsets, _APART)
    number, distinct = arrays.numbered(w.data, w.bounds)
    alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    after = np.fromiter((zlib.crc32(b" " + x) for x in distinct), np.uint32, len(distinct))
    length = np.diff(w.bounds) + 1
    crc, row, follows = alone[number], w.row, after[number]
    rows, crcs = [row], [crc]
    for n in range(1, LONGEST):
        # The run that begins at a word and ends n words later, if its row does.
        inside = np.flatnonzero(row[: max(0, len(row) - n)] == row[n:])
        longer = np.zeros(len(row), np.uint32)
        longer[inside] = shifted(crc[inside], length[inside + n]) ^ follows[inside + n]
        crc = longer
        rows.append(row[inside])
        crcs.append(crc[inside])
    return np.concatenate(rows), np.concatenate(crcs) % np.uint32(buckets), np.diff(w.rows)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all whole texts fall into each bucket (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            total += np.bincount(features(part.column(0), buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = map_arrow(texts.select(F.col(quoted(text_col)).alias("text")), run, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    nothing = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(nothing).treeReduce(lambda a, b: a + b)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousand times the log of its share in the target over that in all, rounded down."""
    total, aimed, n = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total + n) / ((s + 1.0) * (aimed + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: str = "42") -> DataFrame:
    """Add ``n_words, n_features, weight, score`` to every document.

    ``weight`` is the sum of the gains of a text's features, repeats counted;
    ``score`` adds Gumbel noise that follows from the seed and the id (a null id
    counts as an empty one, rows that share an id share their noise). Null and
    empty texts, and those without a word, have weight 0. Texts of any length are
    read whole; repeated rows stay repeated, an empty table stays empty, and other
    columns but the text pass through, save those with the names of the added ones.
    """
    added = ("n_words", "n_features", "weight", "score")
    kept = [f.name for f in without(docs, *added, text_col).schema]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")
    rows = docs.select(*[F.col(quoted(c)).alias(f"_kept{k}") for k, c in enumerate(kept)], noise.alias("_noise"), F.col(quoted(text_col)).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # as long as there are buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "_text", SLICE_BYTES):
            row, bucket, n_words = features(part.column(part.num_columns - 1), len(shared.value))
            n, weight = (np.bincount(row, w, minlength=part.num_rows).astype(np.int64) for w in (None, shared.value[bucket].astype(float)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(x, pa.int64()) for x in (n_words, n, weight)]], names=[*part.schema.names[:-1], "_words", "_features", "_weight"])

    schema = rows.drop("_text").schema
    for name in ("_words", "_features", "_weight"):
        schema = schema.add(name, "long")
    made = map_arrow(rows, run, schema)
    values = (F.col("_words"), F.col("_features"), F.col("_weight"), F.col("_weight") + F.col("_noise"))
    return made.select(*[F.col(f"_kept{k}").alias(c) for k, c in enumerate(kept)], *[v.alias(a) for v, a in zip(values, added, strict=True)])


def draw(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``rank`` to what ``score`` gave: 1, 2, 3 and so on for the rows drawn, else null.

    Of the rows with ``least_words`` words so many percent, rounded down, are drawn:
    those of the highest scores, and of equal ones those of the smaller id (null
    ids last, rows equal in both in any order). All rows are returned, in any
    order; an empty table stays empty.
    """
    spark, scratch = scored.sparkSession, Scratch(scored.sparkSession, "resample")
    rows = scratch.keep(without(scored, "rank"), "scores")
    able = F.col("n_words") >= least_words
    n, at = rows.where(able).agg(F.count(F.lit(1)), F.percentile_approx("score", max(0.0, 1 - percent / 100 - ROOM), CUT_ACCURACY)).first()
    most = percent * n // 100
    if not most:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    # The cut is approximate, so rows above it are counted; too few, and all are ranked.
    above = able & (F.col("score") >= F.lit(at))
    found = rows.where(above).count()
    if found < most:
        above, found = able, n
    order = [F.col("score").desc(), F.col(quoted(id_col)).asc_nulls_last(), F.col("_place")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found // range_rows))
    placed = rows.where(above).withColumn("_place", F.monotonically_increasing_id())
    sorted_rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_place")
    # The number of a row's partition, and its place there.
    ranked = scratch.keep(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    lengths = sorted((r["p"], r["n"]) for r in ranked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each range
    bases, base = [], 0
    for p, length in lengths:
        bases.append((p, base))
        base += length
    table = spark.createDataFrame(bases, "_part bigint, _base bigint")
    numbered = ranked.join(F.broadcast(table), part == F.col("_part")).withColumn("rank", F.col("_base") + place + 1)
    drawn = numbered.select(*[F.col(quoted(c)) for c in rows.columns], F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return rows.where(~above).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = "42") -> DataFrame:
    """Score all documents by how like the target's texts they are, and draw the best: see ``score`` and ``draw``."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    return draw(score(docs, gain, id_col, text_col, seed), id_col, percent, least_words)
