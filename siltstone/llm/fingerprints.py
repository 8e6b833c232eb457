"""I-Match document fingerprints (operator 4).

Terms are kept whose document frequency lies in a band: terms in nearly all
documents say nothing, and terms in hardly any don't survive an edit. A
document's distinct kept terms, sorted, are hashed once for each of several
randomised subsets of the lexicon. Subsets come in scales, each with half the
terms of the one before, so that texts of any length have subsets in which they
hold just a few terms: these stay the same when part of a text changes.

The lexicon's size doesn't follow the corpus: every term in it is in at least
``least`` of all documents, so there are at most (distinct terms of a document,
on average) / ``least`` of them, and it can be broadcast.

A text without a code from the lexicon, because all its terms are rare or very
frequent, gets its codes from all its terms, in subsets of the same scales; if
those hold none of them either, its first code is the hash of all of them.

Two fingerprints are alike by their equal codes, and those of sparse subsets weigh
more: a dense subset holds many of a long text's terms and differs after any edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, parts_for, quoted, type_of, without
from siltstone.llm.scratch import Scratch

SLICE_BYTES = 2 << 20
#: A task adds up the counts of so many terms before it hands them on.
HELD_TERMS = 1 << 17
PART_BYTES = 24 << 20
#: The band of document frequencies, as shares of all documents.
LEAST, MOST = 0.0005, 0.2
SCALES, SUBSETS = 9, 6
#: The first scale's subsets hold a quarter of the terms, the next ones an eighth and so on.
DENSEST = 1 << 62
#: From the sparsest code to the densest each weighs so much of the one before.
DECAY = 0.9
EMPTY = "-"


class Lexicon:
    """Terms of the band in sorted order, and each one's subsets as a bit mask."""

    def __init__(self, terms: list[bytes]):
        self.rank = {t: k for k, t in enumerate(sorted(terms))}
        hashed = arrays.word_hashes(list(self.rank))
        self.member = np.zeros((SCALES * SUBSETS, len(hashed)), bool)
        for k in range(SCALES * SUBSETS):
            self.member[k] = _drawn(hashed, k)
        self.code = arrays.mix64(hashed)


def _drawn(hashed: np.ndarray, k: int) -> np.ndarray:
    """Whether terms with these hashes are in subset ``k``."""
    draw = arrays.mix64(hashed ^ arrays.mix64(np.array([k], np.uint64))[0])
    return draw < np.uint64(DENSEST >> (k // SUBSETS))


def _encode(out: np.ndarray, at: np.ndarray, code: np.ndarray) -> None:
    """Set each row's hash of its terms' codes, which follow each other by row."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if not len(first):
        return
    # The hash of the sorted terms: each one is mixed with its place among them.
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    mixed = arrays.mix64(code + arrays.mix64(place))
    total = np.add.reduceat(mixed, first)
    out[at[first]] = np.maximum((arrays.mix64(total) >> np.uint64(32)).astype(np.uint32), 1)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], int]:
    """The distinct (row, term number) pairs of a slice, and its terms."""
    w = arrays.words(*arrays.utf8(column))
    number, distinct = arrays.numbered(w.data, w.bounds)
    pairs = np.unique(w.row.astype(np.int64) * max(1, len(distinct)) + number)
    return pairs // max(1, len(distinct)), pairs % max(1, len(distinct)), distinct, len(column)


def fingerprint(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    """A row's code in each subset (rows by subsets); 0 if it has no term there.

    A row without a term of the lexicon in any subset is encoded by all its terms.
    """
    every, term, distinct, n = _terms(column)
    rank = np.fromiter((lexicon.rank.get(t, -1) for t in distinct), np.int64, len(distinct))[term]
    known = rank >= 0
    row, rank = every[known], rank[known]
    order = np.lexsort((rank, row))
    row, rank = row[order], rank[order]
    out = np.zeros((n, len(lexicon.member)), np.uint32)
    for k, member in enumerate(lexicon.member):
        held = member[rank]
        _encode(out[:, k], row[held], lexicon.code[rank[held]])
    blank = ~out.any(1)[every]
    if blank.any():
        row, hashed = every[blank], arrays.word_hashes(distinct)[term[blank]]
        order = np.lexsort((hashed, row))
        row, hashed = row[order], hashed[order]
        code = arrays.mix64(hashed)
        for k in range(SCALES * SUBSETS):
            held = _drawn(hashed, k)
            _encode(out[:, k], row[held], code[held])
        blank = ~out.any(1)[row]
        _encode(out[:, 0], row[blank], code[blank])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The weighed share of subsets with terms of either text in which both have the same code.

    Subsets without terms of either don't count; of the others the sparsest has
    weight 1 and each next one ``DECAY`` times the last. Texts without any term
    are alike if both are.
    """
    either = (a > 0) | (b > 0)
    sparser = np.cumsum(either[:, ::-1], axis=1)[:, ::-1] - 1
    weight = np.where(either, DECAY**sparser, 0.0)
    total = weight.sum(1)
    same = np.where((a == b) & either, weight, 0.0).sum(1)
    return np.where(total > 0, same / np.where(total > 0, total, 1), (a == b).all(1).astype(float))


def as_text(codes: np.ndarray) -> list[str]:
    """Codes as one string: 8 hexadecimal digits each, or ``-`` where a text has no term."""
    return [":".join(f"{c:08x}" if c else EMPTY for c in row) for row in codes.tolist()]


def learn_lexicon(docs: DataFrame, scratch: Scratch, text_col: str = "text", least: float = LEAST, most: float = MOST) -> Lexicon:
    """Count every term's documents and keep the terms of the band.

    Terms are runs of bytes other than white space, of whole texts; a null text
    has none, a term repeated in a text counts once, and repeated rows count as
    the rows they are. An empty table gives an empty lexicon; other columns are
    not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def added_up() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
            held.clear()
            return out

        for part in arrays.slices(batches, "text", SLICE_BYTES):
            _, term, distinct, _ = _terms(part.column(0))
            for t, n in zip(distinct, np.bincount(term, minlength=len(distinct)).tolist(), strict=True):
                held[t] = held.get(t, 0) + n
            if len(held) > HELD_TERMS:
                yield added_up()
        yield added_up()

    texts = docs.select(F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    total = docs.count()
    counts = map_arrow(texts, count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    band = scratch.keep(counts.where((F.col("n") >= least * total) & (F.col("n") <= max(1, most * total))), "lexicon")
    # At most (average distinct terms of a document) / least terms, whatever the number of documents.
    return Lexicon(band.select("term").toArrow().column(0).to_pylist())


def fingerprints(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """Add every whole text's fingerprint. Equal texts have equal fingerprints.

    Null texts count as empty; only a text without any term has a fingerprint of
    blanks. Texts of any length are read whole; repeated rows stay repeated, an
    empty table stays empty and other columns pass through, but for one called
    ``to``, which the fingerprint replaces.
    """
    docs = without(docs, to)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, text_col, SLICE_BYTES):
            codes = fingerprint(shared.value, part.column(part.schema.get_field_index(text_col)))
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            yield pa.RecordBatch.from_pydict(columns | {to: pa.array(as_text(codes))})

    return map_arrow(docs, run, docs.select("*").schema.add(to, "string"))


def edited_likeness(docs: DataFrame, lexicon: Lexicon, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hold every text against its edited text and the next document's.

    Documents follow each other by descending id (nulls last, equal ids by a
    hash of their text, equal rows in any order), and the first follows the last.
    The edited text is the text with its last third (code points, rounded down)
    replaced by the first as many of the next text. Rows are sorted in ranges; a
    range's last row gets its results once the first of the range after it is
    known. A lone row is its own next. Null texts are empty, long ones are read
    whole; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    kind = type_of(docs, id_col)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("place")]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(parts_for(rows, "text", PART_BYTES), *order).sortWithinPartitions(*order).select("doc_id", "text")
    shared = spark.sparkContext.broadcast(lexicon)
    results = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            first = part.slice(0, 1) if first is None else first
            whole = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            held = whole.slice(whole.num_rows - 1)
            if whole.num_rows > 1:
                texts = whole.column(1).to_pylist()
                codes = fingerprint(shared.value, whole.column(1))
                found = _held_against(shared.value, texts[:-1], texts[1:], codes[:-1], codes[1:])
                yield _typed(whole.column(0).slice(0, len(texts) - 1), found)
        if held is not None:
            # The ends of the range: what its last row and the row before its first one lack.
            ends = [pa.array([TaskContext.get().partitionId()], pa.int32()), held.column(1), first.column(1)]
            yield _typed(held.column(0), None, ends)

    found = scratch.keep(map_arrow(ordered, run, f"{results}, part int, last string, first string"), "found")
    ends = found.where("part IS NOT NULL").select("doc_id", "part", "last", "first")
    # One number for each range.
    parts = sorted(r["part"] for r in ends.select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "p int, then int")
    ends = ends.join(after, F.col("part") == F.col("p")).select("doc_id", "last", "then")
    firsts = found.where("part IS NOT NULL").select(F.col("part").alias("q"), "first")
    closing = ends.join(firsts, F.col("then") == F.col("q")).select("doc_id", "last", "first")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "last", SLICE_BYTES):
            codes = [fingerprint(shared.value, part.column(k)) for k in (1, 2)]
            yield _typed(part.column(0), _held_against(shared.value, part.column(1).to_pylist(), part.column(2).to_pylist(), *codes))

    names = [f.split(" ")[0] for f in results.split(", ")]
    closed = map_arrow(closing, close, f"{results}, part int, last string, first string")
    return found.where("part IS NULL").unionByName(closed).select(F.col("doc_id").alias(id_col), *names[1:])


def _held_against(lexicon: Lexicon, texts: list[str], following: list[str], codes: np.ndarray, next_codes: np.ndarray) -> list[pa.Array]:
    """The results of texts whose next ones are known."""
    cut = [len(t) // 3 for t in texts]
    edited = [t[: len(t) - n] + f[:n] for t, f, n in zip(texts, following, cut, strict=True)]
    changed = fingerprint(lexicon, pa.array(edited, pa.string()))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(as_text(codes)),
        pa.array(as_text(changed)),
        pa.array(likeness(codes, changed)),
        pa.array(likeness(codes, next_codes)),
    ]


def _typed(ids: pa.Array, found: list[pa.Array] | None, ends: list[pa.Array] | None = None) -> pa.RecordBatch:
    """A batch of results, or of a range's ends; the other columns are null."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    found = found or [pa.nulls(len(ids), k) for k in kinds]
    ends = ends or [pa.nulls(len(ids), k) for k in (pa.int32(), pa.string(), pa.string())]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "last", "first"]
    return pa.RecordBatch.from_arrays([ids, *found, *ends], names=names)
