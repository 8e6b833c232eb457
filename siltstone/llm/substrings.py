"""Substring deduplication by super-k-mers (operator 1).

A window is ``width`` consecutive words. A word goes if it lies in a window
whose words also start in a document with a smaller id. Windows that follow each
other and share a minimiser, the least hash of the three-word runs inside, stay
one packed string, a super-k-mer, and travel to the minimiser's bucket once.
There equal windows are brought together by sorting and the least document id of
each is found exactly: hashes only order the sort, the words decide.

Each slice of rows is first searched in itself. A window that also lies in a
smaller document of the slice is settled there and isn't sent, and a task keeps the
windows that it met so, to settle those of its later slices. So a passage that
a third of all documents share reaches its bucket about once for each task, not once
for each document.

Runs that are frequent in a sample of the rows are hot and no window's minimiser
if it has another run; a window of hot runs only goes by the hash of its words.
So no bucket grows with a hot run. A window that is itself as frequent in the
sample is hot too and goes in two steps. First those of one salt meet, a share of
the tasks, and all but the least are settled there; then the least ones of all
salts meet, so a bucket has one of each salt at most. The sample decides where windows
go, never which are found: equal windows always meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, parts_for, quoted, unused, without
from siltstone.llm.scratch import Scratch

SLICE_BYTES = 2 << 20
#: Super-k-mers hold about three times the text. A task gets about this much of
#: them, in about so many buckets, of which it has one in memory at a time.
TASK_BYTES, TASK_BUCKETS = 32 << 20, 8
MINIMISER_WORDS = 3
#: A three-word run, or a window, is hot if it occurs about this often (as super-k-mers, an
#: average bucket), as told by one in so many rows; or, in a corpus of so many words that this
#: were more than MOST_HOT, as often as no more than MOST_HOT can: so each fill 32 MB at most.
HOT_RUNS, HOT_SAMPLE, MOST_HOT = 1 << 16, 64, 1 << 22
#: A task keeps so many windows that lie in several documents, about 100 bytes each.
MOST_MET = 1 << 16
#: Hot windows meet under so many salts first.
SALTS = 1024
#: A row is what a slice sends to a bucket, or (without ``text``) the spans that it settled itself.
_SENT = "bucket int, docs binary, places binary, text binary"


def _same(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    equal = np.ones(len(a), bool)
    for k in range(width):
        equal &= numbers[a + k] == numbers[b + k]
    return equal


def starts_earlier(numbers: np.ndarray, hashes: np.ndarray, starts: np.ndarray, doc: np.ndarray, width: int, keys: np.ndarray | None = None) -> np.ndarray:
    """For each window, whether its words also start in a document with a smaller id.

    ``numbers`` are word numbers, ``hashes`` their hashes, ``starts`` the windows'
    first words, ``doc`` their document ids. Windows are sorted by hash; wherever
    neighbours of one hash differ in a word, the words themselves are sorted.
    """
    if not len(starts):
        return np.zeros(0, bool)
    keys = arrays.window_hashes(hashes[numbers], width)[starts] if keys is None else keys
    order, tied = _by_key(keys)
    if not _same(numbers, starts[order[tied]], starts[order[tied + 1]], width).all():
        order = np.lexsort([numbers[starts + k] for k in range(width)])
        at = starts[order]
        tied = np.flatnonzero(_same(numbers, at[:-1], at[1:], width))
    out = np.zeros(len(starts), bool)
    if not len(tied):
        return out
    # Only windows that have an equal one are gone through.
    begins, several = np.ones(len(order), bool), np.zeros(len(order), bool)
    begins[tied + 1] = False
    several[tied] = several[tied + 1] = True
    first, at = np.flatnonzero(begins[several]), order[several]
    least = np.minimum.reduceat(doc[at], first)
    out[at] = doc[at] > np.repeat(least, np.diff(np.append(first, len(at))))
    return out


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are neighbours, and the places in it that are followed by an equal key.

    The places of the keys take their low bits, so that plain numbers are sorted,
    which takes a fraction of an argsort; if that mixes up different keys, they are sorted whole.
    """
    low = np.uint64((1 << int(len(keys)).bit_length()) - 1)
    packed = keys & ~low
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    tied = np.flatnonzero((packed[1:] ^ packed[:-1]) <= low)
    order = (packed & low).astype(np.int64)
    if (keys[order[tied]] != keys[order[tied + 1]]).any():
        order = np.argsort(keys, kind="stable")
        key = keys[order]
        tied = np.flatnonzero(key[1:] == key[:-1])
    return order, tied


def _runs(flags: np.ndarray, *breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of true flags, cut also where a break is true."""
    before = np.zeros(len(flags), bool)
    before[1:] = flags[:-1]
    begins = flags & ~before
    for b in breaks:
        begins |= flags & b
    first = np.flatnonzero(begins)
    ends = np.flatnonzero(flags & np.append(~flags[1:] | begins[1:], True)) if len(flags) else first
    return first, ends + 1


def _count_runs(column: pa.Array, widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """For each width the hashes of a slice's runs of so many words, and how often each occurs."""
    w = arrays.words(*arrays.utf8(column))
    numbers, distinct = arrays.coded(w.data, w.bounds)
    hashes = arrays.column_hashes(distinct)[numbers]
    for width in widths:
        run, n = np.unique(arrays.window_hashes(hashes, width)[arrays.whole_windows(w.row, width)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(run), width, np.int32)), pa.array(run.view(np.int64)), pa.array(n.astype(np.int64))], names=["width", "run", "n"])


def hot_runs(rows: DataFrame, often: int = HOT_RUNS, sample: int = HOT_SAMPLE, width: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the three-word runs, and of the windows, that occur ``often``, told by one in ``sample`` rows; at most MOST_HOT each."""
    widths = tuple(dict.fromkeys((MINIMISER_WORDS, width)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            yield from _count_runs(part.column(0), widths)

    some = rows.where(F.pmod(F.xxhash64("row_key", "doc_id"), F.lit(sample)) == 0).select("text")
    counts = map_arrow(some, count, "width int, run bigint, n bigint").groupBy("width", "run").agg(F.sum("n").alias("n"))
    scratch = Scratch(rows.sparkSession, "runs")
    counts = scratch.keep(counts, "counts")
    words = (counts.where(F.col("width") == MINIMISER_WORDS).agg(F.sum("n")).first()[0] or 0) * sample
    found = counts.where(F.col("n") * sample >= max(often, words // MOST_HOT + 1)).select("width", "run").toArrow()
    scratch.drop("counts")
    kind, run = (found.column(k).to_numpy() for k in range(2))
    return tuple(np.sort(run[kind == k].astype(np.int64).view(np.uint64)) for k in (MINIMISER_WORDS, width))


def _maybe_in(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key false if it can't be one of ``known``, told by its low 20 bits."""
    low = np.uint64((1 << 20) - 1)
    seen = np.zeros(1 << 20, bool)
    seen[known & low] = True
    return seen[keys & low]


class Met:
    """Windows that lie in several documents of a task's slices, with the least of these: at most ``MOST_MET``.

    A window that isn't here is sent, so the bound costs no result.
    """

    def __init__(self) -> None:
        self.keys, self.docs, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def earlier(self, keys: np.ndarray, docs: np.ndarray, words: Callable[[int], bytes]) -> np.ndarray:
        """For each window whether its words were met in a smaller document."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        some = np.flatnonzero(_maybe_in(self.keys, keys))
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        out = np.zeros(len(keys), bool)
        hit = (self.keys[at] == keys[some]) & (self.docs[at] < docs[some])
        for k, j in zip(some[hit].tolist(), at[hit].tolist(), strict=True):
            out[k] = self.words[j] == words(k)
        return out

    def add(self, keys: np.ndarray, docs: np.ndarray, words: Callable[[int], bytes]) -> None:
        """Take windows in, each with the least document known of it."""
        keys, first = np.unique(keys, return_index=True)
        all_keys = np.concatenate([keys, self.keys])
        all_docs = np.concatenate([docs[first], self.docs])
        all_words = np.concatenate([np.array([words(k) for k in first.tolist()] + [None], object)[:-1], self.words])
        order = np.lexsort((all_docs, all_keys))
        kept = order[np.append(True, np.diff(all_keys[order]) != 0)][:MOST_MET] if len(order) else order
        self.keys, self.docs, self.words = all_keys[kept], all_docs[kept], all_words[kept]


def _pack(part: pa.RecordBatch, width: int, buckets: int, hot: np.ndarray, met: Met, hot_windows: np.ndarray | None = None, salt: int = 0) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of a slice, and the spans that the slice settles by itself and by the ones before.

    Hot windows go to buckets of their own behind the others, by ``salt``.
    """
    docs, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
    _, once = np.unique(np.array([docs, keys]), axis=1, return_index=True)
    if len(once) < len(docs):  # repeated rows have equal results
        part, docs, keys = part.take(pa.array(np.sort(once))), docs[np.sort(once)], keys[np.sort(once)]
    data, offsets = arrays.utf8(part.column(2))
    w = arrays.words(data, offsets)
    starts = arrays.whole_windows(w.row, width)
    if not len(starts):
        return
    numbers, distinct = arrays.coded(w.data, w.bounds)
    hashes = arrays.column_hashes(distinct)
    doc = docs[w.row[starts]]
    whole = arrays.window_hashes(hashes[numbers], width)[starts]
    settled = starts_earlier(numbers, hashes, starts, doc, width, whole)
    text, shift = arrays.spaced(w.data, w.bounds).tobytes(), w.bounds + np.arange(len(w.bounds))
    words_of = lambda at: lambda k: text[shift[starts[at[k]]] : shift[starts[at[k]] + width] - 1]
    several = np.unique(whole[settled])
    left = np.flatnonzero(~settled)
    settled[left] = met.earlier(whole[left], doc[left], words_of(left))

    least = arrays.window_hashes(hashes[numbers], MINIMISER_WORDS)
    if len(hot):  # hot runs come after all others
        last = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        least = (least >> np.uint64(1)) | (last.astype(np.uint64) << np.uint64(63))
    reach, have = width - MINIMISER_WORDS + 1, 1
    while have < reach:
        step = min(have, reach - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = least[starts]
    if len(hot):
        only = least >> np.uint64(63) > 0
        least[only] = whole[only]
    often = np.zeros(len(starts), bool)
    if hot_windows is not None and len(hot_windows):
        often = hot_windows[np.minimum(np.searchsorted(hot_windows, whole), len(hot_windows) - 1)] == whole
        least[often] = whole[often]
    # Windows that repeat here, or that the sample shows to be frequent, are kept for later slices.
    again = ~settled & _maybe_in(several, whole)
    again[again] = np.isin(whole[again], several)
    kept = np.flatnonzero(again | (often & ~settled))
    met.add(whole[kept], doc[kept], words_of(kept))

    apart = np.ones(len(starts), bool)
    apart[1:] = (np.diff(starts) != 1) | (w.row[starts[1:]] != w.row[starts[:-1]])
    turn = apart.copy()
    turn[1:] |= (least[1:] != least[:-1]) | (often[1:] != often[:-1])
    a, b = _runs(~settled, turn)
    bucket = (arrays.mix64(least[a]) % np.uint64(buckets)).astype(np.int64)
    salted = arrays.mix64(least[a] ^ arrays.mix64(np.array([salt], np.uint64))[0]) % np.uint64(buckets)
    bucket = np.where(often[a], buckets + salted.astype(np.int64), bucket)
    out = _parcels(w, docs, keys, w.rows, starts[a], starts[b - 1] + width, bucket, text, shift)
    a, b = _runs(settled, apart)
    if len(a):
        out.append((int(starts[a[0]] + len(data)) % buckets, *_places(w, docs, keys, w.rows, starts[a], b - a - 1 + width), None))
    yield _sent(out)


def _sent(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "docs", "places", "text"])


def _parcels(w: arrays.Words, docs: np.ndarray, keys: np.ndarray, origin: np.ndarray, first: np.ndarray, end: np.ndarray, bucket: np.ndarray, text: bytes, shift: np.ndarray) -> list[tuple]:
    """What goes to each bucket: the words ``first`` to ``end`` of each entry, and their places."""
    order = np.argsort(bucket, kind="stable")
    first, end, bucket = first[order], end[order], bucket[order]
    left, right = shift[first].tolist(), (shift[end] - 1).tolist()
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    out = []
    for i, j in zip(edges, edges[1:]):  # noqa: B905
        packed = b"\n".join([text[x:y] for x, y in zip(left[i:j], right[i:j], strict=True)])
        out.append((int(bucket[i]), *_places(w, docs, keys, origin, first[i:j], None), zstandard.compress(packed, 1)))
    return out


def _places(w: arrays.Words, docs: np.ndarray, keys: np.ndarray, origin: np.ndarray, first: np.ndarray, span: np.ndarray | None) -> tuple[bytes, bytes]:
    """Documents (id and key) and, as differences, each entry's document and first word, counted from its row's ``origin``."""
    row = w.row[first]
    met, at = np.unique(row, return_inverse=True)
    entry = [at, first - origin[row]] + ([] if span is None else [span])
    differences = np.diff(np.array(entry, np.int32), prepend=np.int32(0))
    return np.array([docs[met], keys[met]]).tobytes(), zstandard.compress(differences.tobytes(), 1)


def _placed(docs: bytes, places: bytes, rows: int) -> list[np.ndarray]:
    """What ``_places`` packed: id, key and first word of each entry, and any span."""
    entry = np.cumsum(np.frombuffer(zstandard.decompress(places), np.int32).reshape(rows, -1), 1, dtype=np.int32)
    ids = np.frombuffer(docs, np.int64).reshape(2, -1)
    return [ids[0][entry[0]], ids[1][entry[0]], *entry[1:]]


_FOUND = "doc_id bigint, row_key bigint, first int, span int"


def _found(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc_id", "row_key", "first", "span"])


def _search(sent: list[tuple[bytes, bytes, bytes]], width: int, again: int = 0) -> tuple[pa.RecordBatch, list[tuple]]:
    """The spans of the windows of a bucket that start in a smaller document too.

    With ``again``, also the windows left, packed for so many buckets by their own hash.
    """
    docs, keys, first = (np.concatenate(c) for c in zip(*(_placed(d, p, 2) for d, p, _ in sent), strict=True))
    w = arrays.single_spaced(np.frombuffer(b"\n".join([zstandard.decompress(t) for _, _, t in sent]), np.uint8))
    numbers, distinct = arrays.coded(w.data, w.bounds)
    starts = arrays.whole_windows(w.row, width)
    row = w.row[starts]
    # Hashes that go to other buckets are of the words; here the words' numbers do.
    hashes = arrays.column_hashes(distinct) if again else arrays.mix64(np.arange(len(distinct)))
    found = starts_earlier(numbers, hashes, starts, docs[row], width)
    apart = np.ones(len(starts), bool)
    apart[1:] = row[1:] != row[:-1]
    a, b = _runs(found, apart)
    at = row[a]
    spans = _found([docs[at], keys[at], (first[at] + starts[a] - w.rows[at]).astype(np.int32), (b - a - 1 + width).astype(np.int32)])
    if not again:
        return spans, []
    left = starts[~found]
    whole = arrays.window_hashes(hashes[numbers], width)[left]
    bucket = (arrays.mix64(whole) % np.uint64(again)).astype(np.int64)
    return spans, _parcels(w, docs, keys, w.rows[:-1] - first, left, left + width, bucket, w.data.tobytes(), w.bounds)


def repeated_spans(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", often: int = HOT_RUNS, sample: int = HOT_SAMPLE) -> DataFrame:
    """Where windows repeat: ``doc_id, row_key, first, span``, counted in words.

    ``row_key`` is a hash of the text and tells rows of one id apart. Spans may
    overlap. Rows without an id take no part, since no id is smaller than none.
    ``often`` and ``sample`` say which runs are hot; the result doesn't depend on them.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, salt = Met(), TaskContext.get().partitionId() % SALTS
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            yield from _pack(part, width, buckets, hot.value[0], met, hot.value[1], salt)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            for bucket, docs, places, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if text is None:
                    yield whole_row(_found(_placed(docs, places, 3)), None)
                else:
                    held.setdefault(bucket, []).append((docs, places, text))
        while held:
            bucket, sent = held.popitem()
            spans, left = _search(sent, width, again=buckets if bucket >= buckets else 0)
            yield whole_row(spans, None)
            if left:
                yield whole_row(None, _sent(left))
            arrays.release()

    def whole_row(spans: pa.RecordBatch | None, left: pa.RecordBatch | None) -> pa.RecordBatch:
        """Spans found, or what is to be sent again; the other columns are null."""
        n = (left if spans is None else spans).num_rows
        kinds = [(c, k) for names, k in ((("doc_id", "row_key"), pa.int64()), (("first", "span", "bucket"), pa.int32()), (("docs", "places", "text"), pa.binary())) for c in names]
        given = {name: part.column(k) for part in (spans, left) if part is not None for k, name in enumerate(part.schema.names)}
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, k)) for c, k in kinds], names=[c for c, _ in kinds])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    rows = rows.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    tasks = parts_for(rows, "text", TASK_BYTES, factor=3)
    buckets = tasks * TASK_BUCKETS
    hot = docs.sparkSession.sparkContext.broadcast(hot_runs(rows, often, sample, width))
    found = map_arrow(map_arrow(rows, pack, _SENT).repartition(tasks, "bucket"), search, f"{_FOUND}, {_SENT}")
    spans = found.where("doc_id IS NOT NULL").select("doc_id", "row_key", "first", "span")
    if not len(hot.value[1]):  # no window goes in two steps
        return spans
    found = Scratch(docs.sparkSession, "salted").keep(found, "found")
    spans = found.where("doc_id IS NOT NULL").select("doc_id", "row_key", "first", "span")
    again = found.where("bucket IS NOT NULL").select("bucket", "docs", "places", "text").repartition(tasks, "bucket")
    rest = map_arrow(again, search, f"{_FOUND}, {_SENT}").select("doc_id", "row_key", "first", "span")
    return spans.unionByName(rest)


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", rejoin: bool = True) -> DataFrame:
    """Cut repeated windows out of the texts, all but those of the smallest id.

    Adds ``n_words`` and ``n_removed``; ``text_col`` becomes the kept words,
    joined by one space. Without ``rejoin`` a text that loses nothing stays as it
    is, white space, nulls and all. Words are runs of bytes other than white space
    ([\\x20\\x09-\\x0D]); windows are judged on the input. A null text becomes
    empty. Texts of fewer than ``width`` words stay whole, and so do rows without
    an id. Rows that share an id do not remove from each other; repeated rows get
    equal results. Other columns pass through, whatever their names, but for
    those called ``n_words`` or ``n_removed``, which the new ones replace. An
    empty table gives an empty one.
    """
    docs = without(docs, "n_words", "n_removed")
    own_id, own_key, own_first, own_span = unused(docs, "id", "key", "first", "span")
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = scratch.keep(repeated_spans(docs, width, id_col, text_col), "spans")
    spans = spans.distinct().groupBy("doc_id", "row_key").agg(F.collect_list("first").alias(own_first), F.collect_list("span").alias(own_span))
    spans = spans.select(F.col("doc_id").alias(own_id), F.col("row_key").alias(own_key), own_first, own_span)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, text_col, SLICE_BYTES):
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            first, span = columns.pop(own_first), columns.pop(own_span)
            data, offsets = arrays.utf8(columns[text_col])
            w = arrays.words(data, offsets)
            row = first.value_parent_indices().to_numpy() if hasattr(first, "value_parent_indices") else np.repeat(np.arange(len(first)), first.value_lengths().fill_null(0).to_numpy())
            start = w.rows[row] + first.flatten().to_numpy()
            change = np.zeros(len(w.row) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + span.flatten().to_numpy(), -1)
            keep = np.cumsum(change[:-1]) == 0
            length = np.diff(w.bounds)
            bounds = np.concatenate([[0], np.cumsum(length[keep])])
            text = arrays.spaced(w.data[np.repeat(keep, length)], bounds).tobytes()
            kept = np.concatenate([[0], np.cumsum(keep)])[w.rows]
            at = (bounds[kept] + kept).tolist()
            cut_texts = pa.array([text[i : j - 1] if j > i else b"" for i, j in zip(at, at[1:])], pa.binary()).cast(pa.string())  # noqa: B905
            same = pa.array(np.diff(w.rows) == np.diff(kept))
            columns[text_col] = cut_texts if rejoin else pc.if_else(same, columns[text_col], cut_texts)
            columns["n_words"] = pa.array(np.diff(w.rows))
            columns["n_removed"] = pa.array(np.diff(w.rows) - np.diff(kept))
            yield pa.RecordBatch.from_pydict({name: columns[name] for name in schema.names})

    joined = docs.join(spans, (F.col(quoted(id_col)).cast("long") == F.col(own_id)) & (F.xxhash64(F.coalesce(quoted(text_col), F.lit(""))) == F.col(own_key)), "left").drop(own_id, own_key)
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*map(quoted, rest)).schema.add(text_col, "string").add("n_words", "long").add("n_removed", "long")
    return map_arrow(joined, cut, schema).select(*map(quoted, docs.columns), "n_words", "n_removed")
