"""Whole Arrow columns of text as NumPy arrays: words, word numbers, hashes.

The Python side of the text operators works on slices of a few megabytes with
a fixed number of NumPy passes, so a task's memory follows the slice, not the
partition, and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The bytes that end a word, [\x20\x09-\x0D].
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values.astype(np.uint64) + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's byte bounds (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_string()) if pa.types.is_string(column.type) else column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if len(column) == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Hand freed memory back, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice has more than ``most`` bytes of text, or one row."""
    for part in _slices(batches, column, most):
        yield part
        release()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words(NamedTuple):
    """The words of a slice of rows, in order."""

    data: np.ndarray  # their bytes without white space
    bounds: np.ndarray  # of each word in data
    rows: np.ndarray  # of each row in words
    row: np.ndarray  # the row of each word


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = IS_SPACE) -> Words:
    """Split rows at white space, or at the bytes that ``apart`` marks; a word never crosses rows."""
    inside = ~apart[data]
    turn = np.zeros(len(data) + 1, dtype=bool)  # where a row begins, or the one before it has ended
    turn[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | turn[1:-1]
    ends[:-1] &= ~inside[1:] | turn[1:-1]
    starts = np.flatnonzero(begins)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) - starts + 1, out=bounds[1:])
    del begins, ends, turn
    rows = np.searchsorted(starts, offsets).astype(np.int64)
    return Words(data[inside], bounds, rows, np.repeat(np.arange(len(rows) - 1), np.diff(rows)))


def single_spaced(data: np.ndarray) -> Words:
    """Split lines of words with one blank between, as ``words`` does; ``data`` stays, each word with the blank that follows it."""
    ends = np.flatnonzero((data == 0x20) | (data == 0x0A))
    rows = np.concatenate([[0], np.flatnonzero(data[ends] == 0x0A) + 1, [len(ends) + 1]])
    bounds = np.concatenate([[0], ends + 1, [len(data) + 1]])
    spaced = np.append(data, np.uint8(0x20))
    spaced[ends] = 0x20
    return Words(spaced, bounds, rows, np.repeat(np.arange(len(rows) - 1), np.diff(rows)))


def as_binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow column over ``data``, without a copy of it."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def coded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number equal words alike: each word's number, and the distinct words as a column."""
    found = as_binary(data, bounds).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def _each(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column, cut from its bytes: Arrow makes a scalar of each first."""
    data, offsets = utf8(column)
    at = offsets.tolist()
    return map(data.tobytes().__getitem__, map(slice, at, at[1:]))


def numbered(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number equal words alike: each word's number, and the distinct words."""
    numbers, distinct = coded(data, bounds)
    return numbers, list(_each(distinct))


def word_hashes(distinct: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def column_hashes(distinct: pa.Array) -> np.ndarray:
    """``word_hashes`` of a binary column, of which no more than one value is held as an object."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, _each(distinct)), np.uint64, len(distinct))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word hashes (rolling, mixed)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power, out=total[1:])
    return mix64((total[width:] - total[:-width]) * inverse[: n - width + 1])


def whole_windows(row: np.ndarray, width: int) -> np.ndarray:
    """Positions at which ``width`` consecutive words lie in one row."""
    if len(row) < width:
        return np.zeros(0, np.int64)
    return np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])


def spaced(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The words, each followed by one blank; word k starts at ``bounds[k] + k``."""
    lengths = np.diff(bounds)
    out = np.full(len(data) + len(lengths), 0x20, np.uint8)
    own = np.ones(len(out), bool)
    own[bounds[1:] + np.arange(len(lengths))] = False
    out[own] = data
    return out


def take_ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` for each pair, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
