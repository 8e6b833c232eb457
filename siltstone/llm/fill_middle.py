"""Fill-in-middle transformation by a byte automaton (operator 11).

A table gives, for each state and class of byte, the next state and what the
byte begins or ends: a code point, a unit (a run of ASCII letters, or one other
code point), a sentinel. One scan over the bytes follows UTF-8 continuation,
unit bounds and sentinels together, and emits a mark for each byte whose
transition counts; sums of the marks are the numbers of units, code points and
sentinels. A second pass looks up at which byte the units lie where a text is
cut, and joins the parts from there.

No state depends on more than the last three bytes. So the bytes of a slice are
cut into lanes that the table drives side by side, each lane starting a few
bytes early; the scan is a number of array lookups, not a loop over bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, quoted, without

SLICE_BYTES = 2 << 20
#: The marks before the prefix, the suffix and the middle, and shares in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

# Classes of bytes.
LETTER, MARK, OPEN, CLOSE, OTHER, LEAD2, LEAD3, LEAD4, TAIL, APART = range(10)
# States: after a unit that is no letter run, in a letter run, after "<", after "<" and one of P, S and
# M, and with one, two or three bytes of a code point to come.
BETWEEN, RUN, OPENED, MARKED, NEED1, NEED2, NEED3 = range(7)
# What a transition counts.
POINT, UNIT, SENTINEL = 1, 2, 4
#: Follows each row and ends whatever it ended in; no byte of UTF-8 has this value.
END = 0xFF
#: A lane starts so many bytes early; three would do.
EARLY = 4


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for first, last, kind in ((0x41, 0x5A, LETTER), (0x61, 0x7A, LETTER), (0x80, 0xBF, TAIL), (0xC0, 0xDF, LEAD2), (0xE0, 0xEF, LEAD3), (0xF0, 0xF7, LEAD4)):
        out[first : last + 1] = kind
    out[[s[1] for s in (PREFIX, SUFFIX, MIDDLE)]] = MARK
    out[ord("<")], out[ord(">")], out[END] = OPEN, CLOSE, APART
    return out


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the counted marks, by state and class."""
    step, marks = np.zeros((7, 10), np.uint8), np.full((7, 10), POINT | UNIT, np.uint8)
    for state in range(7):
        in_run = state in (RUN, MARKED)
        step[state] = [RUN, MARKED if state == OPENED else RUN, OPENED, BETWEEN, BETWEEN, NEED1, NEED2, NEED3, {NEED3: NEED2, NEED2: NEED1}.get(state, BETWEEN), BETWEEN]
        if in_run:
            marks[state, [LETTER, MARK]] = POINT
        marks[state, TAIL] = marks[state, APART] = 0
    marks[MARKED, CLOSE] |= SENTINEL
    return step, marks


CLASS = _classes()
STEP, MARKS = _transitions()


class Scan(NamedTuple):
    """The counted transitions of a slice of rows."""

    units: np.ndarray  # the bytes at which units begin
    unit_rows: np.ndarray  # bounds of each row in units
    point_sums: np.ndarray  # code points before each byte
    sentinels: np.ndarray  # the bytes at which sentinels end
    sentinel_rows: np.ndarray


def scan(data: np.ndarray, offsets: np.ndarray, lane: int = 512) -> Scan:
    """Run the automaton over rows of bytes, each from its first state."""
    n, rows = len(data), len(offsets) - 1
    # Rows follow each other with an end after each; lanes of equal length, ends before the first.
    at = np.arange(n) + np.repeat(np.arange(rows), np.diff(offsets))
    lanes = max(1, -(-(n + rows) // lane))
    kinds = np.full(EARLY + lanes * lane, APART, np.uint8)
    kinds[EARLY + at] = CLASS[data]
    state = np.zeros(lanes, np.intp)
    table, emits = STEP.astype(np.intp).ravel(), MARKS.ravel()
    out = np.empty((lanes, lane), np.uint8)
    view = np.lib.stride_tricks.as_strided(kinds, (lanes, EARLY + lane), (lane, 1), writeable=False)
    for k in range(EARLY + lane):
        key = state * 10 + view[:, k]
        if k >= EARLY:
            out[:, k - EARLY] = emits[key]
        state = table[key]
    marks = out.ravel()[at]
    points = np.zeros(n + 1, np.int64)
    np.cumsum(marks & POINT, out=points[1:])
    units, sentinels = np.flatnonzero(marks & UNIT), np.flatnonzero(marks & SENTINEL)
    return Scan(units, np.searchsorted(units, offsets), points, sentinels, np.searchsorted(sentinels, offsets))


def _cuts(found: Scan, offsets: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The byte at which each row's unit of this number begins, or its end."""
    place = found.unit_rows[:-1] + unit
    known = np.append(found.units, offsets[-1])
    return np.where(place < found.unit_rows[1:], known[np.minimum(place, len(known) - 1)], offsets[1:])


def _joined(parts: list[list[memoryview | bytes]]) -> pa.Array:
    return pa.array([b"".join(p) for p in parts], pa.binary()).cast(pa.string())


def _transformed(column: pa.Array, draws: list[np.ndarray]) -> list[pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of a slice."""
    data, offsets = arrays.utf8(column)
    found = scan(data, offsets)
    n = np.diff(found.unit_rows)
    h1, h2, h3, h4 = draws
    first, second = h1 % (n + 1), h2 % (n + 1)
    a, b = (_cuts(found, offsets, f(first, second)) for f in (np.minimum, np.maximum))
    plain = (n == 0) | (np.diff(found.sentinel_rows) > 0) | (h3 % 100 >= PLAIN_FROM)
    suffix_first = ~plain & (h4 % 100 < SPM_BELOW)
    raw, parts = memoryview(np.ascontiguousarray(data)), []
    for start, x, y, end, kept, turned in zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), plain.tolist(), suffix_first.tolist(), strict=True):
        before, middle, after = (PREFIX, raw[start:x]), (MIDDLE, raw[x:y]), (SUFFIX, raw[y:end])
        parts.append([raw[start:end]] if kept else [*after, *before, *middle] if turned else [*before, *after, *middle])
    lengths = [found.point_sums[a] - found.point_sums[offsets[:-1]], found.point_sums[b] - found.point_sums[a]]
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *[pa.array(x, pa.int64(), mask=plain) for x in lengths], _joined(parts)]


def _restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts from outputs and their forms: the three sentinels are where the scan ends them."""
    data, offsets = arrays.utf8(output)
    found = scan(data, offsets)
    raw, parts = memoryview(np.ascontiguousarray(data)), []
    for k, (start, end, kind) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), form.to_pylist(), strict=True)):
        if kind == "plain":
            parts.append([raw[start:end]])
            continue
        ends = found.sentinels[found.sentinel_rows[k] : found.sentinel_rows[k + 1]].tolist()
        if len(ends) != 3 or ends[0] != start + 2 or kind not in ("psm", "spm"):
            raise ValueError(f"an output of form {kind!r} has {len(ends)} sentinels")
        first, second, third = raw[start + 3 : ends[1] - 2], raw[ends[1] + 1 : ends[2] - 2], raw[ends[2] + 1 : end]
        parts.append([first, third, second] if kind == "psm" else [second, third, first])
    return _joined(parts)


def draw_of(id_col: str, seed: str, k: int) -> Column:
    """The ``k``-th group of eight hexadecimal digits of the hash of seed and id, as a number."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * k + 1, 8), 16, 10).cast("long")


ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """Cut every whole text into prefix, middle and suffix, and write it in its form.

    Adds ``n`` (units), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars``
    and ``middle_chars`` (code points; null if plain) and ``output``. Where a text
    is cut, and its form, follow from the seed and its id alone: rows that share
    an id are drawn alike, and a null id counts as an empty one. A null or empty
    text has no units and an empty output; a text that holds a sentinel stays
    plain, so outputs can be restored. Texts of any length are read whole.
    Repeated rows stay repeated, an empty table stays empty; other columns pass
    through, but for those with the names of the added ones, which these replace
    (a text or id column of such a name is read first). Nothing is shuffled.
    """
    kept = [f.name for f in without(docs, *ADDED).schema]
    draws = [f"_draw{k}" for k in range(4)]
    columns = [F.col(quoted(c)).alias(f"_kept{k}") for k, c in enumerate(kept)]
    rows = docs.select(*columns, F.col(quoted(text_col)).alias("_text"), *[draw_of(id_col, seed, k).alias(d) for k, d in enumerate(draws)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "_text", SLICE_BYTES):
            at = len(kept)
            made = _transformed(part.column(at), [part.column(at + 1 + k).to_numpy(zero_copy_only=False) for k in range(4)])
            yield pa.RecordBatch.from_arrays([*part.columns[:at], *made], names=[*part.schema.names[:at], *ADDED])

    schema = rows.select(*[f"_kept{k}" for k in range(len(kept))]).schema
    for name, kind in zip(ADDED, ("long", "string", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)
    made = map_arrow(rows, run, schema)
    return made.select(*[F.col(f"_kept{k}").alias(c) for k, c in enumerate(kept)], *ADDED)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """Add every text again, from its output and form alone.

    A null output counts as empty. Raises where an output doesn't have the three
    sentinels of its form, each once. An empty table stays empty, repeated rows
    stay repeated, and other columns pass through, but for one called ``to``.
    """
    kept = [f.name for f in without(rows, to).schema]
    wide = rows.select(*[F.col(quoted(c)).alias(f"_kept{k}") for k, c in enumerate(kept)], F.col(quoted(output_col)).alias("_output"), F.col(quoted(form_col)).alias("_form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "_output", SLICE_BYTES):
            at = len(kept)
            text = _restored(part.column(at), part.column(at + 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:at], text], names=[*part.schema.names[:at], "_restored"])

    schema = wide.select(*[f"_kept{k}" for k in range(len(kept))]).schema.add("_restored", "string")
    made = map_arrow(wide, run, schema)
    return made.select(*[F.col(f"_kept{k}").alias(c) for k, c in enumerate(kept)], F.col("_restored").alias(to))
