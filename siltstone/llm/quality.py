"""Quality scores by regularised quadratic discriminant analysis (operator 6).

Every text is turned into a few statistics of its bytes, words and lines, made
even by logarithms. Each label has a mean and a covariance of them, shrunk
towards the pooled covariance and towards a multiple of the identity, so that
neither few rows nor statistics that move together make it singular. The score is the
logistic function of the difference of the two log-densities, each a Mahalanobis
distance by a Cholesky factor that is computed once and shipped to all tasks.

The fit needs no more than sums, of the statistics and of their products, for
each label: they are added up on the executors over all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, quoted, type_of, without

SLICE_BYTES = 3 << 20
STATISTICS = (
    "words", "word_length", "word_spread", "longest_word", "upper", "digits", "stops", "commas", "shouts", "symbols", "bars",
    "markup", "foreign", "capitals", "distinct_words", "distinct_pairs", "same_as_before", "lines", "distinct_lines", "closed_words",
)
#: Shrinkage towards the pooled covariance, and of that towards the identity.
GRID = [(a, b) for a in (0.05, 0.2, 0.5, 0.8) for b in (0.01, 0.1, 0.3)]

#: The bytes of each class.
_CLASSES = {
    "upper": range(0x41, 0x5B),
    "digits": range(0x30, 0x3A),
    "stops": b".",
    "commas": b",;:",
    "shouts": b"!?",
    "symbols": b"#$%&*+=@^_~",
    "bars": b"|/\\-",
    "markup": b"<>{}[]()\"'`",
    "foreign": range(0x80, 0x100),
}


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each whole text of a slice (rows by ``STATISTICS``)."""
    data, offsets = arrays.utf8(column)
    n = len(column)
    size = np.diff(offsets)
    w = arrays.words(data, offsets)
    words = np.diff(w.rows)
    some, many = np.maximum(words, 1), np.maximum(size, 1)
    out = np.zeros((n, len(STATISTICS)))
    put = lambda name, values: out.__setitem__((slice(None), STATISTICS.index(name)), values)
    share = lambda x: np.log(x + 0.002)  # noqa: E731  even out small shares
    put("words", np.log1p(words))
    length = np.diff(w.bounds)
    mean = np.bincount(w.row, length, n) / some
    put("word_length", np.log1p(mean))
    put("word_spread", np.log1p(np.sqrt(np.maximum(np.bincount(w.row, length.astype(float) ** 2, n) / some - mean**2, 0))))
    longest = np.zeros(n)
    np.maximum.at(longest, w.row, length)
    put("longest_word", np.log1p(longest))
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.int32)
        table[list(members)] = 1
        count = np.concatenate([np.zeros(1, np.int32), np.cumsum(table[data], dtype=np.int32)])
        put(name, share((count[offsets[1:]] - count[offsets[:-1]]) / many))
    first, last = w.data[w.bounds[:-1]], w.data[w.bounds[1:] - 1]
    put("capitals", share(np.bincount(w.row, (first >= 0x41) & (first <= 0x5A), n) / some))
    put("closed_words", share(np.bincount(w.row, np.isin(last, list(b".,;:!?")), n) / some))
    number, distinct = arrays.numbered(w.data, w.bounds)
    number = number.astype(np.int64)
    put("distinct_words", share(_distinct(w.row, number, n) / some))
    pairs = np.flatnonzero(w.row[1:] == w.row[:-1])
    count = np.maximum(words - 1, 1)
    put("distinct_pairs", share(_distinct(w.row[pairs], number[pairs] * (len(distinct) + 1) + number[pairs + 1], n) / count))
    put("same_as_before", share(np.bincount(w.row[pairs], number[pairs] == number[pairs + 1], n) / count))
    ends = np.unique(np.concatenate([np.flatnonzero(data == 0x0A) + 1, offsets]))
    line, _ = arrays.numbered(data, ends) if len(ends) > 1 else (np.zeros(0, np.int64), [])
    row = np.searchsorted(offsets, ends[:-1], "right") - 1
    lines = np.bincount(row, minlength=n)[:n] if len(row) else np.zeros(n)
    put("lines", np.log1p(lines) - np.log1p(words))
    put("distinct_lines", share(_distinct(row, line.astype(np.int64), n) / np.maximum(lines, 1)))
    return out


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return np.bincount(row, new, n)


class Discriminant(NamedTuple):
    """Means, inverse Cholesky factors and log-determinants of both labels."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        log_density = np.empty((len(x), 2))
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            log_density[:, k] = self.log_prior[k] - self.log_det[k] / 2 - (z * z).sum(1) / 2
        return 1 / (1 + np.exp(np.clip(log_density[:, 0] - log_density[:, 1], -60, 60)))


def fit(count: np.ndarray, total: np.ndarray, product: np.ndarray, to_pooled: float, to_identity: float) -> Discriminant:
    """From each label's row count, sums and sums of products."""
    d = total.shape[1]
    mean = total / count[:, None]
    scatter = product - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(0) / count.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))  # the identity is meant for standardised statistics
    factor, log_det = np.empty((2, d, d)), np.empty(2)
    for k in (0, 1):
        cov = (1 - to_pooled) * scatter[k] / count[k] + to_pooled * pooled
        cov = cov / scale[:, None] / scale
        cov = (1 - to_identity) * cov + to_identity * np.eye(d) * max(np.trace(cov) / d, 1e-6)
        lower = np.linalg.cholesky(cov)
        factor[k] = np.linalg.inv(lower) / scale
        log_det[k] = 2 * np.log(np.diag(lower)).sum()
    return Discriminant(mean, factor, log_det, np.log(count / count.sum()))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``x``, the statistics of each whole text (null: empty).

    Every row has a row, repeated ones and those without an id too; an empty table
    gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            x = statistics(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "x"])

    rows = docs.select(F.col(quoted(id_col)), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"{quoted(id_col)} {type_of(docs, id_col)}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(labelled: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Sums over ``label, fold, x``: for each label and fold the count, sums and products."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            label, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _matrix(batch.column(2))
            x = np.column_stack([np.ones(len(x)), x])
            for key in {*zip(label.tolist(), fold.tolist(), strict=True)}:
                own = x[(label == key[0]) & (fold == key[1])]
                total[key] = total.get(key, 0) + own.T @ own
        for (a, b), m in total.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([a], pa.int32()), "fold": pa.array([b], pa.int32()), "m": pa.array([m.ravel().tolist()])})

    parts = map_arrow(labelled.select("label", "fold", "x"), run, "label int, fold int, m array<double>")
    # (d + 1)^2 numbers for each label and fold, added up on the executors.
    added = parts.select("label", "fold", F.posexplode("m").alias("at", "v")).groupBy("label", "fold", "at").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in added.collect():
        out.setdefault((r["label"], r["fold"]), np.zeros((d + 1) ** 2))[r["at"]] = r["v"]
    return {k: v.reshape(d + 1, d + 1) for k, v in out.items()}


def _from_sums(sums: dict[tuple[int, int], np.ndarray], folds: tuple[int, ...], to_pooled: float, to_identity: float) -> Discriminant:
    d = len(STATISTICS)
    m = np.array([sum((sums[k, f] for f in folds if (k, f) in sums), np.zeros((d + 1, d + 1))) for k in (0, 1)])
    # A label without rows looks like all rows together.
    m = np.where(m[:, :1, :1] > 0, m, m.sum(0) + np.eye(d + 1))
    return fit(m[:, 0, 0], m[:, 0, 1:], m[:, 1:, 1:], to_pooled, to_identity)


def learn(statistics_of: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on the labelled rows that are ``usable``, a condition on ``id_col``.

    Of the shrinkages in ``GRID`` the one is taken that scores one half of these
    rows best (log-loss, both labels of equal weight) when fitted on the other;
    then all of them are fitted. Labels other than 0 and 1, and nulls, are not used,
    and a label given twice counts once. Without any labelled row the model says
    0.5 of every text; without rows of one label, it takes all rows for that one's.
    """
    marks = labels.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(label_col)).cast("int").alias("label")).where("label IN (0, 1)").distinct()
    rows = statistics_of.where(usable).join(marks, F.col(quoted(id_col)) == F.col("__id"))
    rows = rows.select("label", F.pmod(F.xxhash64(F.col(quoted(id_col)), F.lit("fold")), F.lit(2)).cast("int").alias("fold"), "x")
    sums = _sums(rows)
    if not sums:
        d = len(STATISTICS)
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), np.zeros(2))
    models = [_from_sums(sums, (0,), *g) for g in GRID]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for k, model in enumerate(models):
                p = np.clip(model.scores(x), 1e-6, 1 - 1e-6)
                for mark in (0, 1):
                    own = p[label == mark] if mark else 1 - p[label == mark]
                    yield pa.RecordBatch.from_pydict({"model": pa.array([k], pa.int32()), "label": pa.array([mark], pa.int32()), "n": pa.array([len(own)], pa.int64()), "loss": pa.array([float(-np.log(own).sum())])})

    losses = map_arrow(rows.where("fold = 1").select("label", "x"), run, "model int, label int, n bigint, loss double")
    means = losses.groupBy("model", "label").agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("loss")).groupBy("model").agg(F.sum("loss").alias("loss")).collect()
    best = min(means, key=lambda r: (round(r["loss"] or 0, 6), r["model"]))["model"] if means else 0
    return _from_sums(sums, (0, 1), *GRID[best])


def score(statistics_of: DataFrame, model: Discriminant) -> DataFrame:
    """Replace ``x`` by ``score``, from 0 to 1; every row gets one, empty texts too.

    Repeated rows get equal scores and an empty table stays empty. Another column
    named ``score`` is replaced.
    """
    statistics_of = without(statistics_of, "score")
    shared = statistics_of.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["score"] = pa.array(shared.value.scores(_matrix(columns.pop("x"))) if batch.num_rows else np.zeros(0))
            yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(statistics_of, run, statistics_of.drop("x").schema.add("score", "double"))
