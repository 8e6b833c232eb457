"""Similarity search: pools of nearest rows, grouped, faceted, paged and recent results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.latest import first_by

#: Similarities are rounded, so that ties don't depend on the order of a sum.
DIGITS = 6


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch that aren't null, scaled to length 1, and where they are."""
    have = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    vectors = flat.reshape(len(have), -1) if len(have) else np.zeros((0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True)), have


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def similarity_to(vector: Column, query: list[float] | None, digits: int = DIGITS) -> Column:
    """Cosine similarities to one vector, a batch at a time; null for nulls and vectors without a length."""
    q = np.asarray(query if query is not None else [], float)
    q = q / (np.sqrt(q @ q) or np.nan)

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        units, have = _matrix(_plain(batch))
        out = np.full(len(batch), np.nan)
        if len(have) and len(q) == units.shape[1]:
            out[have] = np.round(units @ q, digits)
        return pa.array(out, mask=np.isnan(out))

    return run(vector)


def with_similarity(rows: DataFrame, query: DataFrame, vector: str = "embedding", digits: int = DIGITS) -> DataFrame:
    """Add ``sim``, the cosine similarity to the one vector of ``query`` (column ``q``, its first row)."""
    asked = query.select("q").limit(1).collect()  # one vector
    return rows.withColumn("sim", similarity_to(F.col(vector), asked[0]["q"] if asked else None, digits))


def nearest(rows: DataFrame, key: str, k: int, floor: float | None = None) -> DataFrame:
    """The ``k`` most similar rows, ties by key; each task keeps its own best ``k`` first."""
    rows = rows if floor is None else rows.where(F.col("sim") >= floor)
    return rows.orderBy(F.col("sim").desc_nulls_last(), F.col(key)).limit(k)


def held(pool: DataFrame, most: int = 1000) -> DataFrame:
    """A pool of a bounded number of rows, worked out once: ``most`` and more raise."""
    rows = pool.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a pool has at most {most} rows")
    return pool.sparkSession.createDataFrame(rows, pool.schema)


#: Queries of up to so many bytes go to every task; more are dealt in blocks, as rows are.
QUERY_BYTES, BLOCK_QUERIES, BLOCK_ROWS = 32 << 20, 2_000, 50_000


#: Numbers of a matrix product that are held at once.
PRODUCT = 1 << 20


def in_blocks(rows: int, width: int, most: int = PRODUCT) -> Iterator[slice]:
    """Slices of so many rows that a matrix of them and ``width`` columns has about ``most`` numbers."""
    step = max(1, most // max(1, width))
    return (slice(k, k + step) for k in range(0, rows, step))


def _best(names: pa.Array, q: np.ndarray, keys: pa.Array, units: np.ndarray, k: int) -> list[pa.Array]:
    """The best ``k`` rows of each query, ties by key: query names, row keys, similarities; none without a similarity.

    Queries come in blocks, so what is held doesn't follow their number; of a
    query's similarities those as good as the ``k``-th are sorted, not all.
    """
    place = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
    placed, n = units[place], len(units)
    of, at, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for some in in_blocks(len(q) if n else 0, n):
        own = np.round(q[some] @ placed.T, DIGITS)
        own[np.isnan(own)] = -np.inf
        least = np.partition(own, n - k, axis=1)[:, n - k] if n > k else np.full(len(own), -np.inf)
        row, col = np.nonzero((own >= least[:, None]) & (own > -np.inf))
        order = np.lexsort((col, -own[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, row)  # where the query's rows begin
        kept = np.arange(len(row)) - first < k
        row, col = row[kept], col[kept]
        of, at, sims = [*of, row + some.start], [*at, place[col]], [*sims, own[row, col]]
    return [names.take(pa.array(np.concatenate(of))), keys.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(sims))]


def nearest_of_each(rows: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, vector: str = "embedding", query_bytes: int = QUERY_BYTES, block_queries: int = BLOCK_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest rows of each of a stated set of queries, against all rows.

    ``key, query_key, sim``; ties by key. Rows meet queries as matrix products, and
    each hands on only its own best ``k`` of each query; so no pair of all rows and
    queries is ever a row. Queries of at most ``query_bytes`` are broadcast, and
    each batch of rows is one product. More of them are dealt in blocks that meet
    blocks of rows, a bounded number of both in a task.
    """
    asked = queries.select(query_key, "q").where("q IS NOT NULL")
    kinds = dict(rows.dtypes) | {query_key: dict(asked.dtypes)[query_key]}
    schema = f"`{query_key}` {kinds[query_key]}, `{key}` {kinds[key]}, sim double"
    n, size = asked.agg(F.count(F.lit(1)), F.sum(F.size("q")) * 8).first()
    if (size or 0) <= query_bytes:
        held = asked.toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((_plain(held.column(0)), _matrix(_plain(held.column(1)))[0]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for batch in batches:
                units, have = _matrix(batch.column(1))
                if len(have) and len(q):
                    yield pa.RecordBatch.from_arrays(_best(names, q, batch.column(0).take(pa.array(have)), units, k), names=[query_key, key, "sim"])

        best = rows.select(key, vector).mapInArrow(run, schema)
    else:
        blocks, sections = -(-n // block_queries), max(1, -(-rows.count() // block_rows))
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        own = lambda parts: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
        left = asked.withColumn("__block", own(blocks)).withColumn("__section", every(sections))
        right = rows.select(key, vector).where(F.col(vector).isNotNull()).withColumn("__section", own(sections)).withColumn("__block", every(blocks))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            q, units = _matrix(_plain(a.column("q")))[0], _matrix(_plain(b.column(vector)))[0]
            return pa.table(dict(zip((query_key, key, "sim"), _best(_plain(a.column(query_key)), q, _plain(b.column(key)), units, k), strict=True)))

        best = left.groupBy("__block", "__section").cogroup(right.groupBy("__block", "__section")).applyInArrow(meet, schema)
    return first_by(best.where("NOT isnan(sim)"), [query_key], [F.col("sim").desc(), F.col(key)], k)


#: How groups can be ordered; ties go to the better best match, then the group.
GROUP_ORDERS = {"mentions": "mentions", "best_match": "best_sim", "avg_match": "avg_sim", "keyword_hits": "keyword_hits"}


def grouped(pool: DataFrame, group: str, key: str, floor: float, order: str = "mentions", groups: int = 5, per_group: int = 3) -> DataFrame:
    """The top groups of a pool and the best rows of each.

    Counts are over the pool: rows of no group or below the floor don't count.
    """
    ok = pool.where(F.col(group).isNotNull() & (F.col("sim") >= floor))
    hits = F.sum(F.col("keyword_hit").cast("int")) if "keyword_hit" in pool.columns else F.lit(0)
    stats = ok.groupBy(group).agg(F.count(F.lit(1)).alias("mentions"), F.max("sim").alias("best_sim"), F.round(F.avg("sim"), 4).alias("avg_sim"), hits.cast("long").alias("keyword_hits"))
    top = stats.orderBy(F.col(GROUP_ORDERS[order]).desc(), F.col("best_sim").desc(), F.col(group)).limit(groups)
    best = first_by(ok.join(F.broadcast(top), group), [group], [F.col("sim").desc(), F.col(key)], per_group)
    return best.select(group, "mentions", "best_sim", "avg_sim", "keyword_hits", key, "sim")


def facets(pool: DataFrame, values: dict[str, Column], most: dict[str, int] | None = None) -> DataFrame:
    """Counts and average similarity by several facets of one pool: ``facet, value, n, avg_sim``.

    One pass: each row is a row for each facet it has a value of. ``most`` keeps
    the largest values of a facet only (a feature of reports).
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value")) for name, value in values.items()])
    rows = pool.select("sim", F.explode(pairs).alias("p")).select("p.facet", "p.value", "sim").where("value IS NOT NULL")
    out = rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 3).alias("avg_sim"))
    if not most:
        return out
    limits = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "value"))
    return out.withColumn("__p", place).where(F.col("__p") <= F.coalesce(F.try_element_at(limits, F.col("facet")), F.lit(1 << 30))).drop("__p")


def capped_count(rows: DataFrame, cap: int = 1000) -> DataFrame:
    """``total, capped``: counting stops one row after the cap."""
    n = rows.select(F.lit(1)).limit(cap + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(cap)).cast("long").alias("total"), (F.col("n") > cap).alias("capped"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def recent_of_nearest(rows: DataFrame, key: str, at: str, pool: int = 200, keep: int = 50) -> DataFrame:
    """The most recent rows of the nearest ones."""
    return nearest(rows, key, pool).orderBy(F.col(at).desc_nulls_last(), F.col(key)).limit(keep)


def keyword_overlap(pool: DataFrame) -> DataFrame:
    return pool.agg(F.count_if("keyword_hit").alias("both_hits"), F.count_if(~F.col("keyword_hit")).alias("semantic_only"))


def rerank(rows: DataFrame, scorer, columns: list[str], key: str, pool: int = 100, keep: int = 10) -> DataFrame:  # noqa: ANN001
    """Score the nearest ``pool`` rows again with a pandas function of ``columns``."""
    again = F.pandas_udf(scorer, "double")
    return nearest(rows, key, pool).withColumn("rerank", again(*columns)).orderBy(F.col("rerank").desc(), F.col(key)).limit(keep)
