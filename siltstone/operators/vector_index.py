"""A stored index of vectors: cells around centroids, read one by one, ranked exactly.

Centroids are trained on a bounded sample and every vector is assigned to the
nearest of them; a cell is a folder, so a search reads the folders it needs and
ranks their rows by their true similarities. How many cells a search reads is
measured when the index is begun: the least number at which sampled queries find
the target share of their true neighbours. An exact search goes on from there: a
cell's radius bounds how near any of its rows can be, and only the cells that
can still hold a better row are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators.latest import first_by
from siltstone.operators.search import DIGITS, _best, _matrix, _plain, in_blocks, nearest, nearest_of_each, similarity_to
from siltstone.sources.shared import versions

#: The training sample has so many numbers at most, and there are so many cells at most.
SAMPLE_VALUES, MOST_CELLS, ROUNDS = 4_000_000, 4096, 12
#: Queries by which the number of cells to read is measured, and the recall they have to reach.
MEASURED, NEIGHBOURS, TARGET = 100, 20, 0.97
#: A task holds so many rows of a cell and so many queries.
SECTION_ROWS, QUERY_ROWS = 20_000, 2_000
#: Vectors without a direction (null, or all nought) are kept here; no search finds them.
NOWHERE = -1


def trained(units: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of length 1 of unit vectors: spherical k-means from a seeded draw."""
    rnd = np.random.default_rng(seed)
    units = np.unique(units, axis=0)
    centroids = units[rnd.permutation(len(units))[:cells]]
    for _ in range(rounds):
        near = np.concatenate([(units[some] @ centroids.T).argmax(1) for some in in_blocks(len(units), len(centroids))])
        total = np.zeros_like(centroids)
        np.add.at(total, near, units)
        length = np.sqrt((total * total).sum(1, keepdims=True))
        moved = np.where(length > 0, total / np.where(length > 0, length, 1), centroids)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


class VectorIndex:
    """The index at a folder that driver and executors share; see ``begin`` and ``append``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/meta").first()
        self.key, self.vector, self.schema, self.probes, self.recall = meta["key"], meta["vector"], meta["schema"], meta["probes"], meta["recall"]
        table = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
        self.centroids = np.array([r["centroid"] for r in table], float) if table else np.zeros((0, 0))

    @classmethod
    def begin(cls, rows: DataFrame, path: str, key: str, vector: str, cells: int | None = None, target: float = TARGET, sample_values: int = SAMPLE_VALUES) -> VectorIndex:
        """Train centroids on a sample of ``rows``, store all of them, and measure how many cells to read.

        Without ``cells`` there are as many as the square root of the rows. All
        columns are stored. An empty table has no cell and no search finds a row.
        """
        spark, n = rows.sparkSession, rows.count()
        some = rows.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.rand(1).alias("r"))
        width = (some.select(F.size("v").alias("n")).first() or {"n": 1})["n"]
        share = min(1.0, 1.1 * sample_values / max(1, n * width))
        sample = some.where(F.col("r") < share).select("v").limit(max(1, sample_values // max(1, width))).toArrow()
        units = _matrix(_plain(sample.column(0)))[0]
        units = units[~np.isnan(units).any(1)]
        wanted = cells or max(1, round(n**0.5))
        centroids = trained(units, min(wanted, MOST_CELLS)) if len(units) else np.zeros((0, width))
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

        def put(probes: int, recall: float) -> VectorIndex:
            meta = [(key, vector, rows.schema.json(), probes, recall)]
            spark.createDataFrame(meta, "key string, vector string, schema string, probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
            return cls(spark, path)

        index = put(len(centroids), 1.0)
        index.append(rows)
        return put(*index.measured(target))

    def append(self, rows: DataFrame, section_rows: int = SECTION_ROWS) -> int:
        """Add rows to the cells of the centroids there are; returns the batch's number.

        A cell's rows are dealt to tasks by sections, so a cell that holds a third
        of all rows is written by many. A batch counts once its commit is written.
        """
        spark, number = self.spark, max(versions(self.spark, f"{self.path}/commits"), default=0) + 1
        n = rows.count()
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // section_rows))
        sections = max(1, -(-n // section_rows))
        placed = self._placed(rows)
        placed = placed.repartition(tasks, "cell", F.pmod(F.xxhash64(self.key), F.lit(sections))).sortWithinPartitions("cell", self.key)
        placed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors/batch={number}")
        facts = spark.read.schema("cell int, near double").parquet(f"{self.path}/vectors/batch={number}").groupBy("cell").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n"))
        facts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number}")
        return number

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their cell, and their similarity to its centroid as ``near``."""
        shared = self.spark.sparkContext.broadcast(self.centroids)  # at most MOST_CELLS vectors
        at = rows.columns.index(self.vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units, have = _matrix(batch.column(at))
                cell, near = np.full(batch.num_rows, NOWHERE, np.int32), np.zeros(batch.num_rows)
                for some in in_blocks(len(have) if len(shared.value) else 0, len(shared.value)):
                    sims = units[some] @ shared.value.T
                    sure = ~np.isnan(sims).any(1)
                    best = np.where(sure, np.nan_to_num(sims, nan=-2.0).argmax(1), 0)
                    cell[have[some]] = np.where(sure, best, NOWHERE)
                    near[have[some]] = np.where(sure, sims[np.arange(len(best)), best], 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

        schema = rows.select("*").schema.add("cell", "integer").add("near", "double")
        return rows.mapInArrow(run, schema)

    def _commits(self) -> list[str]:
        return [f"{self.path}/commits/{n}" for n in versions(self.spark, f"{self.path}/commits")]

    def cells(self) -> dict[int, tuple[float, int]]:
        """Each cell's least similarity to its centroid, and its rows."""
        found = self._commits()
        if not found:
            return {}
        rows = self.spark.read.schema("cell int, near double, n bigint").parquet(*found).groupBy("cell").agg(F.min("near").alias("near"), F.sum("n").alias("n"))
        return {r["cell"]: (r["near"], r["n"]) for r in rows.collect()}

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The stored rows, or those of some cells: only their folders are read."""
        schema = StructType.fromJson(json.loads(self.schema)).add("cell", "integer").add("batch", "integer")
        known = versions(self.spark, f"{self.path}/commits")
        if not known:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/vectors").where(F.col("batch").isin(known))
        return (rows if cells is None else rows.where(F.col("cell").isin(cells))).drop("batch")

    def _order(self, query: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
        """The cells from the nearest centroid to the farthest, and the similarities."""
        q = np.asarray(query if query is not None else [], float)
        length = np.sqrt(q @ q)
        if not length or len(q) != self.centroids.shape[1] or not len(self.centroids):
            return np.zeros(0, np.int64), np.zeros(0)
        sims = self.centroids @ (q / length)
        order = np.argsort(-sims, kind="stable")
        return order, sims[order]

    def search(self, query: list[float] | None, k: int, probes: int | None = None, exact: bool = False, floor: float | None = None) -> DataFrame:
        """The ``k`` rows nearest to a vector, with ``sim``; ties by key.

        Reads the ``probes`` nearest cells, by default as many as were measured to
        be enough. With ``exact``, all that can hold a row as near as the last one
        found: a row's angle to the query is at least the centroid's less the
        cell's radius.
        """
        order, sims = self._order(query)
        first = order[: probes or self.probes].tolist()
        ranked = lambda cells: nearest(self.rows(cells).withColumn("sim", similarity_to(F.col(self.vector), query)), self.key, k, floor)
        if not exact:
            return ranked(first).drop("cell")
        got = [r["sim"] for r in ranked(first).select("sim").collect()]  # k rows
        least = -1.0 if len(got) < k else (got[-1] if got[-1] is not None else -1.0)
        facts = self.cells()
        angle = lambda x: np.arccos(np.clip(x, -1.0, 1.0))
        reach = [(c, np.cos(max(0.0, angle(s) - angle(facts[c][0])))) for c, s in zip(order.tolist(), sims.tolist(), strict=True) if c in facts]
        wanted = sorted({c for c, best in reach if best >= least - 10.0**-DIGITS} | set(first))
        return ranked(wanted).drop("cell")

    def search_each(self, queries: DataFrame, query_key: str, k: int, probes: int | None = None, section_rows: int = SECTION_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
        """``query_key, key, sim``: the ``k`` nearest rows of each query (column ``q``), by the cells near it.

        A query goes to its cells; there blocks of queries meet sections of the
        cell's rows, so that a task holds a bounded number of both.
        """
        wanted = probes or self.probes
        shared = self.spark.sparkContext.broadcast(self.centroids)  # at most MOST_CELLS vectors
        kinds = dict(queries.dtypes) | {self.key: dict(self.rows().dtypes)[self.key]}

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units, have = _matrix(batch.column(1))
                if len(have) and len(shared.value) and units.shape[1] == shared.value.shape[1]:
                    sure = ~np.isnan(units).any(1)
                    units, have = units[sure], have[sure]
                    # A query is a row for each of its cells, with its vector.
                    for some in in_blocks(len(units), len(shared.value) + min(wanted, len(shared.value)) * units.shape[1]):
                        best = np.argsort(-(units[some] @ shared.value.T), axis=1, kind="stable")[:, :wanted]
                        row = np.repeat(have[some], best.shape[1])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(best.ravel().astype(np.int32))], names=["id", "q", "cell"])

        asked = queries.select(F.col(query_key).alias("id"), "q").mapInArrow(near, f"id {kinds[query_key]}, q {kinds['q']}, cell int")
        facts = self.cells()
        per_cell = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each cell
        plan = [(c, -(-facts[c][1] // section_rows), -(-n // query_rows)) for c, n in per_cell.items() if c in facts]
        if not plan:
            return self.spark.createDataFrame([], f"`{query_key}` {kinds[query_key]}, `{self.key}` {kinds[self.key]}, sim double")
        blocks = F.broadcast(self.spark.createDataFrame(plan, "cell int, sections int, blocks int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = asked.join(blocks, "cell").withColumn("block", own("id", "blocks")).withColumn("section", every("sections")).select("cell", "block", "section", "id", "q")
        right = self.rows([c for c, *_ in plan]).select("cell", F.col(self.key).alias("key"), F.col(self.vector).alias("v")).join(blocks, "cell")
        right = right.withColumn("section", own("key", "sections")).withColumn("block", every("blocks")).select("cell", "block", "section", "key", "v")

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            names, (q, have) = _plain(a.column("id")), _matrix(_plain(a.column("q")))
            keys, (units, there) = _plain(b.column("key")), _matrix(_plain(b.column("v")))
            return pa.table(dict(zip((query_key, self_key, "sim"), _best(names.take(pa.array(have)), q, keys.take(pa.array(there)), units, k), strict=True)))

        self_key, keys = self.key, ("cell", "block", "section")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"`{query_key}` {kinds[query_key]}, `{self.key}` {kinds[self.key]}, sim double")
        return first_by(found, [query_key], [F.col("sim").desc(), F.col(self.key)], k)

    def measured(self, target: float = TARGET, queries: int = MEASURED, k: int = NEIGHBOURS) -> tuple[int, float]:
        """The least number of cells to read for ``target`` recall, and the recall with it.

        Stored vectors are the queries: ``queries`` of them, whose true ``k``
        neighbours are found among all rows.
        """
        rows = self.rows().where(F.col("cell") != NOWHERE)
        asked = rows.orderBy(F.xxhash64(self.key), self.key).limit(queries).select(F.col(self.key).alias("__query"), F.col(self.vector).alias("q"))
        held = {r["__query"]: r["q"] for r in asked.collect()}
        if not held:
            return len(self.centroids), 1.0
        fixed = self.spark.createDataFrame(list(held.items()), asked.schema)
        true = nearest_of_each(rows, fixed, self.key, "__query", k, self.vector)
        cells = rows.select(F.col(self.key).alias("__k"), "cell")
        found = true.join(cells, F.col(self.key) == F.col("__k")).select("__query", "cell").collect()  # k rows for each of a fixed number of queries
        place = {q: {c: n for n, c in enumerate(self._order(v)[0].tolist())} for q, v in held.items()}
        ranks = np.sort([place[r["__query"]][r["cell"]] + 1 for r in found])
        probes = int(ranks[max(0, int(np.ceil(target * len(ranks))) - 1)])
        return probes, float((ranks <= probes).mean())
