"""The stored index of vectors against exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import search
from siltstone.operators.vector_index import NOWHERE, VectorIndex, trained
from siltstone.plans import catalog
from siltstone.sources.shared import Workspace

SCHEMA = "id long, v array<float>, kind string"


def clustered(n, seed, width=16, centres=12):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(centres, width))
    return middle[rnd.integers(0, centres, n)] + 0.35 * rnd.normal(size=(n, width))


@pytest.fixture(scope="module")
def vectors():
    return clustered(1500, 1)


@pytest.fixture(scope="module")
def rows(spark, vectors):
    out = [(k, v.tolist(), f"k{k % 3}") for k, v in enumerate(vectors)]
    out += [(5000 + k, vectors[7].tolist(), "copy") for k in range(700)]  # one vector in a third of all rows
    out += [(9000, None, "none"), (9001, [0.0] * 16, "nought")]
    return spark.createDataFrame(out, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, rows):
    return VectorIndex.begin(rows, Workspace(spark, "vectors").root, "id", "v", cells=40)


def exact(rows, query, k):
    return [(r["id"], r["sim"]) for r in search.nearest(rows.withColumn("sim", search.similarity_to(F.col("v"), query)), "id", k).where("sim IS NOT NULL").collect()]


def test_exact_searches_equal_a_scan(index, rows, vectors):
    for n in (0, 7, 33):
        found = index.search(vectors[n].tolist(), 25, exact=True)
        assert [(r["id"], r["sim"]) for r in found.collect()] == exact(rows, vectors[n].tolist(), 25)
    away = (-vectors[0]).tolist()
    assert [(r["id"], r["sim"]) for r in index.search(away, 5, probes=1, exact=True).collect()] == exact(rows, away, 5)


def test_searches_read_few_cells(index, vectors):
    assert index.recall >= 0.97 and index.probes < 20
    plan = index.search(vectors[0].tolist(), 5, probes=2)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ IN \(\d+,\d+\)", plan)
    near = index.search(vectors[0].tolist(), 20, exact=True)._jdf.queryExecution().toString()
    read = re.search(r"PartitionFilters: \[[^]]*cell#\d+ IN \(([\d,]+)\)", near)
    assert read and len(read[1].split(",")) < 40


def test_recall_of_many_queries(spark, index, rows, vectors):
    asked = spark.createDataFrame([(k, vectors[k].tolist()) for k in range(0, 1500, 50)] + [(-1, None), (-2, [0.0] * 16)], "qid long, q array<float>")
    true = {(r["qid"], r["id"]) for r in search.nearest_of_each(rows, asked, "id", "qid", 20, "v").collect()}
    for sizes in ({}, {"section_rows": 30, "query_rows": 4}):
        found = {(r["qid"], r["id"]): r["sim"] for r in index.search_each(asked, "qid", 20, **sizes).collect()}
        assert len(true & set(found)) / len(true) >= 0.95
    every = {(r["qid"], r["id"]) for r in index.search_each(asked, "qid", 20, probes=40).collect()}
    assert every == true


def test_blocks_of_queries_equal_a_broadcast(spark, rows, vectors):
    asked = spark.createDataFrame([(k, vectors[k].tolist()) for k in range(40)] + [(99, None)], "qid long, q array<float>")
    some = [sorted(map(tuple, search.nearest_of_each(rows, asked, "id", "qid", 7, "v", **sizes).select("qid", "id", "sim").collect())) for sizes in ({}, {"query_bytes": 0, "block_queries": 9, "block_rows": 200})]
    assert some[0] == some[1] and len(some[0]) == 280


def test_batches_and_odd_vectors(spark, index, rows, vectors):
    begun = VectorIndex.begin(rows.where("id < 700"), Workspace(spark, "vectors").root, "id", "v", cells=10)
    assert begun.append(rows.where("id >= 700"), section_rows=100) == 2
    again = VectorIndex(spark, begun.path)
    assert again.rows().count() == rows.count() and again.rows([NOWHERE]).count() == 2
    assert [(r["id"], r["sim"]) for r in again.search(vectors[1200].tolist(), 10, exact=True).collect()] == exact(rows, vectors[1200].tolist(), 10)
    for query in (None, [], [0.0] * 16, [1.0, 2.0]):
        assert again.search(query, 5).count() == 0 and again.search(query, 5, exact=True).count() == 0
    empty = VectorIndex.begin(rows.limit(0), Workspace(spark, "vectors").root, "id", "v")
    assert empty.search(vectors[0].tolist(), 5).count() == 0
    none = VectorIndex.begin(rows.where("id >= 9000"), Workspace(spark, "vectors").root, "id", "v")
    assert none.rows().count() == 2 and none.search(vectors[0].tolist(), 5, exact=True).count() == 0


def test_centroids_of_few_vectors():
    units = np.eye(3)
    assert len(trained(np.repeat(units, 5, axis=0), 10)) == 3


def test_queries_reach_their_recall(spark, data):
    found = catalog.QUERIES["index_recall"](spark, data).collect()
    assert sum(r["found"] for r in found) / sum(r["neighbours"] for r in found) >= 0.95
    near = [r["vec_id"] for r in catalog.QUERIES["knn_index"](spark, data).collect()]
    true = [r["vec_id"] for r in catalog.QUERIES["knn_topk"](spark, data).collect()]
    assert len(set(near) & set(true)) >= 17 and near[0] == true[0]


def test_memory_of_products_is_bounded():
    """Many queries against many rows: what is held doesn't follow their product, and ties go by key."""
    import tracemalloc

    import pyarrow as pa

    from siltstone.operators.search import _best

    rnd = np.random.default_rng(3)
    units, q = rnd.integers(-2, 3, (6000, 4)).astype(float), rnd.integers(-2, 3, (3000, 4)).astype(float)
    units[7] = np.nan
    keys = rnd.permutation(6000)
    tracemalloc.start()
    names, found, sims = _best(pa.array(np.arange(3000)), q, pa.array(keys), units, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all products at once are 144 MB, and were sorted besides
    assert names.to_pylist() == np.repeat(np.arange(3000), 5).tolist()
    for k in range(0, 3000, 500):
        want = sorted((-s, key) for s, key in zip((units @ q[k]).tolist(), keys.tolist(), strict=True) if s == s)[:5]
        assert list(zip((-np.array(sims[5 * k : 5 * k + 5])).tolist(), found[5 * k : 5 * k + 5].to_pylist(), strict=True)) == want
