"""Pairs of keys, and outlines that are there more than once."""

import json

from pyspark.sql import functions as F

from siltstone.operators import geo, overlay, resolve
from siltstone.plans import catalog


def test_pairs_are_made_once(spark):
    rows = [(1, "x"), (2, "x"), (3, "x"), (1, "y"), (2, "y"), (4, "y"), (4, "y"), (5, None), (6, None), (None, "x")]
    found = resolve.pairs_within(spark.createDataFrame(rows, "k int, g string"), ["g"], "k", "a", "b").collect()
    assert sorted(map(tuple, found)) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]


def test_all_pairs_are_not_put_together(spark, data):
    """Both orders of each pair were joined, and all of them held to be told apart: keys are told apart first."""
    plan = catalog.QUERIES["unordered_pairs"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "(a#" in plan and " < b#" in plan


def test_equal_outlines_are_worked_on_once(spark, monkeypatch):
    box = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]})
    rows = spark.createDataFrame([(k % 2, box) for k in range(50)] + [(0, None)], "k int, g string").coalesce(1)
    assert [r["n"] for r in geo.repaired(rows, "g").groupBy("valid").agg(F.count(F.lit(1)).alias("n")).orderBy("n").collect()] == [1, 50]
    out = geo.dissolved(rows, ["k"], "g").select("k", F.round(geo.planar_area("outline"), 6).alias("a")).collect()
    assert sorted(map(tuple, out)) == [(0, 1.0), (1, 1.0)]
    assert "Aggregate [k#" in geo.dissolved(rows, ["k"], "g")._jdf.queryExecution().optimizedPlan().toString()
    import pandas as pd

    calls = []
    monkeypatch.setattr(overlay, "repaired", lambda p, f=overlay.repaired: calls.append(1) or f(p))
    monkeypatch.setattr(geo.F, "pandas_udf", lambda kind: lambda f: lambda column: calls.append(f(pd.Series([box] * 9 + [None])).tolist()) or F.lit(""))
    geo.repaired(rows, "g")
    assert len(calls) == 2 and calls[1][9] is None
