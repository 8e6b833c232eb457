"""Outlines put together: each geometry parsed once, in blocks of near ones."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import geo, overlay
from siltstone.plans import catalog


def box(x, y, w, h, *more):
    return json.dumps({"type": "Polygon", "coordinates": [[[x, y, *more], [x + w, y, *more], [x + w, y + h, *more], [x, y + h, *more], [x, y, *more]]]})


def test_python_runs_on_distinct_geometries_once(spark, data):
    """A filter on what Python found was pushed below the distinct, so Python ran over all rows first, and then once for each join."""
    plan = catalog.QUERIES["overlapping_outlines"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 0 and plan.count("FlatMapGroupsInPandas") == 2


def ring(*points):
    return [np.array([*points, points[0]], float)]


def test_convex_rings_are_as_repaired():
    rnd = random.Random(5)
    rings = []
    for _ in range(200):
        angles = sorted(rnd.uniform(0, 2 * np.pi) for _ in range(rnd.randint(3, 9)))
        found = ring(*[[5 + 3 * np.cos(t), 5 + 2 * np.sin(t)] for t in angles])
        rings.append([found[0][::-1]] if rnd.random() < 0.5 else found)
    sound = overlay.convex(rings)
    assert sound.sum() > 150
    for p, one in zip(rings, sound, strict=True):
        if one:
            (a,), (b,) = overlay.union([p]), overlay.repaired(p)
            assert len(a) == len(b) == 1 and (a[0] == b[0]).all()


square = [[0, 0], [2, 0], [2, 2], [0, 2]]
NOT_CONVEX = {
    "star": ring(*[[np.cos(2 * np.pi * k * 2 / 5), np.sin(2 * np.pi * k * 2 / 5)] for k in range(5)]),
    "twice around": ring(*square, *square),
    "bow-tie": ring([0, 0], [2, 2], [2, 0], [0, 2]),
    "spike": ring([0, 0], [2, 0], [3, 0], [2, 0], [2, 2], [0, 2]),
    "repeated point": ring([0, 0], [2, 0], [2, 0], [2, 2]),
    "open": [np.array(square, float)],
    "sliver": ring([0, 0], [2, 0], [1, 2e-7]),
    "a point on a side": ring([0, 0], [1, 0], [2, 0], [2, 2]),
    "notch": ring([0, 0], [2, 0], [1, 1], [2, 2], [0, 2]),
    "hole": [ring(*square)[0], ring([0.5, 0.5], [1, 0.5], [1, 1])[0]],
    "line": ring([0, 0], [1, 1]),
}


@pytest.mark.parametrize("name", NOT_CONVEX)
def test_other_rings_are_not_taken_for_convex(name):
    assert overlay.convex([ring(*square), NOT_CONVEX[name], []]).tolist() == [True, False, False]


@pytest.mark.parametrize("block", [20_000, 40])
@pytest.mark.parametrize("flat", ["x", "y", "neither"])
def test_rows_of_boxes_and_odd_rows(spark, block, flat):
    """All in a row along one axis, by one key or none, with rows that hold no polygon and rings that aren't valid."""
    rnd = random.Random(block)
    spots = [(0 if flat == "x" else rnd.randint(0, 60), 0 if flat == "y" else rnd.randint(0, 60), rnd.randint(1, 4), rnd.randint(1, 4)) for _ in range(150)]
    covered = lambda some: len({(x + i, y + j) for x, y, w, h in some for i in range(w) for j in range(h)})
    tie = json.dumps({"type": "Polygon", "coordinates": [[[100, 0], [104, 4], [104, 0], [100, 4], [100, 0]]]})
    odd = [None, "", '{"type":"Point","coordinates":[1,2]}', '{"type":"LineString","coordinates":[[1,2],[3,4]]}', '{"type":"Polygon","coordinates":[]}', "{}"]
    rows = [(k % 2, box(*s, *([7.0] if k % 3 == 0 else []))) for k, s in enumerate(spots)] + [(0, tie), (0, tie)] + [(k, g) for k in (0, 5, None) for g in odd] + [(None, box(0, 0, 1, 1))]
    frame = spark.createDataFrame(rows, "n int, g string")
    area = F.round(geo.planar_area("outline"), 6).alias("a")
    found = {r["n"]: r["a"] for r in geo.dissolved(frame, ["n"], "g", block_points=block).select("n", area).collect()}
    assert found == {0: covered(spots[::2]) + 8, 1: covered(spots[1::2]), None: 1}
    assert [r["a"] for r in geo.dissolved(frame, [], "g", block_points=block).select(area).collect()] == [covered([*spots, (0, 0, 1, 1)]) + 8]


@pytest.mark.parametrize("seed", range(12))
def test_groups_united_together_are_as_one_by_one(seed):
    rnd = random.Random(seed)
    groups = []
    for _ in range(rnd.randint(1, 7)):
        polygons = []
        for _ in range(rnd.randint(0, 8)):
            cx, cy = rnd.uniform(-180, 180) if seed % 2 else rnd.randint(0, 5), rnd.randint(0, 5)
            angles = sorted(rnd.uniform(0, 2 * np.pi) for _ in range(rnd.randint(3, 7)))
            points = [[cx + rnd.uniform(1, 3) * np.cos(t), cy + rnd.uniform(1, 3) * np.sin(t)] for t in angles]
            polygons += overlay.repaired(ring(*[[round(x), round(y)] for x, y in points] if seed % 3 == 0 else points))
        groups.append(polygons)
    alone = [overlay.union(g) for g in groups]
    together = overlay.unions([[], *groups, []])
    assert together[0] == together[-1] == [] and [len(u) for u in together[1:-1]] == [len(u) for u in alone]
    for one, two in zip(alone, together[1:-1], strict=True):
        assert all(len(p) == len(q) and all((a == b).all() for a, b in zip(p, q, strict=True)) for p, q in zip(one, two, strict=True))


def test_small_blocks_of_a_row_are_united_to_one(spark):
    rows = spark.createDataFrame([(0, box(2 * k, 0, 3, 2)) for k in range(1000)], "k int, g string")
    for block in (50, geo.BUNDLE_POINTS, 20_000):
        (one,) = geo.dissolved(rows, ["k"], "g", block_points=block).collect()
        assert json.loads(one["outline"])["coordinates"][0][0][0] == [0.0, 0.0] and one["outline"].count("[[[[") == 1 == one["outline"].count("]]]")
        assert spark.createDataFrame([one]).select(geo.planar_area("outline")).first()[0] == 4002.0
