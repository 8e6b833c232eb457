"""Unions and repairs against the area of a raster."""

import random

import numpy as np
import pytest

from siltstone.operators import overlay


def inside(points, ring):
    a, b = np.asarray(ring, float)[:-1], np.asarray(ring, float)[1:]
    count = np.zeros(len(points), int)
    wind = np.zeros(len(points), int)
    for (ax, ay), (bx, by) in zip(a, b, strict=True):
        if ay == by:
            continue
        spans = (points[:, 1] >= min(ay, by)) & (points[:, 1] < max(ay, by))
        x = ax + (points[:, 1] - ay) * (bx - ax) / (by - ay)
        hit = spans & (x > points[:, 0])
        count += hit
        wind += np.where(hit, 1 if by > ay else -1, 0)
    return count, wind


GRID = np.stack(np.meshgrid(np.arange(-0.5, 12.5, 0.05) + 0.0123, np.arange(-0.5, 12.5, 0.05) + 0.0171), -1).reshape(-1, 2)


def covered(polygons):
    """Which points any polygon covers, holes taken off."""
    out = np.zeros(len(GRID), bool)
    for p in polygons:
        one = inside(GRID, p[0])[0] % 2 == 1
        for hole in p[1:]:
            one &= inside(GRID, hole)[0] % 2 == 0
        out |= one
    return out


def odd(polygon):
    return sum(inside(GRID, r)[0] for r in polygon) % 2 == 1


def area(polygons):
    total = 0.0
    for p in polygons:
        for ring in p:
            r = np.asarray(ring)
            total += float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2
    return total


def box(x, y, w=1.0, h=1.0, turned=False):
    ring = [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    return [np.array(ring[::-1] if turned else ring, float)]


def valid(polygons):
    """No ring of the result crosses or repeats a side, and outlines run against the clock."""
    sides = overlay._sides(polygons, turned=False)
    assert len(overlay._split(sides)) == len(sides)
    assert len(np.unique(np.vstack([sides, sides[:, [2, 3, 0, 1]]]), axis=0)) == 2 * len(sides)
    for p in polygons:
        assert area([p[:1]]) > 0 and all(area([[h]]) < 0 for h in p[1:])


CASES = {
    "disjoint": ([box(0, 0), box(3, 3)], 2.0, 2),
    "nested": ([box(0, 0, 4, 4), box(1, 1)], 16.0, 1),
    "overlapping": ([box(0, 0, 2, 2), box(1, 1, 2, 2, True)], 7.0, 1),
    "equal": ([box(0, 0, 2, 2), box(0, 0, 2, 2, True)], 4.0, 1),
    "a common side": ([box(0, 0), box(1, 0)], 2.0, 1),
    "T-junction": ([box(0, 0, 2, 1), box(0, 1), box(1, 1)], 4.0, 1),
    "part of a side": ([box(0, 0, 1, 3), box(1, 1, 1, 1)], 4.0, 1),
    "a common point": ([box(0, 0), box(1, 1)], 2.0, 2),
    "around a hole": ([box(0, 0, 3, 1), box(0, 2, 3, 1), box(0, 0, 1, 3), box(2, 0, 1, 3)], 8.0, 1),
    "in a hole": ([[*box(0, 0, 5, 5), *box(1, 1, 3, 3)], box(2, 2)], 17.0, 2),
    "over a hole": ([[*box(0, 0, 5, 5), *box(1, 1, 3, 3)], box(0, 2, 5, 1)], 19.0, 1),
    "crossing": ([box(0, 1, 3, 1), box(1, 0, 1, 3)], 5.0, 1),
    "nothing": ([], 0.0, 0),
    "flat": ([[np.array([[0, 0], [1, 1], [2, 2], [0, 0]], float)], box(5, 5)], 1.0, 1),
}


@pytest.mark.parametrize("name", CASES)
def test_unions(name):
    polygons, size, n = CASES[name]
    found = overlay.union(polygons)
    assert len(found) == n and abs(area(found) - size) < 1e-6 and (covered(found) == covered(polygons)).all()
    valid(found)


@pytest.mark.parametrize("seed", range(25))
def test_unions_of_random_polygons(seed):
    rnd = random.Random(seed)
    polygons = []
    for _ in range(rnd.randint(2, 12)):
        cx, cy, n = rnd.uniform(2, 9), rnd.uniform(2, 9), rnd.randint(3, 9)
        angles = sorted(rnd.uniform(0, 2 * np.pi) for _ in range(n))
        ring = [[cx + rnd.uniform(0.5, 2) * np.cos(t), cy + rnd.uniform(0.5, 2) * np.sin(t)] for t in angles]
        if seed % 3 == 0:
            ring = [[round(x), round(y)] for x, y in ring]  # many sides on one line and common points
        ring.append(ring[0])
        polygons += overlay.repaired([np.array(ring, float)])
    found = overlay.union(polygons)
    assert (covered(found) == covered(polygons)).mean() > 0.9999
    valid(found)
    halves = overlay.union([*overlay.union(polygons[::2]), *overlay.union(polygons[1::2])])
    assert abs(area(halves) - area(found)) < 1e-5  # in two steps as in one


BROKEN = {
    "bow-tie": ([[[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]]], 8.0, 2),
    "repeated point": ([[[0, 0], [2, 0], [2, 0], [2, 2], [0, 2], [0, 0]]], 4.0, 1),
    "spike": ([[[0, 0], [2, 0], [2, 1], [5, 1], [2, 1], [2, 2], [0, 2], [0, 0]]], 4.0, 1),
    "hole outside": ([[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], [[4, 4], [5, 4], [5, 5], [4, 5], [4, 4]]], 5.0, 2),
    "hole across": ([[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], [[1, 0.5], [3, 0.5], [3, 1.5], [1, 1.5], [1, 0.5]]], 4.0, 2),
    "open ring": ([[[0, 0], [2, 0], [2, 2], [0, 2]]], 4.0, 1),
    "line": ([[[0, 0], [1, 1], [0, 0]]], 0.0, 0),
    "twice around": ([[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]], 0.0, 0),
    "touching itself": ([[[0, 0], [2, 2], [4, 0], [4, 4], [2, 2], [0, 4], [0, 0]]], 8.0, 2),
}


@pytest.mark.parametrize("name", BROKEN)
def test_repairs(name):
    rings, size, n = BROKEN[name]
    polygon = [np.array(r, float) for r in rings]
    found = overlay.repaired(polygon)
    assert len(found) == n and abs(area(found) - size) < 1e-6
    closed = [np.vstack([r, r[:1]]) if (r[0] != r[-1]).any() else r for r in polygon]
    assert (covered(found) == odd(closed)).all()
    valid(found)


@pytest.mark.parametrize("seed", range(20))
def test_repairs_of_random_rings(seed):
    rnd = random.Random(seed)
    ring = [[rnd.uniform(0, 11), rnd.uniform(0, 11)] if seed % 2 else [rnd.randint(0, 6), rnd.randint(0, 6)] for _ in range(rnd.randint(4, 14))]
    ring = [np.array([*ring, ring[0]], float)]
    found = overlay.repaired(ring)
    assert (covered(found) == odd(ring)).mean() > 0.9999
    valid(found)
