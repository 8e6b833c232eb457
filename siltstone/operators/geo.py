"""Boundaries as GeoJSON polygons: area, centre, bounds, simplified outlines, feature output."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import overlay

EARTH_RADIUS_KM = 6371.0088


def _polygons(geometry: str | None) -> list[list[np.ndarray]]:
    """Polygons as lists of rings; the first ring is the outline, the others are holes."""
    g = json.loads(geometry) if geometry else {}
    coordinates = g.get("coordinates") or []
    many = coordinates if g.get("type") == "MultiPolygon" else [coordinates] if g.get("type") == "Polygon" else []
    return [[np.asarray(ring, float)[:, :2] for ring in polygon] for polygon in many if polygon]


def _ring_area(ring: np.ndarray) -> float:
    """Square kilometres on the sphere (sign by direction)."""
    lon, lat = np.radians(ring[:, 0]), np.radians(ring[:, 1])
    return float(np.sum((np.roll(lon, -1) - lon) * (2 + np.sin(lat) + np.sin(np.roll(lat, -1)))) * EARTH_RADIUS_KM**2 / 2)


def _facts(geometry: str | None) -> tuple:
    polygons = _polygons(geometry)
    if not polygons:
        return (None,) * 7
    area = sum(abs(_ring_area(p[0])) - sum(abs(_ring_area(h)) for h in p[1:]) for p in polygons)
    weight = x = y = 0.0
    for polygon in polygons:
        for k, ring in enumerate(polygon):
            nxt = np.roll(ring, -1, 0)
            cross = ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]
            sign = np.sign(cross.sum()) * (1 if k == 0 else -1)
            weight += sign * cross.sum() / 2
            x += sign * float(((ring[:, 0] + nxt[:, 0]) * cross).sum()) / 6
            y += sign * float(((ring[:, 1] + nxt[:, 1]) * cross).sum()) / 6
    every = np.concatenate([r for p in polygons for r in p])
    middle = (x / weight, y / weight) if weight else tuple(every.mean(0))
    return (area, *map(float, middle), *map(float, every.min(0)), *map(float, every.max(0)))


def with_facts(rows: DataFrame, geometry: str) -> DataFrame:
    """Add ``geo``: area_km2, centre lng and lat, and the bounds; null for what is no polygon."""
    names = ["area_km2", "lng", "lat", "min_lng", "min_lat", "max_lng", "max_lat"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def facts(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_facts(x) for x in g], columns=names)

    return rows.withColumn("geo", facts(F.col(geometry)))


def on_earth(geo: Column) -> Column:
    """The guard against projected coordinates: degrees only."""
    return geo["min_lng"].between(-180, 180) & geo["max_lng"].between(-180, 180) & geo["min_lat"].between(-90, 90) & geo["max_lat"].between(-90, 90)


def _simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Points farther than ``tolerance`` from the chords between the kept ones stay."""
    keep = np.zeros(len(ring), bool)
    keep[[0, -1]] = True
    todo = [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, off = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = float(np.hypot(*chord))
        far = np.abs(chord[0] * off[:, 1] - chord[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep]


def _crosses_itself(ring: np.ndarray) -> bool:
    """Whether two sides of a closed ring that aren't neighbours touch."""
    a, b = ring[:-1], ring[1:]
    n = len(a)
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    for k in range(n - 2):  # each side against all later ones but its neighbours
        other = np.arange(k + 2, n - (k == 0))
        c, d = a[other], b[other]
        if np.any((side(a[k], b[k], c) * side(a[k], b[k], d) <= 0) & (side(c, d, a[k]) * side(c, d, b[k]) <= 0)):
            return True
    return False


def _valid_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The ring with fewer points, with as many as it takes not to cross itself."""
    for _ in range(8):
        fewer = _simplify(ring, tolerance)
        if len(fewer) < 4 or not _crosses_itself(fewer):
            return fewer
        tolerance /= 2
    return ring


def _as_json(polygons: list[list[np.ndarray]]) -> str | None:
    return json.dumps({"type": "MultiPolygon", "coordinates": [[r.tolist() for r in p] for p in polygons]}) if polygons else None


def _whole(geometry: str | None) -> list[list[np.ndarray]]:
    """The polygons of a geometry, made valid one by one."""
    return [v for p in _polygons(geometry) for v in overlay.repaired(p)]


def repaired(rows: DataFrame, geometry: str, to: str = "valid") -> DataFrame:
    """Add ``to``, the polygons of a geometry made valid, as a MultiPolygon.

    What an odd number of a polygon's rings is around is inside: rings that cross
    themselves become several, spikes and repeated points go, a hole that lies
    outside is a polygon. Lines and points of a geometry go; what holds no area, or
    is no polygon, has a null.
    """

    @F.pandas_udf("string")
    def valid(g: pd.Series) -> pd.Series:
        return g.map({x: _as_json(_whole(x)) for x in g.dropna().unique()}).astype(object).where(g.notna(), None)  # equal texts once

    return rows.withColumn(to, valid(F.col(geometry)))


def simplified(rows: DataFrame, geometry: str, tolerance: float = 0.005) -> DataFrame:
    """Add ``simple``, a valid MultiPolygon with fewer points; rings that collapse go.

    Invalid polygons are repaired first. A ring that would cross itself keeps more
    of its points; where rings come to cross each other they are repaired again.
    What is no polygon has a null. Borders that rows share are simplified for each
    row by itself; ``simplified_together`` keeps them common.
    """

    @F.pandas_udf("string")
    def simple(g: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            rings = [[r for r in (_valid_ring(ring, tolerance) for ring in p) if len(r) >= 4] for p in _whole(x)]
            return _as_json([v for p in rings if p for v in overlay.repaired(p)])

        return g.map(one)

    return rows.withColumn("simple", simple(F.col(geometry)))


def simplified_together(rows: DataFrame, key: str, geometry: str, tolerance: float = 0.005) -> DataFrame:
    """``key, simple``: polygons with fewer points, whose common borders stay common.

    Points at which borders of three part, found over all rows, stay. The chains
    between them are simplified one by one, each in the same direction wherever it
    occurs, so that neighbours with the same points there still touch. ``key`` tells
    rows apart; those without a polygon have no row. Polygons are repaired before
    and after; after that one may touch its neighbour in other points only where
    simplification made it cross itself.
    """
    valid = repaired(rows.select(F.col(key).alias("k"), F.col(geometry).alias("g")), "g", "valid").where("valid IS NOT NULL")
    point = F.struct(F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    ring = valid.select("k", F.posexplode(_coordinates("valid")).alias("poly", "rings")).select("k", "poly", F.posexplode("rings").alias("nth", "ring"))
    nodes = ring.select("k", "poly", "nth", F.size("ring").alias("n"), "ring", F.posexplode(F.slice("ring", 1, F.size("ring") - 1)).alias("at", "p"))
    nxt = F.element_at("ring", F.col("at") + 2)
    nodes = nodes.select("k", "poly", "nth", "at", point.alias("v"), F.struct(nxt[0].alias("x"), nxt[1].alias("y")).alias("w"))
    ways = nodes.select("v", "w").unionByName(nodes.select(F.col("w").alias("v"), F.col("v").alias("w"))).groupBy("v").agg(F.size(F.collect_set("w")).alias("n"))
    fixed = ways.where("n <> 2").select(F.col("v").alias("u"))
    flagged = nodes.join(fixed, F.col("v") == F.col("u"), "left").select("k", "poly", "nth", "at", "v", F.col("u").isNotNull().alias("node"))
    kinds = dict(rows.dtypes)

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        polygons: dict[int, dict[int, np.ndarray]] = {}
        for (poly, nth), part in group.sort_values("at").groupby(["poly", "nth"]):
            points = np.array([[v["x"], v["y"]] for v in part["v"]])
            chained = _chains(points, part["node"].to_numpy(bool), tolerance)
            if len(chained) >= 4:
                polygons.setdefault(poly, {})[nth] = chained
        valid = [v for poly in sorted(polygons) for v in overlay.repaired([polygons[poly][n] for n in sorted(polygons[poly])])]
        return group[["k"]].head(1).reset_index(drop=True).assign(simple=_as_json(valid))

    return flagged.groupBy("k").applyInPandas(put_together, f"k {kinds[key]}, simple string").withColumnRenamed("k", key)


def _chains(points: np.ndarray, node: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring with its chains between nodes simplified, each from its lesser end; one without a node begins at its least point."""
    first = int(np.flatnonzero(node)[0]) if node.any() else min(range(len(points)), key=lambda k: tuple(points[k]))
    points, node = np.roll(points, -first, 0), np.roll(node, -first)
    ends = [*np.flatnonzero(node).tolist(), len(points)] if node.any() else [0, len(points)]
    closed, out = np.vstack([points, points[:1]]), []
    for a, b in zip(ends, ends[1:], strict=False):
        chain = closed[a : b + 1]
        turned = tuple(map(tuple, chain)) > tuple(map(tuple, chain[::-1]))
        kept = _simplify(chain[::-1] if turned else chain, tolerance)
        out.append((kept[::-1] if turned else kept)[:-1])
    ring = np.concatenate(out)
    return np.vstack([ring, ring[:1]])


def collected(rows: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """Each group's polygons as one MultiPolygon. Polygons are expected not to overlap; borders stay."""
    out = rows.groupBy(*keys).agg(F.flatten(F.collect_list(_coordinates(geometry))).alias("c"))
    return out.select(*keys, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("c").alias("coordinates"))).alias("outline"))


def _coordinates(geometry: str) -> Column:
    """A polygon or several as lists of rings."""
    many = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<array<double>>>>")
    single = F.array(F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<double>>>"))
    return F.when(F.get_json_object(geometry, "$.type") == "MultiPolygon", many).otherwise(single)


#: A block of polygons has about so many points; small blocks are Python's together, up to so many.
BLOCK_POINTS, BUNDLE_POINTS = 20_000, 2000


def _places(rows: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """``keys, geometry``, how many points it has, and the middle ``x, y`` of its bounds, without Python; these only say where it is worked on."""
    axis = lambda n: F.transform("__p", lambda q: F.get(q, F.lit(n)))
    every = F.flatten(F.flatten(_coordinates(geometry)))
    put = rows.select(*keys, geometry, every.alias("__p"))
    put = put.select(*keys, geometry, F.greatest(F.size("__p"), F.lit(1)).alias("points"), axis(0).alias("__x"), axis(1).alias("__y"))
    return put.select(*keys, geometry, "points", *[((F.array_min(f"__{c}") + F.array_max(f"__{c}")) / 2).alias(c) for c in "xy"])


def dissolved(rows: DataFrame, keys: list[str], geometry: str, block_points: int = BLOCK_POINTS) -> DataFrame:
    """The area that each group's polygons cover together: ``keys, outline``, a MultiPolygon.

    Overlaps, nested polygons and borders go, whatever points they have on each
    side. Polygons are put together in two steps: first those of one block, near to
    each other and of about ``block_points`` points, then the blocks' outlines; so
    no task holds a group's polygons. Invalid polygons are repaired first. A group
    without a polygon has no row.
    """
    kinds = dict(rows.dtypes)
    # Equal geometries of a group cover nothing more: they are parsed and laid over others once.
    each = _places(rows.select(*keys, F.col(geometry).alias("__g")).distinct(), keys, "__g")
    ends = each.groupBy(*keys).agg(F.ceil(F.sum("points") / block_points).alias("wanted"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])
    # About as many cells as blocks, and as wide as high where the group's bounds allow it.
    n, wide, high = F.col("wanted"), F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")
    ends = ends.withColumn("side_x", F.when(high > 0, F.greatest(F.lit(1), F.least(n, F.ceil(F.sqrt(n * wide / high))))).otherwise(n)).withColumn("side_y", F.ceil(n / F.col("side_x")))
    ends = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in ends.columns if c not in (*keys, "wanted")])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    placed = each.join(ends, reduce(lambda a, b: a & b, same)) if keys else each.crossJoin(ends)
    cell = lambda c: F.coalesce(F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1e-12)) * F.col(f"side_{c}")), F.col(f"side_{c}") - 1), F.lit(0))
    placed = placed.withColumn("cell", (cell("y") * F.col("side_x") + cell("x")).cast("long"))
    full = placed.groupBy(*keys, "cell").agg(F.greatest(F.lit(1), F.round(F.sum("points") / block_points)).cast("long").alias("parts"))
    full = full.select(*[F.col(k).alias(f"___{k}") for k in keys], F.col("cell").alias("c"), "parts")
    near = [F.col(k).eqNullSafe(F.col(f"___{k}")) for k in keys]
    placed = placed.join(full, reduce(lambda a, b: a & b, [*near, F.col("cell") == F.col("c")]))
    bundle = F.floor(F.col("cell") / max(1, BUNDLE_POINTS // block_points))  # some cells next to each other
    placed = placed.select(*keys, bundle.alias("bundle"), F.pmod(F.xxhash64("__g"), F.col("parts")).alias("part"), "cell", "__g")

    def outlined(group: pd.DataFrame, outlines: list[str | None]) -> pd.DataFrame:
        return group[keys].head(len(outlines)).reset_index(drop=True).assign(outline=outlines)

    def blocks(group: pd.DataFrame) -> pd.DataFrame:
        valid = []
        for _, some in group["__g"].groupby(group["cell"]):
            found = [p for g in some for p in _polygons(g)]
            valid.append([v for p, sound in zip(found, overlay.convex(found), strict=True) for v in ([p] if sound else overlay.repaired(p))])
        return outlined(group, [_as_json(u) for u in overlay.unions(valid)])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        some = group["outline"].tolist()
        return outlined(group, [some[0] if len(some) == 1 else _as_json(overlay.union([p for g in some for p in _polygons(g)]))])

    # Few bytes are much work here, so the number of tasks is given, not left to their size.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "outline string"])
    each = placed.repartition(parts, *keys, "bundle", "part").groupBy(*keys, "bundle", "part").applyInPandas(blocks, schema).where("outline IS NOT NULL")
    each = each.repartition(parts, *keys) if keys else each
    return each.groupBy(*keys).applyInPandas(together, schema)


def planar_area(geometry: str) -> Column:
    """The area of valid polygons in the plane of their coordinates; outlines run against the clock, holes with it."""
    ring = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, k: s + F.get(F.get(r, k - 1), F.lit(0)) * F.get(F.get(r, k), F.lit(1)) - F.get(F.get(r, k), F.lit(0)) * F.get(F.get(r, k - 1), F.lit(1)))
    return F.aggregate(F.flatten(_coordinates(geometry)), F.lit(0.0), lambda s, r: s + ring(r)) / 2


def features(rows: DataFrame, lng: str, lat: str, properties: list[str]) -> DataFrame:
    """A GeoJSON point feature for each row that has a place."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))
    return rows.where(F.col(lng).isNotNull() & F.col(lat).isNotNull()).select(feature.alias("feature"))
