"""Polygons laid over each other: unions, and rings made valid.

All sides are split where they cross or touch, and equal pieces are added up by
direction. A piece of side stays where one side of it is inside and the other is
not: by the winding number for a union, by even and odd for a ring that crosses
itself. The pieces that stay, each with the inside on its left, are linked to
rings. Coordinates are rounded to a grid, so that points which are meant to be the
same are.
"""

from __future__ import annotations

import numpy as np

#: Coordinates are whole multiples of this: in degrees, about a centimetre.
GRID = 1e-7
#: Pieces are held against each other in blocks of about so many pairs.
PAIRS = 1 << 21

Ring = np.ndarray
Polygon = list[Ring]


def _snapped(points: np.ndarray) -> np.ndarray:
    return np.round(points / GRID).astype(np.int64)


def _sides(polygons: list[Polygon], turned: bool) -> np.ndarray:
    """Directed sides ``ax, ay, bx, by``; with ``turned`` outlines run against the clock and holes with it."""
    rings = [(np.asarray(ring, float), k == 0) for polygon in polygons for k, ring in enumerate(polygon) if len(ring)]
    if not rings:
        return np.zeros((0, 4), np.int64)
    a = _snapped(np.concatenate([ring for ring, _ in rings]))
    sizes = np.array([len(ring) for ring, _ in rings])
    start = np.cumsum(sizes) - sizes
    following = np.arange(1, len(a) + 1)
    following[start + sizes - 1] = start  # of a closed ring this side has no length
    b = a[following]
    if turned:
        origin = np.repeat(a[start], sizes, axis=0)
        fa, fb = (a - origin).astype(float), (b - origin).astype(float)
        area = np.add.reduceat(fa[:, 0] * fb[:, 1] - fb[:, 0] * fa[:, 1], start)
        back = np.repeat((area < 0) == np.array([outline for _, outline in rings]), sizes)[:, None]
        a, b = np.where(back, b, a), np.where(back, a, b)
    moved = (a != b).any(1)
    return np.hstack([a[moved], b[moved]])


def _cuts(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sides are to be split: the number of a side, and a point on it."""
    ax, ay, bx, by = np.ascontiguousarray(sides.T)
    run_x, run_y = (bx - ax).astype(float), (by - ay).astype(float)
    length = np.hypot(run_x, run_y)
    low_x, high_x, low_y, high_y = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    order = np.argsort(low_x, kind="stable")
    reach = np.searchsorted(low_x[order], high_x[order], "right")  # sides that begin before this one ends, by x
    where, points = [], []
    start = 0
    while start < len(order):
        stop, pairs = start, 0
        while stop < len(order) and (stop == start or pairs + reach[stop] - stop <= PAIRS):
            pairs += reach[stop] - stop
            stop += 1
        n = reach[start:stop] - np.arange(start, stop) - 1
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        near = (low_y[i] <= high_y[j]) & (low_y[j] <= high_y[i])
        i, j = i[near], j[near]
        # From i's first point on: i runs to d, j from r to r + e.
        dx, dy, ex, ey, long_d, long_e = run_x[i], run_y[i], run_x[j], run_y[j], length[i], length[j]
        rx, ry = (ax[j] - ax[i]).astype(float), (ay[j] - ay[i]).astype(float)
        sx, sy = rx + ex, ry + ey
        along, off_d, off_e = dx * ey - dy * ex, rx * dy - ry * dx, rx * ey - ry * ex
        # On one line, as far as the grid can tell: both ends of one lie on the line of the other.
        level = (np.abs(off_d) <= long_d) & (np.abs(sx * dy - sy * dx) <= long_d)
        level |= (np.abs(off_e) <= long_e) & (np.abs((dx - rx) * ey - (dy - ry) * ex) <= long_e)
        ends = ((rx == 0) & (ry == 0)) | ((sx == 0) & (sy == 0)) | ((rx == dx) & (ry == dy)) | ((sx == dx) & (sy == dy))
        skew = np.flatnonzero(~level & ~ends & (along != 0))  # sides with a common end meet nowhere else
        t, u = off_e[skew] / along[skew], off_d[skew] / along[skew]
        # One place in common: somewhere inside both, or where an end of one touches the other.
        slack_t, slack_u = 1.0 / np.maximum(long_d[skew], 1), 1.0 / np.maximum(long_e[skew], 1)
        meet = (t >= -slack_t) & (t <= 1 + slack_t) & (u >= -slack_u) & (u <= 1 + slack_u)
        skew, t = skew[meet], np.clip(t[meet], 0, 1)
        one, two = i[skew], j[skew]
        at = np.stack([np.round(t * dx[skew]).astype(np.int64) + ax[one], np.round(t * dy[skew]).astype(np.int64) + ay[one]], 1)
        # An end that lies there itself is meant, not its neighbour on the grid.
        for ends in (sides[one, :2], sides[one, 2:], sides[two, :2], sides[two, 2:]):
            close = (np.abs(ends - at) <= 1).all(1)
            at = np.where(close[:, None], ends, at)
        for side in (one, two):
            where.append(side)
            points.append(at)
        # Sides on one line: the ends of each that lie on the other.
        level = np.flatnonzero(level)
        for side, other in ((i[level], j[level]), (j[level], i[level])):
            for x, y in ((ax, ay), (bx, by)):
                x, y = x[other], y[other]
                inside = (x >= low_x[side]) & (x <= high_x[side]) & (y >= low_y[side]) & (y <= high_y[side])
                where.append(side[inside])
                points.append(np.stack([x[inside], y[inside]], 1))
        start = stop
    return (np.concatenate(where), np.concatenate(points)) if where else (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))


def _split(sides: np.ndarray) -> np.ndarray:
    """The sides, cut at all places where they meet others; again, until no cut is new."""
    return _pieces(sides)[0]


def _pieces(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_split`` gives, and for each piece the number of its side."""
    of = np.arange(len(sides))
    for _ in range(8):
        where, points = _cuts(sides)
        own = np.arange(len(sides))
        which = np.concatenate([own, own, where])
        at = np.concatenate([sides[:, :2], sides[:, 2:], points])
        run = ((at - sides[which, :2]).astype(float) * (sides[which, 2:] - sides[which, :2]).astype(float)).sum(1)
        order = np.lexsort((run, which))
        which, at = which[order], at[order]
        same = (which[1:] == which[:-1]) & (at[1:] != at[:-1]).any(1)
        pieces, of = np.hstack([at[:-1][same], at[1:][same]]), of[which[:-1][same]]
        if len(pieces) == len(sides):
            return pieces, of
        once, first = np.unique(pieces, axis=0, return_index=True)
        sides, of = (once, of[first]) if len(once) == len(pieces) else (pieces, of)
    return sides, of


def _added_up(pieces: np.ndarray, ways: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces from their lower end to their upper one, once each: how often they run so, less how often back, and how often at all.

    With ``ways`` a piece counts as so many.
    """
    back = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    ahead = np.where(back[:, None], pieces[:, [2, 3, 0, 1]], pieces)
    once, at = np.unique(ahead, axis=0, return_inverse=True)
    at = at.reshape(-1)
    return once, np.bincount(at, np.where(back, -1, 1) * (1 if ways is None else ways), len(once)).astype(np.int64), np.bincount(at, minlength=len(once))


def _crossed(pieces: np.ndarray, weight: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each piece ``of``: the weights of the others that a ray from its middle meets.

    The ray goes to the right, or upwards for a level piece. Weights count a
    piece that runs upwards (for the level ones: to the left) as positive.
    """
    out = np.zeros(len(of), np.int64)
    doubled = 2 * pieces  # middles are whole numbers then
    for level in (False, True):
        x, y = (1, 0) if level else (0, 1)
        asked = np.flatnonzero((pieces[of, 1] == pieces[of, 3]) == level)
        a, b = doubled[:, [x, y]], doubled[:, [x + 2, y + 2]]
        sign = np.where(a[:, 1] < b[:, 1], 1, -1) * (-1 if level else 1)
        low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
        step = max(1, PAIRS // max(1, len(pieces)))
        for k in range(0, len(asked), step):
            some = asked[k : k + step]
            middle = (a[of[some]] + b[of[some]]) // 2
            m, h = middle[:, 0][:, None], middle[:, 1][:, None]
            spans = (low <= h) & (h < high)
            spans[np.arange(len(some)), of[some]] = False
            rows, cols = np.nonzero(spans)
            u, v = a[cols], b[cols]
            dx, dy = (v[:, 0] - u[:, 0]).astype(float), (v[:, 1] - u[:, 1]).astype(float)
            meets = u[:, 0] - m[rows, 0] + dx * ((h[rows, 0] - u[:, 1]) / dy) > 0
            np.add.at(out, some[rows[meets]], (weight * sign)[cols[meets]])
    return out


def _linked(sides: np.ndarray) -> list[Polygon]:
    """Directed sides with the inside on their left as polygons: at each point the sharpest turn to the left is taken."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for ax, ay, bx, by in sides.tolist():
        after.setdefault((ax, ay), []).append((bx, by))
    outer, holes = [], []
    while after:
        start = min(after)
        ring, before = [start], None
        while True:
            at = ring[-1]
            ends = after[at]
            pick = 0
            if before is not None and len(ends) > 1:
                back = np.arctan2(before[1] - at[1], before[0] - at[0])
                turns = [(back - np.arctan2(e[1] - at[1], e[0] - at[0])) % (2 * np.pi) for e in ends]
                pick = int(np.argmin([t if t > 1e-15 else 2 * np.pi for t in turns]))
            before, following = at, ends.pop(pick)
            if not ends:
                del after[at]
            ring.append(following)
            if following == start or following not in after:
                break
        points = np.array(ring, np.int64)
        rel = (points - points[0]).astype(float)
        area = float((rel[:-1, 0] * rel[1:, 1] - rel[1:, 0] * rel[:-1, 1]).sum())
        if len(ring) > 3 and area:
            (outer if area > 0 else holes).append((abs(area), points))
    polygons = [[p] for _, p in sorted(outer, key=lambda x: x[0])]  # the smallest outline around a hole is its own
    for _, hole in sorted(holes, key=lambda x: x[1].tolist()):
        middle = (hole[0] + hole[1]) / 2
        home = next((p for p in polygons if _around(middle, p[0])), None)
        if home is not None:
            home.append(hole)
    return sorted([[r * GRID for r in p] for p in polygons], key=lambda p: p[0].tolist())


def _around(point: np.ndarray, ring: np.ndarray) -> bool:
    a, b = ring[:-1].astype(float), ring[1:].astype(float)
    up = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = a[:, 0] + (point[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool((up & (point[0] < cross)).sum() % 2)


def union(polygons: list[Polygon]) -> list[Polygon]:
    """The area that any of the polygons covers; rings may touch or cross others, but not themselves."""
    return unions([polygons])[0]


#: Groups of polygons are laid side by side at this distance, which is far more than any slack.
APART = 1000


def unions(groups: list[list[Polygon]]) -> list[list[Polygon]]:
    """``union`` of each group. Groups are laid side by side and split together, for one by one few polygons are many small steps."""
    laid, moves, ends, at = [], [], [], 0
    for polygons in groups:
        sides = _sides(polygons, turned=True)
        move = at - int(sides[:, [0, 2]].min()) if len(sides) else 0
        sides[:, [0, 2]] += move
        laid.append(sides)
        moves.append(move)
        at = int(sides[:, [0, 2]].max()) + APART if len(sides) else at
        ends.append(at - APART // 2)  # beyond this group, before the next one
    sides, ways, _ = _added_up(np.concatenate(laid) if laid else np.zeros((0, 4), np.int64))
    sides, ways = sides[ways != 0], ways[ways != 0]  # a border that runs both ways parts nothing
    pieces, of = _pieces(sides)
    pieces, way, _ = _added_up(pieces, ways[of])
    pieces, way = pieces[way != 0], way[way != 0]
    stops = np.searchsorted(pieces[:, 0], np.array(ends, np.int64))  # pieces are in the order of x
    out, start = [], 0
    for move, stop in zip(moves, stops, strict=True):
        some = pieces[start:stop] - np.array([move, 0, move, 0])
        out.append(_covered(some, way[start:stop]) if len(some) else [])
        start = stop
    return out


def _covered(pieces: np.ndarray, way: np.ndarray) -> list[Polygon]:
    """What split pieces, with how often they run ahead, are around at least once."""
    right = _crossed(pieces, way, np.arange(len(pieces)))
    # Pieces run from the lower end on: to the right, or straight up. What lies at the ray's side has the winding number that the ray met.
    up, level = pieces[:, 3] > pieces[:, 1], pieces[:, 1] == pieces[:, 3]
    # Towards the ray: the right hand of a piece that runs up, the left hand of one that runs down or level.
    ray_is_left = ~up | level
    own = np.where(up & ~level, way, np.where(level, -way, -way))
    far = right + own
    left, right = np.where(ray_is_left, right, far), np.where(ray_is_left, far, right)
    keep_ahead, keep_back = (left > 0) & (right <= 0), (right > 0) & (left <= 0)
    return _linked(np.concatenate([pieces[keep_ahead], pieces[keep_back][:, [2, 3, 0, 1]]]))


#: A ring of at most so many points is tried as a convex one.
CONVEX_POINTS = 16


def convex(polygons: list[Polygon]) -> np.ndarray:
    """Which polygons are a closed convex ring by far more than the grid can tell: they are valid as they are.

    All other points lie to the same side of each side. Polygons with holes, or more
    points than ``CONVEX_POINTS``, aren't tried.
    """
    out = np.zeros(len(polygons), bool)
    sizes: dict[int, list[int]] = {}
    for k, polygon in enumerate(polygons):
        if len(polygon) == 1 and 4 <= len(polygon[0]) <= CONVEX_POINTS:
            sizes.setdefault(len(polygon[0]), []).append(k)
    for n, which in sizes.items():
        points = _snapped(np.stack([polygons[k][0] for k in which]))
        a, d = points[:, :-1], np.diff(points, axis=1).astype(float)
        off = (a[:, None] - a[:, :, None]).astype(float)  # from each side's first point to all points
        far = d[:, :, None, 0] * off[..., 1] - d[:, :, None, 1] * off[..., 0]
        room = 4 * np.hypot(d[..., 0], d[..., 1])[:, :, None]
        side = np.arange(n - 1)
        own = (side[:, None] == side) | ((side[:, None] + 1) % (n - 1) == side)
        one = ((far > room) | own).all((1, 2)) | ((far < -room) | own).all((1, 2))
        out[which] = one & (points[:, 0] == points[:, -1]).all(1)
    return out


def repaired(polygon: Polygon) -> list[Polygon]:
    """A polygon by even and odd: what an odd number of its rings is around, as valid polygons."""
    pieces, _, times = _added_up(_split(_sides([polygon], turned=False)))
    pieces = pieces[times % 2 == 1]  # a piece that is there twice parts nothing
    if not len(pieces):
        return []
    up, level = pieces[:, 3] > pieces[:, 1], pieces[:, 1] == pieces[:, 3]
    sign = np.where(level, -1, np.where(up, 1, -1))
    met = _crossed(pieces, sign, np.arange(len(pieces)))  # every piece counts as one
    inside = met % 2 == 1  # at the ray's side
    left = np.where(~up | level, inside, ~inside)
    return _linked(np.concatenate([pieces[left], pieces[~left][:, [2, 3, 0, 1]]]))
