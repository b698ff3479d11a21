"""Zones whose ring crosses itself: split once, on the zone table, into rings that do not.

What a ring winds around belongs to the zone, whichever way round; so both halves of a bow-tie stay and the middle of a
five-pointed star too. Spikes and edges walked to and fro enclose nothing and go. The work is exact, in fractions, and
square in the corners of one polygon; the test of points against the rings is native.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G

RINGS = "array<array<struct<x: double, y: double>>>"
Point = tuple[Fraction, Fraction]


def _cross(o: Point, a: Point, b: Point) -> Fraction:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _within(p: Point, a: Point, b: Point) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cut(edges: list[tuple[Point, Point]]) -> Counter:
    """How often each piece between meeting points is walked, piece and direction; a piece lies in order of its ends."""
    walked: Counter = Counter()
    for a, b in edges:
        nodes = {a, b}
        for c, d in edges:
            nodes |= {p for p in (c, d) if _cross(a, b, p) == 0 and _within(p, a, b)}
            sides = _cross(a, b, c), _cross(a, b, d)
            if sides[0] * sides[1] < 0:
                share = sides[0] / (sides[0] - sides[1])
                p = (c[0] + (d[0] - c[0]) * share, c[1] + (d[1] - c[1]) * share)
                if _within(p, a, b):
                    nodes.add(p)
        line = sorted(nodes, reverse=a > b)
        for p, q in zip(line, line[1:], strict=False):
            walked[min(p, q), max(p, q)] += 1 if p < q else -1
    return walked


def _wound(m: Point, way: Point, walked: Counter) -> int:
    """How often the pieces wind around a point just ahead of `m`, by a ray along `way`."""
    ahead, total = (m[0] + way[0], m[1] + way[1]), 0
    for (p, q), n in walked.items():
        s, t = _cross(m, ahead, p), _cross(m, ahead, q)
        if (s > 0) != (t > 0):
            x, y = p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)
            if (x - m[0]) * way[0] + (y - m[1]) * way[1] > 0:
                total += n if t > 0 else -n
    return total


def _loops(borders: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Closed walks along the borders, the inside always to the left, each within one wedge."""
    leaving: dict[Point, list[Point]] = defaultdict(list)
    for a, b in sorted(borders):
        leaving[a].append(b)
    loops = []
    while leaving:
        start = min(leaving)
        loop, at, before = [start], leaving[start][0], start
        leaving[start].remove(at)
        while at != start:
            loop.append(at)
            back = math.atan2(before[1] - at[1], before[0] - at[0])
            follow = min(leaving[at], key=lambda w: (back - math.atan2(w[1] - at[1], w[0] - at[0])) % (2 * math.pi))  # noqa: B023
            leaving[at].remove(follow)
            before, at = at, follow
        loops.append(loop)
        leaving = defaultdict(list, {k: v for k, v in leaving.items() if v})
    return loops


def repaired(ring: list[tuple[float, float]] | None) -> list[list[tuple[float, float]]]:
    """Rings of the same zone that do not cross themselves, outer ones to the left and holes to the right; none without area.

    A corner that is null or not finite makes the ring void. Corners on a straight line are dropped; a ring begins with its
    least corner.
    """
    if not ring or any(c is None or not math.isfinite(c) for p in ring for c in p):
        return []
    corners = [(Fraction(x), Fraction(y)) for x, y in ring]
    walked = _cut([(a, b) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True) if a != b])
    borders = []
    for (a, b), n in walked.items():
        right = _wound(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), (b[1] - a[1], a[0] - b[0]), walked)
        if (right + n != 0) != (right != 0):
            borders.append((a, b) if right + n != 0 else (b, a))
    out = []
    for loop in _loops(borders):
        bent = [p for before, p, after in zip([loop[-1], *loop], loop, [*loop[1:], loop[0]], strict=False) if _cross(before, p, after) != 0]
        first = bent.index(min(bent))
        out.append([(float(x), float(y)) for x, y in bent[first:] + bent[:first]])
    return out


def repaired_zones(zones: DataFrame, polygon: str = "polygon", name: str = "rings") -> DataFrame:
    """`zones` with `name`: the rings of each polygon (array of x, y); zones without area go."""

    @F.pandas_udf(RINGS)
    def rings(polygons: pd.Series) -> pd.Series:
        corners = lambda p: None if p is None else [(None, None) if c is None else (c["x"], c["y"]) for c in p]
        return pd.Series([[[{"x": x, "y": y} for x, y in r] for r in repaired(corners(p))] for p in polygons])

    points = F.col(polygon).cast("array<struct<x: double, y: double>>")
    return zones.withColumn(name, rings(points)).filter(F.size(name) > 0)


def strictly_within(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies inside the rings of `repaired_zones`, not on their border."""
    odd = F.aggregate(rings, F.lit(False), lambda was, r: was != G.in_polygon(x, y, r))
    return odd & ~F.exists(rings, lambda r: G.on_boundary(x, y, r))
