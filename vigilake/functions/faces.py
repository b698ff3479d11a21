"""Whether five landmarks (left eye, right eye, nose, left and right mouth corner) look like a face from the front."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: where the landmarks lie in an aligned crop of 112 x 112
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def _five(points: Column) -> Column:
    return F.coalesce((F.size(points) == 5) & ~F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull()), F.lit(False))


def plausible(points: Column, box: Column) -> Column:
    """Eyes over nose over mouth, left before right, all in sane shares of the face's box; false where a point is missing."""
    left, right, nose, low, high = (F.get(points, i) for i in range(5))
    wide, tall = box["x2"] - box["x1"], box["y2"] - box["y1"]
    apart, brow, mouth = right["x"] - left["x"], (left["y"] + right["y"]) / 2, (low["y"] + high["y"]) / 2
    sound = (
        (wide > 0)
        & (tall > 0)
        & (apart > 0)
        & (low["x"] < high["x"])
        & (brow < nose["y"])
        & (nose["y"] < mouth)
        & apart.between(0.15 * wide, 0.95 * wide)
        & nose["x"].between(left["x"] - 0.5 * apart, right["x"] + 0.5 * apart)
        & (mouth - brow).between(0.15 * tall, 0.95 * tall)
    )
    return _five(points) & F.coalesce(sound, F.lit(False))


def residual(points: Column) -> Column:
    """Root mean square distance from the template after the best turn, scale and shift, in its eye distance.

    The fit is by least squares over all five points. Null where a point is missing or all lie in one place.
    """
    n = len(TEMPLATE)
    cu, cv = (sum(p[i] for p in TEMPLATE) / n for i in (0, 1))
    x, y = ([F.get(points, i)[c] for i in range(n)] for c in ("x", "y"))
    mx, my = sum(x[1:], x[0]) / n, sum(y[1:], y[0]) / n
    size, along, across = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for px, py, (u, v) in zip(x, y, TEMPLATE, strict=True):
        dx, dy = px - mx, py - my
        size, along, across = size + dx * dx + dy * dy, along + dx * (u - cu) + dy * (v - cv), across + dx * (v - cv) - dy * (u - cu)
    whole = sum((u - cu) ** 2 + (v - cv) ** 2 for u, v in TEMPLATE)
    eyes = ((TEMPLATE[1][0] - TEMPLATE[0][0]) ** 2 + (TEMPLATE[1][1] - TEMPLATE[0][1]) ** 2) ** 0.5
    left = F.greatest(F.lit(whole) - (along * along + across * across) / size, F.lit(0.0))
    return F.when(_five(points) & (size > 0), F.sqrt(left / n) / eyes)
