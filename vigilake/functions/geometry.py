"""Boxes (struct or columns x1, y1, x2, y2), points and polygons (array of struct x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def containment(inner: Column, outer: Column) -> Column:
    """The share of `inner` that lies in `outer`."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def foot(b: Column) -> Column:
    """Bottom centre."""
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), b["y2"].alias("y"))


def inside_box(p: Column, b: Column) -> Column:
    return p["x"].between(b["x1"], b["x2"]) & p["y"].between(b["y1"], b["y2"])


def size_percent(width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """The larger share of the frame's width or height, in percent; 0 for a frame without size."""
    return F.when((frame_width > 0) & (frame_height > 0), 100.0 * F.greatest(width / frame_width, height / frame_height)).otherwise(0.0)


def oversized(b: Column, frame_width: Column, frame_height: Column, most_area: float = 0.40, most_width: float = 0.85, most_height: float = 0.75) -> Column:
    w, h = (b["x2"] - b["x1"]) / frame_width, (b["y2"] - b["y1"]) / frame_height
    return (w * h > most_area) | ((w > most_width) & (h > most_height))


def _edges(polygon: Column) -> Column:
    """Array of (a, b): each corner with the one before it, the first with the last."""
    before = F.concat(F.slice(polygon, F.size(polygon), F.lit(1)), F.slice(polygon, F.lit(1), F.size(polygon) - 1))
    return F.zip_with(polygon, before, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule by a ray to the right; fewer than three corners hold nothing."""
    crossings = F.size(
        F.filter(
            _edges(polygon),
            lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
        )
    )
    return F.when(F.size(polygon) >= 3, crossings % 2 == 1).otherwise(False)


def on_boundary(x: Column, y: Column, polygon: Column, slack: float = 1e-12) -> Column:
    def touches(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (F.abs(cross) <= slack) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(_edges(polygon), touches)


def strictly_inside(x: Column, y: Column, polygon: Column) -> Column:
    """Interior without the boundary; a polygon that crosses itself counts by the even-odd rule."""
    return in_polygon(x, y, polygon) & ~on_boundary(x, y, polygon)


def bounds(polygon: Column) -> Column:
    """The bounding box, clamped to the unit square."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.struct(unit(F.array_min(xs)).alias("x1"), unit(F.array_min(ys)).alias("y1"), unit(F.array_max(xs)).alias("x2"), unit(F.array_max(ys)).alias("y2"))


def gap_to_box(p: Column, b: Column) -> Column:
    """Distance of a point from a box; 0 inside."""
    dx = F.greatest(b["x1"] - p["x"], F.lit(0.0), p["x"] - b["x2"])
    dy = F.greatest(b["y1"] - p["y"], F.lit(0.0), p["y"] - b["y2"])
    return F.hypot(dx, dy)


def spread(points: Column) -> Column:
    """The largest distance between two of the points; 0 for fewer."""
    far = F.flatten(F.transform(points, lambda p: F.transform(points, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))
    return F.coalesce(F.array_max(far), F.lit(0.0))


def scaled(b: Column, width: Column, height: Column) -> Column:
    """A box as shares of a frame, or back with the inverse sizes."""
    return F.struct((b["x1"] / width).alias("x1"), (b["y1"] / height).alias("y1"), (b["x2"] / width).alias("x2"), (b["y2"] / height).alias("y2"))


def between(before: Column, after: Column, before_us: Column, after_us: Column, at_us: Column) -> Column:
    """A box between two samples, on a straight line in time."""
    share = F.when(after_us > before_us, (at_us - before_us) / (after_us - before_us)).otherwise(0.0)
    part = lambda k: (before[k] + (after[k] - before[k]) * share).alias(k)
    return F.struct(*(part(k) for k in ("x1", "y1", "x2", "y2")))


def tiles(width: Column, height: Column, columns: int, rows: int, overlap: float) -> Column:
    """Array of boxes that cover a frame, neighbours sharing `overlap` of a tile."""
    w = width / (columns - (columns - 1) * overlap)
    h = height / (rows - (rows - 1) * overlap)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(rows - 1)),
            lambda r: F.transform(
                F.sequence(F.lit(0), F.lit(columns - 1)),
                lambda c: F.struct(
                    (c * w * (1 - overlap)).alias("x1"), (r * h * (1 - overlap)).alias("y1"), (c * w * (1 - overlap) + w).alias("x2"), (r * h * (1 - overlap) + h).alias("y2")
                ),
            ),
        )
    )


def seam_clipped(b: Column, tile: Column, frame_width: Column, frame_height: Column, margin: float = 2.0) -> Column:
    """A box that touches an inner edge of its tile."""
    return (
        ((b["x1"] - tile["x1"] <= margin) & (tile["x1"] > 0))
        | ((b["y1"] - tile["y1"] <= margin) & (tile["y1"] > 0))
        | ((tile["x2"] - b["x2"] <= margin) & (tile["x2"] < frame_width))
        | ((tile["y2"] - b["y2"] <= margin) & (tile["y2"] < frame_height))
    )


def heat_cell(x: Column, y: Column, columns: int = 32, rows: int = 18) -> Column:
    """The cell of a normalised point, row by row; null outside the frame."""
    cell = F.least(F.floor(y * rows), F.lit(rows - 1)) * columns + F.least(F.floor(x * columns), F.lit(columns - 1))
    return F.when(x.between(0, 1) & y.between(0, 1), cell).cast("int")
