"""Vectors as arrays; all sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, from 0 to 2; null for a vector of length 0."""
    size = norm(a) * norm(b)
    return F.lit(1.0) - dot(a, b) / F.when(size > 0, size)


def normalised(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def literal(a: Column, digits: int = 6) -> Column:
    """The text form of a vector with fixed decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ","), F.lit("]"))


def parsed(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def added(a: Column, b: Column) -> Column:
    """Element-wise sum; a missing element counts as 0."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def mean_abs_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def ema(state: Column, new: Column, rate: float) -> Column:
    """A moving average of unit vectors, brought back to length 1."""
    return normalised(F.zip_with(state, new, lambda s, x: s.cast("double") * (1 - rate) + x.cast("double") * rate))
