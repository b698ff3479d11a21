"""Quantiles by nearest rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], pieces: int = 256) -> DataFrame:
    """`keys` and, for each name, the value at rank round(q * (n - 1)), halves to even; 0.0 without values.

    Equal values are counted first. A sketch cuts each key's values into `pieces` ranges, exact counts of the ranges tell
    which one holds a rank, and only that range is put in order: a busy key takes many tasks and no task sorts
    more than about one range of it, however often a value repeats.
    """
    named = {c: f"_k{i}" for i, c in enumerate(keys)}
    own = list(named.values())
    values = df.select(*(F.col(c).alias(n) for c, n in named.items()), F.col(value).cast("double").alias("_v"))
    cuts = F.percentile_approx("_v", [i / pieces for i in range(1, pieces)], 20 * pieces)
    shape = values.groupBy(*own).agg(F.coalesce(cuts, F.array().cast("array<double>")).alias("_cuts"), F.count("_v").alias("_n"))
    counted = values.filter(F.col("_v").isNotNull()).groupBy(*own, "_v").agg(F.count("*").alias("_m"))
    placed = _joined(counted, shape.select(*own, "_cuts"), own).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy(*own).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*own, "_piece").agg(F.sum("_m").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    at = F.array(*(F.struct(F.lit(name).alias("name"), F.rint(F.lit(q) * (F.col("_n") - 1)).cast("long").alias("rank")) for name, q in quantiles.items()))
    asked = shape.filter("_n > 0").select(*own, F.explode(at).alias("_a")).select(*own, F.col("_a.name").alias("_name"), F.col("_a.rank").alias("_rank"))
    held = _joined(sizes, asked, own).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size")))
    near = _joined(placed, held.select(*own, "_piece", "_name", (F.col("_rank") - F.col("_before")).alias("_rank")), [*own, "_piece"])
    upto = F.sum("_m").over(Window.partitionBy(*own, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = near.withColumn("_upto", upto).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_m")))
    wide = found.groupBy(*own).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in quantiles))
    out = _joined(shape.select(*own), wide, own, "left")
    return out.select(*(F.col(n).alias(c) for c, n in named.items()), *(F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in quantiles))


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns that may be null, with those of `a`."""
    other = b.select(*(F.col(c).alias(f"_j{c}") if c in on else F.col(c) for c in b.columns))
    return a.join(other, reduce(Column.__and__, (a[c].eqNullSafe(other[f"_j{c}"]) for c in on)) if on else F.lit(True), how).drop(*(f"_j{c}" for c in on))


def nearest_rank_of(values: Column, q: float) -> Column:
    """The same of an array column."""
    own = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.when(F.size(own) > 0, F.element_at(own, F.rint(F.lit(q) * (F.size(own) - 1)).cast("int") + 1)).otherwise(0.0)
