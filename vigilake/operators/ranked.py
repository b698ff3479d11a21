"""Best rows of a key, winners with a margin, and running choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in an order; give one without ties."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= k).drop("_n")


def margin_winners(distances: DataFrame, probe: str, candidate: str, distance: str, most: float, margin: float) -> DataFrame:
    """probe, candidate, distance, rival: the nearest candidate by its least distance.

    It wins only when nearer than `most` and at least `margin` nearer than the next candidate. A candidate without
    a distance is none.
    """
    least = distances.groupBy(probe, candidate).agg(F.min(distance).alias("distance")).filter(F.col("distance").isNotNull())
    by = Window.partitionBy(probe).orderBy("distance", candidate)
    seen = least.withColumn("rival", F.lead("distance").over(by)).withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
    return seen.filter((F.col("distance") < most) & (F.col("rival").isNull() | (F.col("rival") - F.col("distance") >= margin)))


def rival_gap(distances: DataFrame, probe: str, candidate: str, distance: str) -> DataFrame:
    """probe, candidate, distance, gap to the nearest other candidate (null without another)."""
    least = distances.groupBy(probe, candidate).agg(F.min(distance).alias("distance"))
    by = Window.partitionBy(probe).orderBy("distance", candidate)
    return least.withColumn("gap", F.lead("distance").over(by) - F.col("distance")).withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def until_total(df: DataFrame, keys: list[str], order: list[Column], amount: str, target: Column) -> DataFrame:
    """Rows in order until their amounts reach a target: those before which it was not yet reached."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(amount).over(by), F.lit(0))).filter(F.col("_before") < target).drop("_before")


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value, votes: the commonest value; ties go to the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    return best(counts, keys, [F.col("votes").desc(), F.col("_first"), F.col(value)]).drop("_first")


def keep_latest(df: DataFrame, keys: list[str], order: str, tie: str, k: int = 1) -> DataFrame:
    return best(df, keys, [F.col(order).desc_nulls_last(), F.col(tie).desc()], k)


def evenly(df: DataFrame, keys: list[str], order: str, tie: str, most: int) -> DataFrame:
    """At most so many rows of a key, evenly spaced in order."""
    by = Window.partitionBy(*keys)
    n = F.count("*").over(by)
    step = F.ceil(n / most)
    return df.withColumn("_step", step).withColumn("_n", F.row_number().over(by.orderBy(order, tie)) - 1).filter(F.col("_n") % F.col("_step") == 0).drop("_step", "_n")
