"""Gaps and islands: runs of intervals or of equal states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stitched(df: DataFrame, keys: list[str], start: Column, end: Column, gap_us: int, tie: str, name: str = "run") -> DataFrame:
    """`df` with `name`: the number of the run a row belongs to, from 1 within its keys.

    A run ends where the next start lies more than gap_us after the largest end so far.
    """
    by = Window.partitionBy(*keys).orderBy(start, F.col(tie))
    reached = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (start - reached > gap_us), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_fresh")


def packed(df: DataFrame, keys: list[str], start: Column, tie: str, run: str = "run", rows: int = 4096, name: str = "pack") -> DataFrame:
    """`df` with `name`: neighbouring runs of one key get the same number until they hold about `rows` rows; no run is cut.

    For folds in Python that would otherwise be called once for each of many small runs. Needs no shuffle beyond that of `stitched`.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(start, F.col(tie)))
    first = F.min("_place").over(Window.partitionBy(*keys, run))
    return df.withColumn("_place", place).withColumn(name, F.floor((first - 1) / rows)).drop("_place")


def in_order(df: DataFrame, keys: list[str], at: str, tie: str, gap_us: int) -> DataFrame:
    """`df` for an ordered fold in tasks: each partition sorted by run and time, `_opens` true where a run begins.

    Runs are apart by more than gap_us and dealt one by one, so a busy key takes many tasks where its pauses allow it.
    """
    runs = stitched(df, keys, F.col(at), F.col(at), gap_us, tie, "_run").repartition(*keys, "_run")
    opens = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(at, tie)) == 1
    return runs.withColumn("_opens", opens).sortWithinPartitions(*keys, "_run", at, tie, F.col("_opens").desc()).drop("_run")


def merged(df: DataFrame, keys: list[str], start: Column, end: Column, gap_us: int, tie: str) -> DataFrame:
    """keys, started_us, ended_us, pieces: intervals joined over gaps of at most gap_us."""
    runs = stitched(df.withColumn("_s", start).withColumn("_e", end), keys, F.col("_s"), F.col("_e"), gap_us, tie)
    return runs.groupBy(*keys, "run").agg(F.min("_s").alias("started_us"), F.max("_e").alias("ended_us"), F.count("*").alias("pieces")).drop("run")


def state_runs(df: DataFrame, keys: list[str], at: str, state: str, tie: str) -> DataFrame:
    """keys, state, run, first, last, n: stretches of one unchanged state in order of time."""
    by = Window.partitionBy(*keys).orderBy(at, tie)
    fresh = F.when(F.lag(state).over(by).eqNullSafe(F.col(state)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    runs = df.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "run").agg(F.first(state).alias(state), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
