"""Joins on overlapping or near intervals by time buckets, never pairwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    first, last = F.floor(low / width).cast("long"), F.floor(high / width).cast("long")
    return df.withColumn("_bucket", F.explode(F.when(last >= first, F.sequence(first, last))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], bucket_us: int, extra: Column | None = None) -> DataFrame:
    """Pairs whose closed spans meet; both tables' columns besides the keys must differ in name.

    Each side is repeated once per bucket its span touches; a pair counts in the first bucket they
    share, so it appears once without a distinct. Choose bucket_us near the usual span.
    """
    a = left.withColumn("_l0", left_span[0]).withColumn("_l1", left_span[1])
    b = right.withColumn("_r0", right_span[0]).withColumn("_r1", right_span[1])
    a, b = _bucketed(a, F.col("_l0"), F.col("_l1"), bucket_us), _bucketed(b, F.col("_r0"), F.col("_r1"), bucket_us)
    meets = (F.col("_l0") <= F.col("_r1")) & (F.col("_r0") <= F.col("_l1"))
    once = F.col("_bucket") == F.floor(F.greatest("_l0", "_r0") / bucket_us).cast("long")
    out = a.join(b, [*keys, "_bucket"]).filter(meets & once)
    if extra is not None:
        out = out.filter(extra)
    return out.drop("_bucket", "_l0", "_l1", "_r0", "_r1")


def semi(left: DataFrame, right: DataFrame, key: str, *args, anti: bool = False, **kw) -> DataFrame:
    """Left rows that meet some right row, or with `anti` none; `key` identifies a left row."""
    hits = overlapping(left, right, *args, **kw).select(key).distinct()
    return left.join(hits, key, "left_anti" if anti else "left_semi")


def covering(points: DataFrame, segments: DataFrame, keys: list[str], key: str, at: str, start: str, end: str, payload: list[str], tie: str, bucket_us: int) -> DataFrame:
    """`points` with the newest segment with start <= at < end, segments may overlap; nulls without one."""
    s = segments.select(*keys, *(F.col(c).alias(f"_s_{c}") for c in dict.fromkeys([*payload, start, end, tie])))
    met = overlapping(points, s, keys, (F.col(at), F.col(at)), (F.col(f"_s_{start}"), F.col(f"_s_{end}") - 1), bucket_us)
    by = Window.partitionBy(key).orderBy(F.col(f"_s_{start}").desc(), F.col(f"_s_{tie}").desc())
    best = met.withColumn("_n", F.row_number().over(by)).filter("_n = 1").select(key, *(F.col(f"_s_{c}").alias(c) for c in payload))
    return points.join(best, key, "left")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], key: str, at: str, other: str, slack_us: int, payload: list[str], tie: str) -> DataFrame:
    """`left` with the right row nearest in time within the slack, and gap_us; nulls without one."""
    r = right.select(*keys, F.col(other).alias("_o"), F.struct(F.col(tie)).alias("_tie"), F.struct(*payload).alias("_pay"))
    met = closest(left.select(*keys, key, F.col(at).alias("_at")), r, keys, F.col("_at"), slack_us, slack_us)
    best = met.groupBy(key).agg(F.min_by("_found", F.struct("_found.gap_us", "_found._tie")).alias("_found"))
    return left.join(best.select(key, *(F.col(f"_found._pay.`{c}`").alias(c) for c in payload), "_found.gap_us"), key, "left")


def closest(left: DataFrame, right: DataFrame, keys: list[str], at: Column, back_us: int, ahead_us: int) -> DataFrame:
    """The rows of `left` that some right row comes near: _found (gap_us, _tie, _pay) is the one nearest to `at`, at most so far back or ahead.

    `right` has the keys, _o (its time), _tie (of rows as near the smallest goes) and _pay. Null keys and times meet nothing.
    The nearest before and after are the neighbours in one order of both sides, cut by buckets of time, so no pairs are made.
    """
    width = max(2 * (back_us + ahead_us), 1)
    known = lambda df, t: df.filter(F.col(t).isNotNull()).dropna(subset=keys)
    a = known(left.select(*keys, at.alias("_t"), F.struct(*left.columns).alias("_left")), "_t").withColumn("_bucket", F.floor(F.col("_t") / width).cast("long")).withColumn("_side", F.lit(1))
    b = known(right, "_o").select(*keys, F.col("_o").alias("_t"), F.struct("_o", "_tie", "_pay").alias("_right"))
    b = _bucketed(b, F.col("_t") - ahead_us, F.col("_t") + back_us, width).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = []
    for name, order, most in (("_before", F.col("_t").asc(), back_us), ("_after", F.col("_t").desc(), ahead_us)):
        by = Window.partitionBy(*keys, "_bucket").orderBy(order, "_side", F.col("_right._tie").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn(name, F.last("_right", ignorenulls=True).over(by))
        gap = F.abs(F.col(f"{name}._o") - F.col("_t"))
        seen.append(F.when(gap <= most, F.struct(gap.alias("gap_us"), F.col(f"{name}._tie"), F.col(f"{name}._pay"))))
    order = lambda x: F.struct(x["gap_us"], x["_tie"])
    before, after = F.col("_b"), F.col("_a")
    met = both.filter(F.col("_left").isNotNull()).select("_left", seen[0].alias("_b"), seen[1].alias("_a"))
    found = F.when(before.isNull() | (order(after) < order(before)), after).otherwise(before)
    return met.select("_left.*", F.when(after.isNull(), before).otherwise(found).alias("_found")).filter(F.col("_found").isNotNull())
