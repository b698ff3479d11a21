"""As-of joins by one sort of both sides, cut by time where a key is large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], tie: str, direction: str = "backward", prefix: str = "", width_us: int | None = None) -> DataFrame:
    """`left` with the nearest earlier (or later) right row's payload; nulls where there is none.

    Equal times count as found either way. Among right rows of one time the largest `tie` wins, a null one last.
    Null keys meet null keys; a left row without time finds nothing. Both sides are shuffled once and sorted; nothing
    is compared pairwise.

    With `width_us` a key's rows are cut into buckets of time, so a busy key fills as many tasks as it has buckets. The
    last right row of each bucket is carried into the next ones by a scan that sees one row of a bucket. The left
    side's keys and times are read twice then: meant for stored tables rather than costly plans.
    """
    names = [f"{prefix}{c}" for c in payload]
    packed = F.struct(*(F.col(c).alias(n) for c, n in zip(payload, names, strict=True)))
    own = [c for c in left.columns]
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(None).cast("long").alias("_tie"), F.lit(1).alias("_side"), F.struct(*own).alias("_left"))
    b = right.filter(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.col(tie).cast("long").alias("_tie"), F.lit(0).alias("_side"), packed.alias("_right"))
    within = list(keys)
    if width_us is not None:
        within.append("_bucket")
        bucket = F.floor(F.col("_t") / width_us)
        a, b = a.withColumn("_bucket", bucket), b.withColumn("_bucket", bucket)
        b = b.unionByName(_carried(a, b, keys, direction, width_us))
    both = a.unionByName(b, allowMissingColumns=True)
    by = Window.partitionBy(*within)
    # a frame that only grows costs one step a row, whichever way time runs
    t = F.col("_t").asc() if direction == "backward" else F.col("_t").desc()
    found = F.last("_right", ignorenulls=True).over(by.orderBy(t, "_side", F.col("_tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("_found", F.when(F.col("_t").isNotNull(), found)).filter(F.col("_left").isNotNull())
    return met.select(*(F.col(f"_left.`{c}`").alias(c) for c in own), *(F.col(f"_found.`{n}`").alias(n) for n in names))


def _carried(a: DataFrame, b: DataFrame, keys: list[str], direction: str, width_us: int) -> DataFrame:
    """A right row for each bucket of either side: the nearest one of the buckets passed before it."""
    back = direction == "backward"
    # the row that the order of `asof` reaches last
    order = F.struct((F.col("_t") if back else -F.col("_t")).alias("t"), F.col("_tie").isNull().alias("n"), F.col("_tie").alias("tie"))
    ends = b.groupBy(*keys, "_bucket").agg(F.max_by("_right", order).alias("_end"))
    places = a.filter(F.col("_t").isNotNull()).groupBy(*keys, "_bucket").agg(F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"))
    ends = ends.unionByName(places).groupBy(*keys, "_bucket").agg(F.first("_end", ignorenulls=True).alias("_end"))
    passed = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc() if back else F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.col("_bucket") * width_us if back else (F.col("_bucket") + 1) * width_us - 1
    got = ends.withColumn("_right", F.last("_end", ignorenulls=True).over(passed)).filter(F.col("_right").isNotNull())
    return got.select(*keys, edge.alias("_t"), F.lit(None).cast("long").alias("_tie"), F.lit(-1).alias("_side"), "_right", "_bucket")


def highest(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, value: str, width_us: int, name: str = "highest") -> DataFrame:
    """`left` with the largest `value` of the right rows of its keys with other <= at; null where there is none.

    Cut by buckets of time as in `asof`: a bucket's largest value is carried on by a scan of one row a bucket. A null key
    meets a null key; a left row without time finds nothing.
    """
    bucket = F.floor(F.col("_t") / width_us)
    a = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left")).withColumn("_bucket", bucket)
    b = right.filter(F.col(other).isNotNull()).select(*keys, F.col(other).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_value")).withColumn("_bucket", bucket)
    tops = b.groupBy(*keys, "_bucket").agg(F.max("_value").alias("_top"))
    places = a.filter(F.col("_t").isNotNull()).select(*keys, "_bucket").distinct()
    passed = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.unionByName(places, allowMissingColumns=True).groupBy(*keys, "_bucket").agg(F.max("_top").alias("_top"))
    begin = tops.withColumn("_value", F.max("_top").over(passed)).filter(F.col("_value").isNotNull()).select(*keys, (F.col("_bucket") * width_us).alias("_t"), F.lit(-1).alias("_side"), "_value", "_bucket")
    both = a.unionByName(b.unionByName(begin), allowMissingColumns=True)
    by = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_high", F.when(F.col("_t").isNotNull(), F.max("_value").over(by))).filter(F.col("_left").isNotNull())
    return met.select(*(F.col(f"_left.`{c}`").alias(c) for c in left.columns), F.col("_high").alias(name))


def cover(left: DataFrame, segments: DataFrame, keys: list[str], at: str, start: str, end: str, payload: list[str], tie: str, prefix: str = "", width_us: int | None = None) -> DataFrame:
    """`left` with the newest segment that starts at or before `at`, where it still covers it.

    For segments that do not overlap within a key; otherwise use `rangejoin.covering`.
    """
    got = asof(left, segments, keys, at, start, [*payload, *(c for c in (start, end) if c not in payload)], tie, prefix="_c_", width_us=width_us)
    holds = F.col(f"_c_{end}") > F.col(at)
    return got.select(*left.columns, *(F.when(holds, F.col(f"_c_{c}")).alias(f"{prefix}{c}") for c in payload))
