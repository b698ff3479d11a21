"""As-of joins over buckets of time against a plain search, and how a busy key is spread."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigilake.functions import times as T
from vigilake.operators import asof, recordings

LEFT, RIGHT = "id long, k string, at long", "k string, t long, tie long, v string"


def tables(spark, seed=1):
    rng = random.Random(seed)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.randint(-3000, 9000), rng.randint(0, 90) * 100])) for i in range(400)]
    right = [(rng.choice(["a", "a", "b", None]), rng.choice([rng.randint(-2500, 6000), rng.randint(0, 60) * 100]), rng.randint(0, 3), f"v{i}") for i in range(150)]
    seen, rows = set(), []
    for r in right:  # one row a (key, time, tie), so that the answer is one
        if r[:3] not in seen:
            seen.add(r[:3])
            rows.append(r)
    return [*left, (1000, "a", None), (1001, "none", 5)], [*rows, ("a", None, 1, "never")]


def plain(left, right, direction):
    out = []
    for i, k, at in left:
        fits = [r for r in right if r[0] == k and None not in (r[1], at) and (r[1] <= at if direction == "backward" else r[1] >= at)]
        best = max(fits, key=lambda r: (r[1] if direction == "backward" else -r[1], r[2]), default=None)
        out.append((i, best and best[3], best and best[1]))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("width", [None, 100, 700, 100_000])
def test_buckets_find_what_a_plain_search_finds(spark, direction, width):
    left, right = tables(spark)
    got = asof.asof(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "at", "t", ["v", "t"], "tie", direction, "r_", width)
    assert got.columns == ["id", "k", "at", "r_v", "r_t"]
    assert sorted((r.id, r.r_v, r.r_t) for r in got.collect()) == plain(left, right, direction)


def test_empty_sides_and_null_ties(spark):
    left, right = spark.createDataFrame([(1, "a", 950)], LEFT), spark.createDataFrame([("a", 10, None, "last"), ("a", 10, 5, "first")], RIGHT)
    for width in (None, 100):
        find = lambda a, b, d="backward": [r.v for r in asof.asof(a, b, ["k"], "at", "t", ["v"], "tie", d, width_us=width).collect()]  # noqa: B023,E731
        assert find(left, right) == ["last"] and find(left.withColumn("at", F.lit(-950).cast("long")), right, "forward") == ["last"]
        assert find(left, right.limit(0)) == [None] and find(left.limit(0), right) == []


def test_one_busy_camera_fills_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(4000).select(F.lit("a").alias("k"), (F.col("id") * 97 % 4000 * T.HOUR).alias("at"))
        right = spark.range(2000).select(F.lit("a").alias("k"), (F.col("id") * 2 * T.HOUR).alias("t"), F.col("id").alias("v"))

        def tasks(width):
            got = asof.asof(left, right, ["k"], "at", "t", ["v"], "v", width_us=width).withColumn("task", F.spark_partition_id()).collect()
            assert all(r.v * 2 * T.HOUR <= r["at"] < (r.v + 1) * 2 * T.HOUR for r in got)
            return Counter(r.task for r in got)

        assert len(tasks(None)) == 1
        assert len(tasks(T.DAY)) == 4 and max(tasks(T.DAY).values()) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_repeated_spans_come_back_as_often_with_their_segment(spark):
    m = T.MINUTE
    spans = spark.createDataFrame([(1, 0, 10 * m, None), (1, 0, 10 * m, None), (1, 20 * m, 22 * m, "x"), (None, 0, 1, "n")], "camera_id long, started_us long, ended_us long, note string")
    segments = spark.createDataFrame([(1, 7, 4 * m, 6 * m), (1, 8, 20 * m, None)], "camera_id long, recording_id long, started_us long, ended_us long")
    got = recordings.covering_or_middle(spans, segments, "started_us", "ended_us")
    assert got.columns == [*spans.columns, "recording_id"]
    assert sorted((r.note or "", r.recording_id) for r in got.collect()) == [("", 7), ("", 7), ("n", None), ("x", 8)]
