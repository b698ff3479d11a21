"""Distances of blocks of vectors against the plain formula, pair by pair."""

from __future__ import annotations

import math
import random

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilake.functions import vectors as V
from vigilake.operators import blockwise, identity, ranked
from vigilake.streaming import live_identity as live

TYPE = "i long, c string, m string, v array<double>"


def _plain(spark, p, r, keys):
    a, b = p.select(F.col("i"), *keys, F.col("v").alias("a")), r.select("c", *keys, F.col("v").alias("b"))
    met = a.join(b, keys) if keys else a.crossJoin(b)
    return met.groupBy("i", "c").agg(F.min(V.cosine_distance(F.col("a"), F.col("b"))).alias("dist"))


def _rows(df):
    return sorted(((r.i, r.c or "", "none" if r.dist is None else "nan" if math.isnan(r.dist) else r.dist) for r in df.collect()), key=repr)


def _odd(n, seed):
    rng = random.Random(seed)
    copy = [rng.gauss(0, 1) for _ in range(5)]
    special = [None, [], [0.0] * 5, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] + [1.0] * 4, [float("inf")] + [1.0] * 4, [1.0, 2.0], [1e-200] * 5, [1e200] * 5, [1e160, 0.0, 1.0, 1.0, 1.0], copy, copy]
    return [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), special[i % 40] if i % 40 < len(special) else copy if i % 7 == 0 else [rng.gauss(0, 1) for _ in range(5)]) for i in range(n)]


def test_distances_are_those_of_the_formula(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "BLOCK_NUMBERS", 200)
    p, r = spark.createDataFrame(_odd(160, 1), TYPE), spark.createDataFrame(_odd(170, 2), TYPE)
    for keys in ([], ["m"]):
        own = identity.distances(p, r, "i", "c", "v", *keys)
        assert _rows(own) == _rows(_plain(spark, p, r, keys))


def test_leaders_are_the_first_two_of_all_distances(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "LEADING_NUMBERS", 200)
    p, r = spark.createDataFrame(_odd(160, 1), TYPE), spark.createDataFrame(_odd(170, 2), TYPE)
    r = r.withColumn("c", F.concat("c", (F.crc32(F.concat_ws(",", "v")) % 3).cast("string")))  # a vector under one name and under several
    r = r.union(r.filter("i % 4 = 0").withColumn("c", F.concat(F.lit("_"), "c")))
    first = Window.partitionBy("i").orderBy("dist", "c")
    for keys in ([], ["m"]):
        got = identity.leaders(p, r, "i", "c", "v", *keys).withColumn("n", F.row_number().over(first)).filter("n <= 2")
        want = _plain(spark, p, r, keys).filter("dist IS NOT NULL").withColumn("n", F.row_number().over(first)).filter("n <= 2")
        assert _rows(got) == _rows(want) and want.count() > 100


def test_a_block_answers_with_two_rows_a_probe(spark):
    own, known = pa.table({"_a": [1, 2], "_v": [[1.0, 0.1], [0.1, 1.0]]}), pa.table({"_c": [f"g{k}" for k in range(50)], "_v": [[1.0, 0.02 * k] for k in range(50)]})
    assert blockwise.leading(own, known, ["i", "c", "dist"]).select(["i", "c"]).to_pylist() == [{"i": 1, "c": "g5"}, {"i": 1, "c": "g6"}, {"i": 2, "c": "g49"}, {"i": 2, "c": "g48"}]
    assert blockwise.leading(own.slice(0, 0), known, ["i", "c", "dist"]).num_rows == blockwise.leading(own, known.slice(0, 0), ["i", "c", "dist"]).num_rows == 0


def test_a_candidate_without_a_distance_keeps_no_other_from_winning(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", 0.1), (1, "c", 0.5), (2, "a", None)], "i long, c string, dist double")
    assert [tuple(r) for r in ranked.margin_winners(rows, "i", "c", "dist", 0.8, 0.1).collect()] == [(1, "b", 0.1, 0.5)]


def test_no_join_writes_the_pairs(spark):
    p = spark.createDataFrame(_odd(60, 1), TYPE)
    plan = identity.distances(p, p, "i", "c", "v", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
    q = p.withColumn("states", F.array(F.lit("a"), F.lit("b")))
    plan = identity.classified(q, p, "i", "m", "c", "v", 0.9, 0.01)._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" not in plan and "CoGroup" in plan


def test_evidence_that_another_beats_is_not_written(spark):
    """Many references of one identity, each valid later and none nearer: one row of evidence a face."""
    faces = spark.createDataFrame([(1, 7, 0, [1.0, 0.1], "m", 0.5)], "camera_id long, track_id long, at_us long, embedding array<double>, model string, score double")
    known = spark.createDataFrame([("g", "n", [1.0, 0.1 + 0.001 * k], "m", k) for k in range(200)], "global_id string, name string, embedding array<double>, model string, valid_us long")
    got = live.evidence_rows(faces.select("camera_id", "track_id", "at_us"), faces, known)
    assert got.filter("kind = 'near'").count() == 1
