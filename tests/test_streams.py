"""Streams over files, cut into different micro-batches, and the sinks that they feed."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from vigilake.sources import sinks, streams
from vigilake.streaming import windows

SCHEMA = "region_id long, at_us long, label string"


def written(folder, parts):
    folder.mkdir()
    for i, rows in enumerate(parts):
        file = folder / f"{i:03}.json"
        file.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(file, (1_700_000_000 + 10 * i,) * 2)  # a file stream takes the oldest first
    return str(folder)


@pytest.mark.parametrize("files", [1, 16])
def test_scene_states_do_not_depend_on_the_batches(spark, tmp_path, files):
    labels = "a a b a a b b b c b b a".split()
    rows = [{"region_id": r, "at_us": 10 * i + r, "label": x} for i, x in enumerate(labels) for r in (1, 2)]
    path = written(tmp_path / "in", [rows[i : i + 4] for i in range(0, len(rows), 4)])
    stream = windows.scene_states(streams.messages(spark, path, SCHEMA, files), 2)
    query = stream.writeStream.foreachBatch(sinks.foreach_append(str(tmp_path / "out"), "at_us")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    want = {(r, 10 * i + r, x) for r in (1, 2) for i, x in ((1, "a"), (6, "b"))}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    rows = spark.range(20).select("id", (F.col("id") * 2).alias("x"))
    write = sinks.foreach_append(str(tmp_path / "t"), "id")
    for batch in (rows.filter("id < 10"), rows.filter("id < 10"), rows.filter("id BETWEEN 5 AND 14"), rows.union(rows)):
        write(batch, 0)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(20))


def test_rewrite_replaces_only_the_partitions_that_appear(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.rewrite(spark.createDataFrame([(1, "a"), (2, "b")], "day int, x string"), at, "day")
    sinks.rewrite(spark.createDataFrame([(2, "c")], "day int, x string"), at, "day")
    assert {(r.day, r.x) for r in spark.read.parquet(at).collect()} == {(1, "a"), (2, "c")}


def test_newest_frame_of_each_camera(spark):
    rows = [(1, 5, 100), (1, 7, 90), (2, 3, 50), (1, 6, 95)]
    got = streams.latest_frames(spark.createDataFrame(rows, "camera_id long, sequence long, timestamp_us long")).collect()
    assert [tuple(r) for r in got] == [(2, 3, 50, 0), (1, 7, 90, 2)]
