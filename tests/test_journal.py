"""The change log: positions, resuming, gaps; and the follower's copy and feed."""

from __future__ import annotations

import os

from vigilake.sources import journal


def drained(spark, folder, place, each=None, **options):
    """All rows since the checkpoint, by a query that starts, reads what is there and ends."""
    got = []

    def keep(batch, number):
        got.extend(tuple(r) for r in batch.collect())
        if each is not None:
            each(batch, number)

    query = journal.entries(spark, str(folder), **options).writeStream.foreachBatch(keep).option("checkpointLocation", str(place)).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    return sorted(got)


def test_a_reader_resumes_and_neither_loses_nor_repeats(spark, tmp_path):
    log, cp = tmp_path / "log", tmp_path / "cp"
    assert journal.append(str(log), [("cameras", "1", None), ("zones", "2", "x")]) == 2
    (log / "notes.txt").write_text("not a segment")
    assert drained(spark, log, cp) == [(0, "cameras", "1", None, "change"), (1, "zones", "2", "x", "change")]
    assert drained(spark, log, cp) == []
    assert journal.append(str(log), []) == 2 and journal.append(str(log), [("cameras", "3", None)]) == 3
    assert [r[0] for r in drained(spark, log, cp)] == [2]
    assert [r[0] for r in drained(spark, log, tmp_path / "cp2", begin="1", channel="cameras")] == [2]
    assert drained(spark, log, tmp_path / "cp3", begin="latest") == []


def test_a_killed_batch_is_read_again_whole(spark, tmp_path):
    log, cp = tmp_path / "log", tmp_path / "cp"
    journal.append(str(log), [("c", str(i), None) for i in range(5)])

    def die(batch, number):
        raise RuntimeError("killed")

    query = journal.entries(spark, str(log)).writeStream.foreachBatch(die).option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    except Exception as e:
        assert "killed" in str(e)
    assert [r[0] for r in drained(spark, log, cp)] == list(range(5))


def test_missing_positions_are_a_gap(spark, tmp_path):
    log, cp = tmp_path / "log", tmp_path / "cp"
    for i in range(4):
        journal.append(str(log), [("c", str(i), None)] * 2)
    drained(spark, log, tmp_path / "other")
    for _, _, path in journal.segments(str(log))[:2]:
        os.remove(path)
    assert drained(spark, log, cp, begin="1") == [(1, None, None, "4", "gap"), *((i, "c", str(i // 2), None, "change") for i in range(4, 8))]
    for _, _, path in journal.segments(str(log))[1:]:
        os.remove(path)
    journal.append(str(log), [("c", "9", None)])  # positions go on after the last segment that is left


def test_the_follower_keeps_step_and_reconciles_after_a_gap(spark, tmp_path):
    log, cp, base, out = tmp_path / "log", tmp_path / "cp", str(tmp_path / "base"), str(tmp_path / "out")
    kind = "id long, name string, n long"

    def put(rows):
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(base)

    def copy():
        return sorted(tuple(r) for r in spark.read.parquet(f"{out}/copy").select("id", "name", "n").collect())

    def feed(n):
        return sorted(tuple(r) for r in spark.read.parquet(f"{out}/feed/batch={n}").select("id", "name", "n", "change").collect())

    follow = journal.follower(lambda s: s.read.schema(kind).parquet(base), "id", out, buckets=4)
    rows = [(i, f"n{i}", i) for i in range(10)]
    put(rows)
    journal.append(str(log), [("t", "0", None)])
    drained(spark, log, cp, follow)
    assert copy() == rows and len(feed(0)) == 10
    # two keys are named; a third changed without being named and stays as it was
    now = [(1, "new", None), *[r for r in rows if r[0] not in (1, 2, 3)], (3, "silent", 3)]
    put(now)
    journal.append(str(log), [("t", "1", None), ("t", "2", None)])
    drained(spark, log, cp, follow)
    assert feed(1) == [(1, "new", None, "update"), (2, "n2", 2, "delete")]
    assert copy() == sorted([r for r in now if r[0] != 3] + [(3, "n3", 3)])
    # a batch that is run again changes nothing
    again = spark.createDataFrame([(1, "t", "1", None, "change")], journal.SCHEMA)
    before = copy(), feed(1)
    follow(again, 1)
    assert (copy(), feed(1)) == before
    # after a gap everything is compared, also keys that nothing names, and all rows of buckets may go
    put([(3, "silent", 3), (77, "late", 0)])
    follow(spark.createDataFrame([(3, None, None, "9", "gap")], journal.SCHEMA), 2)
    assert copy() == [(3, "silent", 3), (77, "late", 0)]
    assert len(feed(2)) == 10 and (3, "silent", 3, "update") in feed(2)
