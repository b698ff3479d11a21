"""The change feed between two readings of a table."""

from __future__ import annotations

from vigilake.sources import tables


def test_changes_tell_what_came_went_and_changed(spark):
    kind = "a long, b string, v long"
    before = spark.createDataFrame([(1, "x", 1), (2, "x", None), (3, None, 3), (4, "x", 4)], kind)
    after = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, None, None), (5, None, 5)], kind)
    got = sorted(tuple(r) for r in tables.changes(before, after, ["a", "b"]).collect())
    assert got == [(2, "x", 2, "update"), (3, None, None, "update"), (4, "x", 4, "delete"), (5, None, 5, "insert")]
    assert tables.changes(after, after, ["a", "b"]).count() == 0
    assert {r.change for r in tables.changes(before.limit(0), after, ["a", "b"]).collect()} == {"insert"}
