"""A row of a fold looks at few entries, however many a camera has; a frame is no one row."""

from __future__ import annotations

from vigilake.streaming import association, birth_spots, motion


class Counted(dict):
    """Entries that count how often they are gone through."""

    rounds = 0

    def items(self):
        Counted.rounds += 1
        return super().items()


def test_a_row_looks_at_few_spots(monkeypatch):
    calls = []
    monkeypatch.setattr(motion, "overlap", lambda a, b, real=motion.overlap: calls.append(1) or real(a, b))
    spots = {f"s/{i}": {"class": "car", "box": [100.0 * i, 0.0, 100.0 * i + 60, 80.0], "since": 0, "seen": i, "travelled": 0, "first": [i, i]} for i in range(500)}
    scene = motion.Scene(motion.Motion(), spots)
    out = scene.take({"at_us": 1000, "detection_id": 9, "track_id": 9000, "class_name": "car", "x1": 25002.0, "y1": 0.0, "x2": 25062.0, "y2": 80.0})
    assert out[0][3] == motion.PARKED and len(calls) < 20
    scene.expire(501 + motion.Motion().spot_us - 1)
    assert "s/499" not in scene.entries or len(scene.entries) < 502


def test_a_birth_goes_through_no_tracks():
    fold = birth_spots.Births(birth_spots.Registry(), Counted())
    for i in range(50):
        row = {"at_us": i, "detection_id": i, "track_id": i, "class_name": "car", "x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 9.0, "moved": False, "confidence": 0.1}
        fold.expire(i - 1)
        fold.take(row)
    assert Counted.rounds == 0 and len(fold.entries) == 51


def test_no_row_is_a_whole_frame(spark):
    rows = spark.createDataFrame([(1, 5, i, "car", 90.0 * i, 0.0, 90.0 * i + 60, 80.0) for i in range(40)], "camera_id long, at_us long, detection_id long, class_name string, x1 double, y1 double, x2 double, y2 double")
    got = association.associated(rows)
    assert "to_json" not in got._jdf.queryExecution().optimizedPlan().toString().lower() and "structstojson" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.detection_id for r in got.orderBy("detection_id").collect()] == list(range(40))
