"""Detections of frames to tracks, by overlap with where a track should be and, for lost ones, by appearance.

A track lives on credit of time: a sighting adds twice the time since the last frame, every frame takes
that time away, and a sighted track has at least `least_us`. One frame takes `longest_step_us` at most, so an
outage does not end all tracks, unless it lasts `outage_us`. A first sighting earns no name: the second,
in the next frames, does. A track out of credit is lost; while it is remembered, a new track of
similar appearance takes its name when it earns one. A track's name is its first detection's number.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import sqrt
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times as T
from .motion import overlap
from .ordered import Fold, folded, streamed

OUT = "camera_id long, at_us long, detection_id long, track_id long, regained boolean"


@dataclass(frozen=True)
class Association:
    """The largest distance of a match, the least credit, the longest step, the outage. The rest is a setting."""

    distance: float = 0.7
    lost_us: int = 4 * T.SECOND
    remembered_us: int = 20 * T.SECOND
    appearance: float = 0.45
    least_us: int = T.SECOND
    longest_step_us: int = 3 * T.SECOND
    outage_us: int = 120 * T.SECOND


def unlike(a: list[float] | None, b: list[float] | None) -> float:
    """Cosine distance; 2 where one is missing or of length 0."""
    if not a or not b or len(a) != len(b):
        return 2.0
    size = sqrt(sum(x * x for x in a)) * sqrt(sum(x * x for x in b))
    return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 2.0


def pairs_by_cost(costs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """(left, right) of the cheapest pair, the cheapest of the rest, and so on; ties to smaller numbers."""
    left, right, out = set(), set(), []
    for _, a, b in sorted(costs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return out


def ahead(track: dict, now: int) -> list[float]:
    """The track's box, moved on at its own pace."""
    dt = (now - track["seen"]) / T.SECOND
    return [c + track["pace"][i % 2] * dt for i, c in enumerate(track["box"])]


class Tracks(Fold):
    """Entries `t/number of the first detection` of one camera, and `frame`: the time of the last one."""

    def __init__(self, rules: Association, entries: dict[str, Any] | None = None):
        super().__init__(entries)
        self.rules = rules

    def _open(self, state: str) -> list[int]:
        return sorted(int(n[2:]) for n, t in self.entries.items() if n[0] == "t" and t["state"] == state)

    def _aged(self, step: int) -> None:
        for name in [n for n in self.entries if n[0] == "t"]:
            t = self.entries[name]
            t["credit"] -= step
            if t["state"] == "named" and t["credit"] < 0:
                t["state"], t["credit"] = "lost", self.rules.remembered_us
            elif t["credit"] < 0:
                del self.entries[name]

    def _matched(self, state: str, detections: list[dict], free: set[int], now: int) -> list[tuple[int, int]]:
        costs = []
        for number in self._open(state):
            track = self.entries[f"t/{number}"]
            box = ahead(track, now)
            costs += [(d, number, i) for i in free if detections[i]["class_name"] == track["class"] and (d := 1 - overlap(box, detections[i]["box"])) < self.rules.distance]
        return pairs_by_cost(costs)

    def _seen(self, number: int, d: dict, now: int, step: int) -> dict:
        t = self.entries[f"t/{number}"]
        if now > t["seen"]:
            dt = (now - t["seen"]) / T.SECOND
            middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
            t["pace"] = [(old + (b - a) / dt) / 2 for old, a, b in zip(t["pace"], middle(t["box"]), middle(d["box"]), strict=True)]
        t["box"], t["seen"] = d["box"], now
        t["look"] = d["look"] or t["look"]
        t["credit"] = max(min(t["credit"] + 2 * step, self.rules.lost_us), self.rules.least_us)
        return t

    def take(self, row: dict[str, Any]) -> list[tuple]:
        now, detections = row["at_us"], row["detections"]
        if isinstance(detections, str):
            detections = json.loads(detections)
        last = self.entries.get("frame")
        if last is not None and now - last > self.rules.outage_us:
            self.entries.clear()
            last = None
        step = 0 if last is None else min(now - last, self.rules.longest_step_us)
        self.entries["frame"] = now
        self._aged(step)
        free, names = set(range(len(detections))), {}
        for number, i in self._matched("named", detections, free, now):
            self._seen(number, detections[i], now, step)
            names[i] = (self.entries[f"t/{number}"]["name"], False)
        free -= names.keys()
        earned = []
        for number, i in self._matched("young", detections, free, now):
            self._seen(number, detections[i], now, step)["state"] = "named"
            earned.append((number, i))
        free -= {i for _, i in earned}
        # those that earn a name now may be ones that were lost
        old = [(d, n, o) for n, _ in earned for o in self._open("lost") if self.entries[f"t/{o}"]["class"] == self.entries[f"t/{n}"]["class"] and (d := unlike(self.entries[f"t/{n}"]["look"], self.entries[f"t/{o}"]["look"])) < self.rules.appearance]
        again = dict(pairs_by_cost(old))
        for number, i in earned:
            track = self.entries[f"t/{number}"]
            if number in again:
                track["name"] = self.entries.pop(f"t/{again[number]}")["name"]
            names[i] = (track["name"], number in again)
        for i in sorted(free):
            d = detections[i]
            self.entries[f"t/{d['detection_id']}"] = {"state": "young", "name": d["detection_id"], "class": d["class_name"], "box": d["box"], "seen": now, "pace": [0.0, 0.0], "look": d["look"], "credit": max(step, self.rules.least_us)}
        return [(now, d["detection_id"], *names.get(i, (None, False))) for i, d in enumerate(detections)]


class Frames(Tracks):
    """The same over single detections: a frame is taken once its last one has come, so no row is as large as a frame."""

    def __init__(self, rules: Association):
        super().__init__(rules)
        self.waiting: list[dict] = []
        self.at = 0

    def take(self, row: dict[str, Any]) -> list[tuple]:
        look = row["look"]
        self.at = row["at_us"]
        self.waiting.append({"detection_id": row["detection_id"], "class_name": row["class_name"], "box": [float(x) for x in row["box"]], "look": None if look is None else [float(x) for x in look]})
        return []

    def expire(self, now: int) -> list[tuple]:
        if not self.waiting or now < self.at:
            return []
        frame, self.waiting = self.waiting, []
        return super().take({"at_us": self.at, "detections": frame})


def _frames(detections: DataFrame) -> DataFrame:
    look = F.col("embedding") if "embedding" in detections.columns else F.lit(None).cast("array<double>")
    one = F.struct("detection_id", "class_name", F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).alias("box"), look.cast("array<double>").alias("look"))
    return detections.select("camera_id", "at_us", one.alias("_d"))


def frames(detections: DataFrame) -> DataFrame:
    """camera_id, at_us, detections: each frame's detections as JSON in order of their numbers."""
    order = F.array_sort(F.collect_list("_d"), lambda a, b: (a["detection_id"] - b["detection_id"]).cast("int"))
    made = _frames(detections).groupBy("camera_id", "at_us").agg(order.alias("_all"))
    return made.select("camera_id", "at_us", F.to_json("_all", {"ignoreNullFields": "false"}).alias("detections"))


def associated(detections: DataFrame, rules: Association = Association()) -> DataFrame:
    """OUT rows, one for each row of `detections` (camera_id, at_us, detection_id, class_name, x1 .. y2, embedding if there).

    Rows that share camera and time are a frame; numbers are unique. track_id is null for a sighting without a name yet;
    regained marks the sighting by which a lost track's name came back. Matches go by the cheapest pair first,
    ties to the older track, then the smaller detection. A camera's frames are folded between outages.
    """
    rows = _frames(detections).select("camera_id", "at_us", "_d.*")
    return folded(rows, ["camera_id"], "at_us", "detection_id", lambda key, entries: Frames(rules), OUT, rules.outage_us)


def stream_associated(frame_rows: DataFrame, rules: Association = Association(), late: str = "10 seconds") -> DataFrame:
    """The same over a stream of whole frames: camera_id, at_us, detections as `frames` writes them."""
    return streamed(frame_rows.select("camera_id", "at_us", "detections"), ["camera_id"], "at_us", "at_us", lambda key, entries: Tracks(rules, entries), OUT, late)
