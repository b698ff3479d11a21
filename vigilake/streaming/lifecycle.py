"""The life of tracks over a camera's messages: visits, zones, rest and departure, continuation, end.

One fold serves tables and streams (`ordered`): a stream gives the rows of the table however it is cut.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Fold, folded, streamed

OUT = "camera_id long, epoch long, track_id int, kind string, zone string, at_us long, started_us long, ended_us long, n int, class_id int, came_to_rest boolean"
MESSAGE = "camera_id long, sequence long, timestamp_us long, epoch long, frame_width int, frame_height int, tracks string"
#: Classes that count as vehicles, and the share of a frame that is its edge.
VEHICLES, EDGE = (1, 2, 3, 5, 7), 0.015


@dataclass(frozen=True)
class Zone:
    """A polygon with the time a track must stay before it has entered, and who may enter."""

    name: str
    polygon: tuple[tuple[float, float], ...]
    min_dwell_us: int = 0
    moving_only: bool = False
    classes: tuple[int, ...] | None = None
    min_confidence: float = 0.0

    def holds(self, x: float, y: float) -> bool:
        inside = False
        for (ax, ay), (bx, by) in zip(self.polygon, self.polygon[-1:] + self.polygon[:-1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
        return inside

    def admits(self, x: dict) -> bool:
        allowed = self.classes is None or x["class_id"] in self.classes
        return allowed and (x.get("confidence") is None or x["confidence"] >= self.min_confidence) and self.holds((x["x1"] + x["x2"]) / 2, x["y2"])


@dataclass(frozen=True)
class Rules:
    """Thresholds of the life of a track, in microseconds."""

    zones: dict[int, tuple[Zone, ...]] = field(default_factory=dict)
    dwell_us: int = 30_000_000
    cooldown_us: int = 0
    silence_us: int = 5_000_000
    back_date_us: int = 60_000_000


def _at_edge(x: dict, message: dict) -> bool:
    w, h = message.get("frame_width") or 0, message.get("frame_height") or 0
    return w > 0 and h > 0 and (x["x1"] <= w * EDGE or x["x2"] >= w * (1 - EDGE) or x["y2"] >= h * (1 - EDGE))


class Camera(Fold):
    """Records (`k/track`), the generation (`epoch`) and when a zone last spoke (`z/zone|class|kind`) of one camera."""

    def __init__(self, rules: Rules, camera: int, entries: dict[str, Any] | None = None):
        super().__init__(entries)
        self.rules, self.camera = rules, camera

    def records(self) -> list[str]:
        return sorted((n for n in self.entries if n[0] == "k"), key=lambda n: int(n[2:]))

    def row(self, name: str, kind: str, at: int, zone: str | None = None) -> tuple:
        r = self.entries[name]
        most = max(r["classes"], key=lambda c: (r["classes"][c], -r["order"].index(c)))
        return (self.entries["epoch"], int(name[2:]), kind, zone, at, r["started"], r["evidence"], r["n"], int(most), r["rested"])

    def finish(self, name: str) -> list[tuple]:
        """A record's end: it leaves its zones; its visit is filed unless its rest filed it."""
        r = self.entries[name]
        out = [self.row(name, "zone_exit", r["evidence"], z) for z, own in sorted(r["zones"].items()) if own["entered"]]
        if not r["filed"]:
            out.append(self.row(name, "finalized", r["evidence"]))
        del self.entries[name]
        return out

    def take(self, row: dict[str, Any]) -> list[tuple]:
        at, epoch, out = row["timestamp_us"], row["epoch"], []
        now = self.entries.get("epoch")
        if now is not None and epoch < now:
            return out  # a message of a retired generation
        if now is not None and now != epoch:
            for name in self.records():
                out += self.finish(name)
        self.entries["epoch"] = epoch
        for x in json.loads(row["tracks"] or "[]"):
            out += self.observe(at, x, row)
        return out

    def expire(self, now: int) -> list[tuple]:
        out: list[tuple] = []
        for seen, name in sorted((self.entries[n]["seen"], n) for n in self.records()):
            if seen + self.rules.silence_us <= now:
                out += self.finish(name)
        for name in [n for n in self.entries if n[0] == "z" and now - self.entries[n] >= self.rules.cooldown_us]:
            del self.entries[name]
        return out

    def due(self) -> int | None:
        return min((self.entries[n]["seen"] + self.rules.silence_us for n in self.records()), default=None)

    def begin(self, at: int, first: int | None) -> dict:
        return {"started": max(min(first or at, at), at - self.rules.back_date_us), "n": 0, "classes": {}, "order": [], "zones": {}, "rested": False, "moved": False, "motion": "active", "told": False, "filed": False, "seen": at, "evidence": at}

    def observe(self, at: int, x: dict, message: dict) -> list[tuple]:
        name, old = f"k/{x['track_id']}", f"k/{x.get('continues_track_id')}"
        if old != name and old in self.entries:
            inherited, young = self.entries.pop(old), self.entries.pop(name, None)
            if young:  # a record of its own that just began is absorbed
                inherited["n"] += young["n"]
                for c in young["order"]:
                    inherited["classes"][c] = inherited["classes"].get(c, 0) + young["classes"][c]
                    if c not in inherited["order"]:
                        inherited["order"].append(c)
                for zone, own in young["zones"].items():
                    inherited["zones"].setdefault(zone, own)
            self.entries[name] = inherited
        if name not in self.entries:
            self.entries[name] = self.begin(at, x.get("first_seen_us"))
        r, cls = self.entries[name], str(x["class_id"])
        if r["filed"] and (x.get("motion_state") or "active") == "active":  # a departure is a new visit
            fresh = self.begin(at, None)
            r = self.entries[name] = fresh | {c: r[c] for c in ("zones", "moved", "motion", "told")}
        r["n"] += 1
        r["classes"][cls] = r["classes"].get(cls, 0) + 1
        if cls not in r["order"]:
            r["order"].append(cls)
        r["seen"], r["evidence"] = at, max(r["evidence"], min(at, x.get("last_matched_us") or at))
        return self.rest(at, name, x, message) + self.zones(at, name, x)

    def rest(self, at: int, name: str, x: dict, message: dict) -> list[tuple]:
        """parked once a rest, unparked on the way out; what never moved does not arrive, what is cut by the frame's edge not until it is parked."""
        r, motion, before = self.entries[name], x.get("motion_state") or "active", self.entries[name]["motion"]
        resting, r["motion"] = motion != "active", motion
        r["moved"] |= not resting or bool(x.get("ever_moved"))
        r["rested"] |= resting
        stops = resting and before == "active" and not _at_edge(x, message)
        told, r["told"] = r["told"], r["told"] and resting
        if r["moved"] and (stops or (motion == "parked" and not told)):
            r["told"], out = True, [self.row(name, "parked", at)]
            if x["class_id"] in VEHICLES and not r["filed"]:
                r["filed"] = True
                out.append(self.row(name, "finalized", r["evidence"]))
            return out
        return [self.row(name, "unparked", at)] if before != "active" and not resting else []

    def zones(self, at: int, name: str, x: dict) -> list[tuple]:
        r, out = self.entries[name], []
        for zone in self.rules.zones.get(self.camera, ()):
            if zone.moving_only and x["class_id"] != 0 and r["motion"] != "active":
                continue
            inside, own = zone.admits(x), r["zones"].get(zone.name)
            if inside and own is None:
                own = r["zones"][zone.name] = {"since": at, "entered": False, "dwelt": False}
            if inside and not own["entered"] and at - own["since"] >= zone.min_dwell_us:
                own["entered"] = True
                out += self.speak(at, name, "zone_enter", zone.name)
            if inside and own["entered"] and not own["dwelt"] and at - own["since"] >= self.rules.dwell_us:
                own["dwelt"] = True
                out += self.speak(at, name, "zone_dwell", zone.name)
            if not inside and own is not None:
                if own["entered"]:
                    out += self.speak(at, name, "zone_exit", zone.name)
                del r["zones"][zone.name]
        return out

    def speak(self, at: int, name: str, kind: str, zone: str) -> list[tuple]:
        """An event, unless one of its zone, class and kind came within the cooldown."""
        row = self.row(name, kind, at, zone)
        place = f"z/{zone}|{row[8]}|{kind}"
        last = self.entries.get(place)
        if self.rules.cooldown_us and last is not None and at - last < self.rules.cooldown_us:
            return []
        if self.rules.cooldown_us:
            self.entries[place] = at
        return [row]


def _prepared(messages: DataFrame) -> DataFrame:
    """Messages with tracks as JSON; `tracks` may be an array of structs or JSON already."""
    tracks = F.col("tracks") if dict(messages.dtypes)["tracks"] == "string" else F.to_json("tracks")
    size = [F.col(c) if c in messages.columns else F.lit(None).cast("int").alias(c) for c in ("frame_width", "frame_height")]
    return messages.select("camera_id", "sequence", "timestamp_us", "epoch", *size, tracks.alias("tracks"))


def _maker(rules: Rules):
    return lambda key, entries: Camera(rules, key["camera_id"], entries)


def transitions(messages: DataFrame, rules: Rules) -> DataFrame:
    """OUT rows of all messages of each camera in order of (timestamp_us, sequence); silence ends what is still open.

    Messages of a generation older than one seen before are left out. A camera's messages are folded between
    pauses that no record and no cooldown survives.
    """
    seen = F.max("epoch").over(Window.partitionBy("camera_id").orderBy("timestamp_us", "sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    current = _prepared(messages).withColumn("_newest", seen).filter(F.col("epoch") == F.col("_newest")).drop("_newest")
    return folded(current, ["camera_id"], "timestamp_us", "sequence", _maker(rules), OUT, max(rules.silence_us, rules.cooldown_us))


def stream_transitions(messages: DataFrame, rules: Rules, late: str = "10 seconds") -> DataFrame:
    """The same rows over a stream; the watermark ends the tracks of a silent camera."""
    return streamed(_prepared(messages), ["camera_id"], "timestamp_us", "sequence", _maker(rules), OUT, late)


def finished(rows: DataFrame) -> DataFrame:
    """The visits of `transitions`: one row per finalized record."""
    return rows.filter(F.col("kind") == "finalized").select("camera_id", "epoch", "track_id", "started_us", "ended_us", "n", "class_id", "came_to_rest")
