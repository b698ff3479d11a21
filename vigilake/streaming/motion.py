"""The motion of tracks: active, stationary, parked, and spots that remember what stood there.

A track becomes stationary when it has lived for a whole window and its centres, but for one stray
point, stay within a radius relative to its box; parked after it has been so for a time. It is
active again when several sightings in a row lie far from the window's median. Each still
sighting refreshes a spot of the track's class and box; a new track that overlaps a living spot
starts parked and carries on the spot's clock, so a detector that loses a standing object does
not announce it again. A move clears every spot there. Whether anything ever travelled to a place is
handed on through its spots too, but only travel of one's own renews that knowledge.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import OrderedDict
from collections.abc import Mapping
from dataclasses import dataclass
from math import floor, frexp, hypot, inf
from typing import Any

from pyspark.sql import DataFrame

from ..functions import times as T
from .ordered import Fold, folded, streamed

ACTIVE, STATIONARY, PARKED = "active", "stationary", "parked"
OUT = "camera_id long, at_us long, detection_id long, track_id long, motion_state string, since_us long, moved boolean, arrived boolean, on_static_spot boolean"

#: Cells of spots in a power of two that is no less than their width or height; a share of overlap that rounding never reaches.
CELLS, ROUNDING = 16, 1e-9


@dataclass(frozen=True)
class Motion:
    """Lives of spots and of what they know, overlap of a spot, sightings of a departure, travel in box diagonals, lost tracks. The rest is a camera's setting."""

    still_share: float = 0.1
    still_least: float = 3.0
    window_us: int = 8 * T.SECOND
    park_us: int = 300 * T.SECOND
    spot_us: int = 7200 * T.SECOND
    moved_us: int = 7200 * T.SECOND
    lost_us: int = 60 * T.SECOND
    overlap: float = 0.5
    departures: int = 3
    moved_share: float = 1.0
    arrived_share: float = 0.35

    @property
    def pause_us(self) -> int:
        """No state outlives a camera's silence of this length."""
        return max(self.spot_us, self.moved_us, self.lost_us)


def overlap(a: list[float], b: list[float]) -> float:
    """Intersection over union of two boxes; 0 where they do not meet."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / both if both > 0 else 0.0


def spread_of(points: list[list[float]], median: tuple[float, float]) -> float:
    """Diagonal of the points' extent; of five or more, without the one farthest from the median where that is less."""

    def diagonal(own: list[list[float]]) -> float:
        return hypot(max(x for _, x, _ in own) - min(x for _, x, _ in own), max(y for *_, y in own) - min(y for *_, y in own))

    if len(points) < 5:
        return diagonal(points)
    stray = max(range(len(points)), key=lambda i: (points[i][1] - median[0]) ** 2 + (points[i][2] - median[1]) ** 2)
    return min(diagonal(points), diagonal(points[:stray] + points[stray + 1 :]))


def still(points: list[list[float]], xs: list[float], ys: list[float], median: tuple[float, float], radius: float) -> bool:
    """True where `spread_of` is no more than the radius; points are gone through only where leaving one out may decide."""
    if hypot(xs[-1] - xs[0], ys[-1] - ys[0]) <= radius:
        return True
    if len(points) < 5 or hypot(min(xs[-2] - xs[0], xs[-1] - xs[1]), min(ys[-2] - ys[0], ys[-1] - ys[1])) > radius * (1 + ROUNDING):
        return False
    return spread_of(points, median) <= radius


def _place(kind: str, box: list[float]) -> tuple:
    """Class and width's power of two, the place, and the cell there: coordinates in sixteenths of the width's and height's powers.

    A place is wider than the spots in it. Without a finite extent there is no cell, or no place either.
    """
    width, height = box[2] - box[0], box[3] - box[1]
    if not 0 < width < inf:
        return (kind, None), 0, None
    level = frexp(width)[1]
    key, c = (kind, level), floor((box[0] + box[2]) / 2 / 2.0**level)
    if not 0 < height < inf:
        return key, c, None
    x, y = 2.0**level / CELLS, 2.0 ** (tall := frexp(height)[1]) / CELLS
    return key, c, (tall, floor(box[0] / x), floor(box[2] / x), floor(box[1] / y), floor(box[3] / y))


def _bounds(level: int | None, cell: tuple | None) -> tuple | None:
    """Least and greatest x1, x2, y1 and y2 of a cell's boxes, and of their areas."""
    if cell is None:
        return None
    x, y = 2.0**level / CELLS, 2.0 ** cell[0] / CELLS
    a, b, c, d = cell[1] * x, cell[2] * x, cell[3] * y, cell[4] * y
    return a, a + x, b, b + x, c, c + y, d, d + y, max(0.0, b - a - x) * max(0.0, d - c - y), (b + x - a) * (d + y - c)


class Scene(Fold):
    """Tracks (`t/id`) and spots (`s/id` of the track that left them) of one camera.

    Beside the entries: names of each kind by when they were last seen, a window's coordinates in order, and spots by class, width and place, and there in
    cells of nearly equal boxes, the oldest first. Of most cells all or no boxes fit a row's box, which the cell's bounds
    tell, so a row looks at few spots however many there are.
    """

    def __init__(self, rules: Motion, entries: dict[str, Any] | None = None):
        super().__init__(entries)
        self.rules = rules
        self.order: dict[str, OrderedDict[str, None]] = {"t": OrderedDict(), "s": OrderedDict()}
        self.places: dict[tuple, dict[int, dict[tuple | None, list]]] = {}
        self.where: dict[str, tuple] = {}
        self.ascending: dict[str, tuple[list[float], list[float]]] = {}
        for n in sorted(self.entries, key=lambda n: self.entries[n]["seen"]):
            self.order[n[0]][n] = None
            if n[0] == "s":
                self._placed(n, _place(self.entries[n]["class"], self.entries[n]["box"]))

    def _touched(self, name: str) -> None:
        self.order[name[0]].pop(name, None)
        self.order[name[0]][name] = None

    def _placed(self, name: str, place: tuple) -> None:
        self.where[name] = key, c, cell = place
        cells = self.places.setdefault(key, {}).setdefault(c, {})
        if cell not in cells:
            cells[cell] = [_bounds(key[1], cell), []]
        insort(cells[cell][1], (self.entries[name]["first"], name))

    def _unplaced(self, name: str) -> None:
        key, c, cell = self.where.pop(name)
        own = (cells := (at := self.places[key])[c])[cell][1]
        del own[bisect_left(own, (self.entries[name]["first"], name))]
        if not own:
            del cells[cell]
        if not cells:
            del at[c]
        if not at:
            del self.places[key]

    def _gone(self, name: str) -> None:
        if name[0] == "s":
            self._unplaced(name)
        self.ascending.pop(name, None)
        del self.entries[name], self.order[name[0]][name]

    def _lists(self, kind: str, box: list[float]) -> list[dict]:
        """The cells of spots that can overlap the box enough: widths differ no more than by the overlap asked, and centres by their mean."""
        least, width = self.rules.overlap, box[2] - box[0]
        if least <= 0 or not 0 < width < inf:
            return [own for key, at in self.places.items() if key[0] == kind for own in at.values()] if least <= 0 else []
        out, middle = [], (box[0] + box[2]) / 2
        for level in range(frexp(width * least)[1] - 1, frexp(width / least)[1] + 2):
            if at := self.places.get((kind, level)):
                cell = 2.0**level
                reach = (width + cell) / 2
                out += [own for c in range(floor((middle - reach) / cell), floor((middle + reach) / cell) + 1) if (own := at.get(c))]
        return out

    def _cells(self, kind: str, box: list[float]) -> tuple[list[list], list[list]]:
        """Spots in cells whose boxes all overlap the box enough, and those in cells where each has to be measured."""
        sure, open_ = [], []
        least, (x1, y1, x2, y2) = self.rules.overlap, box
        low, high, area = least - ROUNDING, least + ROUNDING, (x2 - x1) * (y2 - y1)
        for cells in self._lists(kind, box):
            for bounds, spots in cells.values():
                if bounds is None or least <= 0:
                    open_.append(spots)
                    continue
                a, a_in, b_in, b, c, c_in, d_in, d, smallest, largest = bounds
                w, h = (x2 if x2 < b else b) - (x1 if x1 > a else a), (y2 if y2 < d else d) - (y1 if y1 > c else c)
                if w <= 0 or h <= 0 or w * h < low * (area + smallest - w * h):
                    continue
                w, h = (x2 if x2 < b_in else b_in) - (x1 if x1 > a_in else a_in), (y2 if y2 < d_in else d_in) - (y1 if y1 > c_in else c_in)
                (sure if w > 0 and h > 0 and w * h >= high * (area + largest - w * h) else open_).append(spots)
        return sure, open_

    def _lives(self, name: str, now: int) -> bool:
        return now - self.entries[name]["seen"] <= self.rules.spot_us

    def _fits(self, name: str, box: list[float], now: int) -> bool:
        return self._lives(name, now) and overlap(box, self.entries[name]["box"]) >= self.rules.overlap

    def _spots(self, kind: str, box: list[float], now: int) -> list[str]:
        """Names of the living spots of that class under the box."""
        sure, open_ = self._cells(kind, box)
        return [n for own in sure for _, n in own if self._lives(n, now)] + [n for own in open_ for _, n in own if self._fits(n, box, now)]

    def _oldest(self, kind: str, box: list[float], now: int) -> str | None:
        """The oldest of them; what is measured has to be older than what is sure."""
        sure, open_ = self._cells(kind, box)
        oldest = None
        for own in sure:
            for x in own:
                if oldest is not None and x >= oldest:
                    break
                if self._lives(x[1], now):
                    oldest = x
                    break
        for own in open_:
            for x in own:
                if oldest is not None and x >= oldest:
                    break
                if self._fits(x[1], box, now):
                    oldest = x
                    break
        return oldest[1] if oldest else None

    def _knows_travel(self, spot: dict | None, now: int) -> bool:
        return bool(spot and spot["travelled"] and now - spot["travelled"] < self.rules.moved_us)

    def _left(self, name: str, track: dict, row: dict, box: list[float]) -> None:
        """A still sighting refreshes the spot of its track."""
        at, old = row["at_us"], self.entries.get("s" + name[1:])
        first = old["first"] if old else [at, row["detection_id"]]
        own, place = "s" + name[1:], _place(row["class_name"], box)
        stays = bool(old) and self.where[own] == place
        if old and not stays:
            self._unplaced(own)
        self.entries[own] = {"class": row["class_name"], "box": box, "since": track["since"], "seen": at, "travelled": track["travelled"], "first": first}
        if not stays:
            self._placed(own, place)
        self._touched(own)

    def _began(self, row: dict, box: list[float], x: float, y: float, spot: dict | None) -> dict:
        at, known = row["at_us"], self._knows_travel(spot, row["at_us"])
        return {
            "state": PARKED if spot else ACTIVE, "since": spot["since"] if spot else at, "born": at, "seen": at, "away": 0, "points": [[at, x, y]], "reach": [x, y, x, y],
            "moved": known, "arrived": known, "travelled": spot["travelled"] if spot else 0,
        }

    def _window(self, name: str, track: dict, at: int, x: float, y: float) -> tuple[list, list[float], list[float]]:
        """The track's points with the new one, without those before the window, and their x and y in ascending order."""
        points = track["points"]
        xs, ys = self.ascending.get(name) or self.ascending.setdefault(name, (sorted(p[1] for p in points), sorted(p[2] for p in points)))
        points.append([at, x, y])
        insort(xs, x)
        insort(ys, y)
        if len(points) > 2:  # two points stay, however old
            old = bisect_left(points, [at - self.rules.window_us])
            for _, past_x, past_y in points[:old]:
                del xs[bisect_left(xs, past_x)], ys[bisect_left(ys, past_y)]
            del points[:old]
        return points, xs, ys

    def _advanced(self, name: str, track: dict, row: dict, box: list[float], x: float, y: float) -> bool:
        """Take the sighting into the track; true where it leaves a stillness."""
        rules, at, size = self.rules, row["at_us"], hypot(box[2] - box[0], box[3] - box[1])
        track["seen"] = at
        a, b, c, d = track["reach"]
        track["reach"] = reach = [x if x < a else a, y if y < b else b, x if x > c else c, y if y > d else d]
        way = hypot(reach[2] - reach[0], reach[3] - reach[1])
        track["arrived"] |= way >= rules.arrived_share * size
        if way >= rules.moved_share * size:
            track["moved"], track["travelled"] = True, at
        points, xs, ys = self._window(name, track, at, x, y)
        median = xs[len(xs) // 2], ys[len(ys) // 2]
        radius = max(rules.still_least, rules.still_share * size)
        track["away"] = track["away"] + 1 if hypot(x - median[0], y - median[1]) > 2 * radius else 0
        grown = at - track["born"] >= rules.window_us
        leaves = grown and track["away"] >= rules.departures
        if track["state"] == ACTIVE:
            if grown and still(points, xs, ys, median, radius):
                track["state"], track["since"] = STATIONARY, at
        elif leaves:
            track["state"], track["since"] = ACTIVE, at
            return True
        elif track["state"] == STATIONARY and at - track["since"] >= rules.park_us:
            track["state"] = PARKED  # the clock goes on: it counts stillness
        return False

    def take(self, row: dict[str, Any]) -> list[tuple]:
        at, name = row["at_us"], f"t/{row['track_id']}"
        box = [float(row[c]) for c in ("x1", "y1", "x2", "y2")]
        x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
        under = self._oldest(row["class_name"], box, at)
        spot = self.entries[under] if under else None
        static = spot is not None and not self._knows_travel(spot, at)
        track = self.entries.get(name)
        if row.get("coasted"):  # a predicted box says nothing about movement
            shown = track or {"state": ACTIVE, "since": 0, "moved": False, "arrived": False}
        else:
            if track is None:
                self.entries[name] = shown = self._began(row, box, x, y, spot)
            else:
                shown = track
                if self._advanced(name, track, row, box, x, y):
                    for gone in {*self._spots(row["class_name"], box, at), "s" + name[1:]}:
                        if gone in self.entries:
                            self._gone(gone)
            self._touched(name)
            if shown["state"] != ACTIVE:
                self._left(name, shown, row, box)
        return [(at, row["detection_id"], row["track_id"], shown["state"], shown["since"], shown["moved"], shown["arrived"], static)]

    def expire(self, now: int) -> list[tuple]:
        """Lost tracks and old spots go; nothing is said."""
        after = now + 1  # the next row's time at the earliest
        for kind, life in (("t", self.rules.lost_us), ("s", self.rules.spot_us)):
            own = self.order[kind]
            while own and after - self.entries[first := next(iter(own))]["seen"] > life:
                self._gone(first)
        return []

    def due(self) -> int | None:
        return min((e["seen"] + (self.rules.lost_us if n[0] == "t" else self.rules.spot_us) for n, e in self.entries.items()), default=None)


def _maker(rules: Motion, own: Mapping[int, Motion] | None):
    chosen = dict(own or {})
    return lambda key, entries: Scene(chosen.get(key["camera_id"], rules), entries)


def motion_states(detections: DataFrame, rules: Motion = Motion(), own: Mapping[int, Motion] | None = None) -> DataFrame:
    """OUT rows, one for every row of `detections` (camera_id, at_us, detection_id, track_id, class_name, x1, y1, x2, y2, and coasted if there).

    Rows of a camera go in order of (at_us, detection_id), which has to be unique. `own` has the rules of single
    cameras, with lives of spots no longer than those of `rules`. A row that `coasted` repeats its track's state without
    changing it. `on_static_spot`: the box lies on a spot to which nothing is known to have travelled.
    """
    return folded(_columns(detections), ["camera_id"], "at_us", "detection_id", _maker(rules, own), OUT, rules.pause_us)


def stream_motion_states(detections: DataFrame, rules: Motion = Motion(), own: Mapping[int, Motion] | None = None, late: str = "10 seconds") -> DataFrame:
    """The same rows over a stream, whatever its batches."""
    return streamed(_columns(detections), ["camera_id"], "at_us", "detection_id", _maker(rules, own), OUT, late)


def _columns(detections: DataFrame) -> DataFrame:
    names = ["camera_id", "at_us", "detection_id", "track_id", "class_name", "x1", "y1", "x2", "y2"]
    return detections.select(*names, *(["coasted"] if "coasted" in detections.columns else []))
