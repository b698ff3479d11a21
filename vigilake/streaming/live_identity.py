"""Who the people on screen are, while they are there: an ordered fold for tables and streams.

A face's verdict is final. A body's verdict holds until a face of a high score speaks, whether it agrees or not. What is
not final is asked again after a pause, against all samples of the track so far and the evidence known by then, so a
reference that is enrolled later names a track that is still on screen.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import blockwise
from .ordered import Fold, folded, streamed

KEYS = ["camera_id", "track_id"]
#: What the fold takes. kind is seen (the track is on screen), face (a sample with a score), near (a face near an identity) or body (a body near an anchor).
ROWS = "camera_id long, track_id long, at_us long, turn int, kind string, global_id string, name string, dist double, score double, until_us long"
OUT = "camera_id long, track_id long, at_us long, global_id string, name string, source string"


@dataclass(frozen=True)
class Rules:
    most: float = 0.45
    margin: float = 0.05
    body_margin: float = 0.05
    confident: float = 0.8
    retry_us: int = 2 * T.SECOND
    forgotten_us: int = 300 * T.SECOND
    horizon_us: int = 900 * T.SECOND


class Verdict(Fold):
    """Entries of a track: `held` (id, name, source), `tried`, `seen`, `faces` and `near/id`, `body/id`: what still counts."""

    def __init__(self, rules: Rules, entries: dict[str, Any] | None = None):
        super().__init__(entries)
        self.rules = rules

    def _add(self, entry: str, value: float, until: int, *more: Any) -> None:
        """Keeps what no other beats in both value (less is better) and time."""
        have = [x for x in self.entries.get(entry, []) if x[0] < value or x[1] > until]
        if not any(x[0] <= value and x[1] >= until for x in have):
            have.append([value, until, *more])
        self.entries[entry] = sorted(have)

    def _best(self, kind: str, now: int, margin: float) -> list | None:
        """[id, name, dist] of the nearest identity, where the next is far enough."""
        least = []
        for entry in [e for e in self.entries if e.startswith(kind)]:
            if open_ := [x for x in self.entries[entry] if x[1] > now]:
                self.entries[entry] = open_
                least.append((open_[0][0], entry[len(kind) :], open_[0][2]))
            else:
                del self.entries[entry]
        least.sort()
        if not least or (len(least) > 1 and least[1][0] - least[0][0] < margin):
            return None
        return [least[0][1], least[0][2], least[0][0]]

    def take(self, row: dict[str, Any]) -> list[tuple]:
        now, kind = row["at_us"], row["kind"]
        if kind == "face":
            self._add("faces", -(row["score"] or 0.0), row["until_us"])
        elif kind in ("near", "body"):
            self._add(f"{kind}/{row['global_id']}", row["dist"], row["until_us"], row["name"])
        if kind != "seen":
            return []
        if now - self.entries.get("seen", now) > self.rules.forgotten_us:
            for e in ("held", "tried"):
                self.entries.pop(e, None)
        self.entries["seen"] = now
        held = self.entries.get("held")
        if not (held and held[2] == "face") and now - self.entries.get("tried", now - self.rules.retry_us) >= self.rules.retry_us:
            self.entries["tried"] = now
            held = self._asked(held, now)
            if held:
                self.entries["held"] = held
        return [(now, *(held or (None, None, None)))]

    def _asked(self, held: list | None, now: int) -> list | None:
        face = self._best("near/", now, self.rules.margin)
        if face is not None and face[2] < self.rules.most:
            scores = [-s for s, until in self.entries.get("faces", []) if until > now]
            if held is None or max(scores, default=0.0) >= self.rules.confident:
                return [face[0], face[1], "face"]
        if held is not None:
            return held
        body = self._best("body/", now, self.rules.body_margin)
        return body and [body[0], body[1], "body"]


def _row(kind: str, df: DataFrame, **more) -> DataFrame:
    """`df` in the columns of ROWS; at one moment what is seen comes after what is known."""
    own = {"turn": F.lit(1 if kind == "seen" else 0), "kind": F.lit(kind)} | more
    fields = [f.rsplit(" ", 1) for f in ROWS.split(", ")]
    return df.select(*((own[n] if n in own else F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))


def evidence_rows(seen: DataFrame, faces: DataFrame, references: DataFrame, body: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """ROWS from the tables.

    `seen` (camera_id, track_id, at_us). `faces` (camera_id, track_id, at_us, embedding, model, score): a sample counts
    for the horizon. `references` (global_id, name, embedding, model, valid_us): one with valid_us counts from then on.
    Vectors compare within one model; a null model, a null vector or a reference without a name never compares. `body`
    (camera_id, track_id, at_us, global_id, name, dist): anchors within their thresholds. Rows without camera, track or
    time are left out.
    """
    whole = lambda df: df.filter(F.col("camera_id").isNotNull() & F.col("track_id").isNotNull() & F.col("at_us").isNotNull())
    samples = whole(faces).filter(F.col("embedding").isNotNull() & F.col("model").isNotNull())
    until = F.col("at_us") + rules.horizon_us
    known = references.filter(F.col("embedding").isNotNull() & F.col("global_id").isNotNull() & F.col("name").isNotNull())
    vector = F.col("embedding").cast("array<double>").alias("_v")
    begin = F.coalesce("valid_us", F.lit(0)).cast("long")
    several = known.groupBy("global_id").agg((F.min("name") < F.max("name")).alias("_several"))  # their names go by moment, whatever the distance
    one = F.struct("global_id", "name", F.when(F.col("_several"), begin).alias("moment"))
    r = known.join(several, "global_id").select("model", one.alias("_c"), begin.alias("_from"), vector).distinct()
    # a farther identity is no rival of one that is near enough; a reference that comes no sooner and is farther than another adds nothing
    most = rules.most + rules.margin
    met = blockwise.dealt(samples.select(*KEYS, F.col("at_us").alias("_at"), "model", vector).distinct(), r, ["model"], lambda p, q, names: blockwise.records(p, q, names, most))
    pairs = met.select(*KEYS, F.greatest("_at", "_from").alias("at_us"), "_c.global_id", "_c.name", "dist", (F.col("_at") + rules.horizon_us).alias("until_us")).filter(F.col("at_us") < F.col("until_us"))
    near = pairs.groupBy(*KEYS, "at_us", "global_id", "until_us").agg(F.min("dist").alias("dist"), F.min("name").alias("name"))
    sooner = F.min("dist").over(Window.partitionBy(*KEYS, "until_us", "global_id").orderBy("at_us").rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("_sooner", sooner).filter("_sooner IS NULL OR dist <= _sooner").drop("_sooner")
    rows = _row("seen", whole(seen)).unionByName(_row("face", samples, until_us=until)).unionByName(_row("near", near))
    return rows if body is None else rows.unionByName(_row("body", whole(body).filter("dist IS NOT NULL AND global_id IS NOT NULL"), until_us=until))


def verdicts(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """OUT rows, one for each moment a track is seen: its identity then and by what, null while unknown.

    Of identities as near the smaller id is first, and is none where a margin is asked. A track not seen for forgotten_us begins anew.
    Repeated rows change nothing but give their own output rows.
    """
    return folded(rows, KEYS, "at_us", "turn", lambda key, entries: Verdict(rules, entries), OUT, max(rules.horizon_us, rules.forgotten_us))


def stream_verdicts(rows: DataFrame, rules: Rules = Rules(), late: str = "10 seconds") -> DataFrame:
    """The same over a stream of ROWS."""
    return streamed(rows, KEYS, "at_us", "turn", lambda key, entries: Verdict(rules, entries), OUT, late)


def on_screen(found: DataFrame) -> DataFrame:
    """camera_id, at_us, global_id, name, source: each named person once a moment, by a face where any track has it."""
    first = F.min(F.struct(F.when(F.col("source") == "face", 0).otherwise(1).alias("n"), "source", "name")).alias("_f")
    return found.filter(F.col("global_id").isNotNull()).groupBy("camera_id", "at_us", "global_id").agg(first).select("camera_id", "at_us", "global_id", "_f.name", "_f.source")
