"""Registered queries: a detector's frames, the tracker's publication gates and movement, live states, the embedder's cadence, face landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import faces
from ..operators import detection, telemetry, tracking
from ..sources import tables
from ..streaming import association, birth_spots as births, motion
from .catalog import ORACLES, H, query
from .logical import Lake, sql


@query("birth_gate", """SELECT event_id, track_id FROM (SELECT event_id, track_id, bool_or(value > 90) OVER (PARTITION BY track_id ORDER BY at_us, event_id) AS born FROM ev) WHERE born""")
def birth_gate(t: Lake) -> DataFrame:
    return tracking.born(t.events(), ["track_id"], "at_us", "event_id", F.col("value") > 90).select("event_id", "track_id")


@query("held_boxes", f"""p AS (SELECT event_id, track_id, at_us, value, kind = 'error' AS a, lag(kind = 'error') OVER w AS la, lag(at_us) OVER w AS lt FROM ev WINDOW w AS (PARTITION BY track_id ORDER BY at_us, event_id)),
    r AS (SELECT *, sum(CASE WHEN a OR la IS NULL OR la OR at_us - lt > {12 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY at_us, event_id) AS run FROM p)
    SELECT event_id, max(value) OVER w AS held_confidence, arg_max(event_id, value) OVER w % 101 AS held_x FROM r WINDOW w AS (PARTITION BY track_id, run ORDER BY at_us, event_id)""")
def held_boxes(t: Lake) -> DataFrame:
    e = t.events().select("event_id", "track_id", "at_us", F.col("value").alias("confidence"), F.when(F.col("kind") == "error", "active").otherwise("parked").alias("motion_state"), F.struct((F.col("event_id") % 101).alias("x")).alias("box"))
    return tracking.held_boxes(e, ["track_id"], "at_us", "event_id", 12 * H).select("event_id", "held_confidence", F.col("held_box.x").alias("held_x"))


@query("embed_cadence")
def embed_cadence(t: Lake) -> DataFrame:
    e = t.events().select("event_id", "track_id", "at_us", (F.col("value") / 100).alias("confidence"), F.when(F.col("kind") == "click", "active").alias("motion_state"))
    return tracking.due_for_embedding(e, ["track_id"], "at_us", "event_id", 0.30, H, 12 * H).select("event_id", "track_id", "at_us")


def _landmarks_sql() -> str:
    at = [(f"({u} + (e * {3 + i} % 61 - 30) * s)", f"({v} + (e * {7 + 2 * i} % 53 - 26) * s)") for i, (u, v) in enumerate(faces.TEMPLATE)]
    return ", ".join(f"{x} AS x{i}, {y} AS y{i}" for i, (x, y) in enumerate(at))


def _residual_sql() -> tuple[str, str]:
    """The fitted points against the template, written out."""
    t, r = faces.TEMPLATE, range(5)
    cu, cv = sum(u for u, _ in t) / 5, sum(v for _, v in t) / 5
    plus = " + ".join
    centred = f"c AS (SELECT *, ({plus(f'x{i}' for i in r)}) / 5 AS mx, ({plus(f'y{i}' for i in r)}) / 5 AS my FROM q)"
    a = plus(f"(x{i} - mx) * {t[i][0] - cu} + (y{i} - my) * {t[i][1] - cv}" for i in r)
    b = plus(f"(x{i} - mx) * {t[i][1] - cv} - (y{i} - my) * {t[i][0] - cu}" for i in r)
    z = plus(f"(x{i} - mx) ** 2 + (y{i} - my) ** 2" for i in r)
    fit = f"f AS (SELECT *, ({a}) / ({z}) AS a, ({b}) / ({z}) AS b FROM c)"
    gap = plus(f"(a * (x{i} - mx) - b * (y{i} - my) - ({t[i][0] - cu})) ** 2 + (b * (x{i} - mx) + a * (y{i} - my) - ({t[i][1] - cv})) ** 2" for i in r)
    eyes = ((t[1][0] - t[0][0]) ** 2 + (t[1][1] - t[0][1]) ** 2) ** 0.5
    return f"{centred}, {fit}", f"sqrt(({gap}) / 5) / {eyes}"


_FIT, _GAP = _residual_sql()


@query("frontality", f"""q AS (SELECT event_id, {_landmarks_sql()} FROM (SELECT event_id, CAST(event_id AS DOUBLE) AS e, CAST(event_id % 4 AS DOUBLE) / 4 AS s FROM ev)), {_FIT}
    SELECT event_id, round({_GAP}, 6) AS residual, x0 < x1 AND x3 < x4 AND (y0 + y1) / 2 < y2 AND y2 < (y3 + y4) / 2 AND x1 - x0 BETWEEN 15 AND 95 AND x2 BETWEEN x0 - 0.5 * (x1 - x0) AND x1 + 0.5 * (x1 - x0) AND (y3 + y4) / 2 - (y0 + y1) / 2 BETWEEN 18 AND 114 AS plausible FROM f""")
def frontality(t: Lake) -> DataFrame:
    e, s = F.col("event_id").cast("double"), (F.col("event_id") % 4).cast("double") / 4
    points = F.array(*(F.struct((F.lit(u) + (e * (3 + i) % 61 - 30) * s).alias("x"), (F.lit(v) + (e * (7 + 2 * i) % 53 - 26) * s).alias("y")) for i, (u, v) in enumerate(faces.TEMPLATE)))
    box = F.struct(*(F.lit(float(c)).alias(n) for c, n in ((0, "x1"), (0, "y1"), (100, "x2"), (120, "y2"))))
    return t.events().select("event_id", F.round(faces.residual(points), 6).alias("residual"), faces.plausible(points, box).alias("plausible"))


def _clash_sql(h: str, b: str) -> str:
    side = lambda k: f"greatest(0.0, least({h}.{k}2, {b}.{k}2) - greatest({h}.{k}1, {b}.{k}1))"
    area = lambda n: f"({n}.x2 - {n}.x1) * ({n}.y2 - {n}.y1)"
    group = lambda n: f"CASE WHEN {n}.c IN (2, 3, 5, 7) THEN -1 ELSE {n}.c END"
    both = f"{side('x')} * {side('y')}"
    share = f"CASE WHEN {area(h)} + {area(b)} - {both} > 0 THEN {both} / ({area(h)} + {area(b)} - {both}) ELSE 0 END"
    within = f"CASE WHEN {area(b)} > 0 THEN {both} / ({area(b)}) ELSE 0 END"
    same = f"{group(h)} = {group(b)}"
    return f"({share} >= 0.8 OR ({same} AND {share} >= 0.55) OR ({same} AND {b}.clipped AND {within} >= 0.7))"


_KEPT = f"list_reduce(bs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda h: {_clash_sql('h', 'x[1]')})) > 0 THEN acc ELSE acc || x END)"


def _frames_sql(cls: str, clipped: str) -> str:
    return f"""b AS (SELECT sample_id AS id, track_id, camera_id, confidence::DOUBLE AS f, x::DOUBLE AS x1, y::DOUBLE AS y1, x::DOUBLE + 3 * size_pct::DOUBLE AS x2, y::DOUBLE + 3 * size_pct::DOUBLE AS y2, CAST({cls} AS INTEGER) AS c, {clipped} AS clipped, CAST(class_id * 2 AS INTEGER) AS was FROM sa),
    f AS (SELECT camera_id, track_id, count(*) AS before, array_agg([{{'id': id, 'f': f, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'c': c, 'clipped': clipped, 'was': was}}] ORDER BY f DESC, x1, y1, x2, y2, c, clipped, id) AS bs FROM b GROUP BY ALL)"""


ORACLES["nms_dedup"] = sql(f"{_frames_sql('class_id * 2', 'false')} SELECT track_id, before, len({_KEPT}) AS after FROM f")


@query("frame_sizes", f"{_frames_sql('class_id * 2', 'sample_id % 3 = 0')} SELECT track_id, before, len({_KEPT}) AS after FROM f")
def frame_sizes(t: Lake) -> DataFrame:
    frames = _detections(t).groupBy("at_us").agg(F.collect_list(F.struct(*(F.col(f"box.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")), "confidence", "class_id", "clipped")).alias("boxes"))
    return frames.select(F.col("at_us").alias("track_id"), F.size("boxes").alias("before"), F.size(detection.dedup_frame(F.col("boxes"))).alias("after"))


def _detections(t: Lake) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    box = F.struct(d("x").alias("x1"), d("y").alias("y1"), (d("x") + 3 * d("size_pct")).alias("x2"), (d("y") + 3 * d("size_pct")).alias("y2"))
    cls = (F.col("class_id") * 2).cast("int")
    return t.samples().select("camera_id", F.col("track_id").alias("at_us"), F.col("sample_id").alias("detection_id"), box.alias("box"), cls.alias("class_id"), F.concat(F.lit("c"), cls.cast("string")).alias("class_name"), d("confidence").alias("confidence"), (F.col("sample_id") % 3 == 0).alias("clipped"), F.lit(800.0).alias("frame_width"), F.lit(600.0).alias("frame_height"))


@query("frames_published", f"""{_frames_sql('CASE WHEN class_id = 2 AND camera_id % 3 = 0 THEN 2 ELSE class_id * 2 END', 'sample_id % 3 = 0')},
    k AS (SELECT camera_id, track_id, unnest({_KEPT}) AS b FROM f),
    r AS (SELECT camera_id, track_id, b.id AS id, b.c AS c, b.was AS was, b.f AS f, b.clipped AS clipped, 100 * greatest((b.x2 - b.x1) / 800, (b.y2 - b.y1) / 600) AS size_pct, b.c IN (0, 2, 4) AS enabled,
      CASE WHEN b.c = 8 THEN 1.0 WHEN b.c = 2 AND camera_id = 7 THEN 0.5 ELSE 0.3 END AS conf, CASE WHEN b.c = 2 THEN 4.0 ELSE 0.0 END AS box, CASE WHEN camera_id % 2 = 0 THEN 0.1 END AS keep FROM k)
    SELECT camera_id, track_id AS at_us, id AS detection_id, c AS class_id, CASE WHEN was <> c THEN 'n' || c ELSE 'c' || c END AS class_name, round(size_pct, 6) AS size_pct,
      CASE WHEN NOT enabled THEN 'disabled' WHEN box > 0 AND size_pct < box THEN 'size' WHEN f < coalesce(least(keep, conf), conf) THEN 'conf' END AS drop_reason,
      enabled AND NOT (box > 0 AND size_pct < box) AND f >= coalesce(least(keep, conf), conf) AND f >= conf AND NOT clipped AS birth_eligible FROM r""")
def frames_published(t: Lake) -> DataFrame:
    k, cams = F.col("id").cast("int"), t.spark.range(20).select(F.col("id").alias("camera_id"))
    c = F.col("camera_id")
    remap = cams.filter(c % 3 == 0).select("camera_id", F.lit(4).alias("from_class"), F.lit(2).alias("to_class"))
    dim = t.spark.range(4).select((k * 2).alias("class_id"), F.concat(F.lit("n"), (k * 2).cast("string")).alias("class_name"))
    shared = t.spark.range(4).select((k * 2).alias("class_id"), (k < 3).alias("enabled"), F.lit(0.3).alias("min_confidence"), F.when(k == 1, 4.0).otherwise(0.0).alias("min_box_pct"))
    own = cams.filter(c == 7).select("camera_id", F.lit(2).alias("class_id"), F.lit(None).cast("boolean").alias("enabled"), F.lit(0.5).alias("min_confidence"), F.lit(None).cast("double").alias("min_box_pct"))
    keep = cams.select("camera_id", F.when(c % 2 == 0, 0.1).alias("maintain"))
    got = detection.published(_detections(t), remap, dim, shared, own, keep)
    return got.select("camera_id", "at_us", "detection_id", "class_id", "class_name", F.round("size_pct", 6).alias("size_pct"), "drop_reason", "birth_eligible")


_EXTENT = "sqrt((list_max(list_transform({0}, lambda o: o.x)) - list_min(list_transform({0}, lambda o: o.x))) ** 2 + (list_max(list_transform({0}, lambda o: o.y)) - list_min(list_transform({0}, lambda o: o.y))) ** 2)"


@query("displacement", f"""p AS (SELECT event_id, track_id, at_us, CAST(event_id % 97 AS DOUBLE) AS x, value AS y, list_sort(list({{'at': at_us, 'id': event_id, 'x': CAST(event_id % 97 AS DOUBLE), 'y': value}}) OVER (PARTITION BY track_id ORDER BY at_us RANGE BETWEEN {24 * H} PRECEDING AND CURRENT ROW)) AS h FROM ev),
    m AS (SELECT *, list_sort(list_transform(h, lambda o: o.x))[len(h) // 2 + 1] AS mx, list_sort(list_transform(h, lambda o: o.y))[len(h) // 2 + 1] AS my FROM p),
    g AS (SELECT *, list_transform(h, lambda o: (o.x - mx) * (o.x - mx) + (o.y - my) * (o.y - my)) AS g, sqrt((x - mx) ** 2 + (y - my) ** 2) > 40 AS away FROM m),
    w AS (SELECT *, list_position(g, list_max(g)) AS worst, sum(CASE WHEN away THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS back FROM g),
    e AS (SELECT *, list_filter(h, lambda o, i: i <> worst) AS r FROM w)
    SELECT event_id, round(CASE WHEN len(h) < 2 THEN 0 WHEN len(h) < 5 THEN {_EXTENT.format('h')} ELSE least({_EXTENT.format('h')}, {_EXTENT.format('r')}) END, 6) AS displacement,
      CAST(sum(CASE WHEN away THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, back ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS off_streak FROM e""")
def displacement(t: Lake) -> DataFrame:
    rows = t.events().select("event_id", "track_id", "at_us", "value")
    got = tracking.displacement(rows, ["track_id"], "at_us", "event_id", F.col("event_id") % 97, F.col("value"), 24 * H, 20.0)
    return got.select("event_id", F.round("displacement", 6).alias("displacement"), "off_streak")


@query("live_states", f"""s AS (SELECT camera_id % 20 AS camera_id, at_us // 60000000 * 60000000 AS at_us, event_id % 4 <> 0 AND event_id % 9 <> 0 AS r, event_id % 20 AS c, kind <> 'view' AS m FROM ev),
    a AS (SELECT camera_id, at_us, max(CASE WHEN r AND m THEN at_us END) AS moved, count(*) FILTER (r AND c = 0) AS person_count, min(CASE WHEN c = 0 THEN 0 WHEN c IN (1, 2, 3, 5, 7) THEN 1 WHEN c >= 14 THEN 2 ELSE 3 END) FILTER (r) AS k FROM s GROUP BY 1, 2),
    l AS (SELECT *, max(moved) OVER (PARTITION BY camera_id ORDER BY at_us) AS last FROM a),
    b AS (SELECT camera_id, at_us, coalesce(at_us < last + {H}, false) AS motion, person_count, coalesce(['person', 'vehicle', 'animal', 'other'][k + 1], 'none') AS object_class FROM l)
    SELECT camera_id, at_us, motion, person_count, object_class FROM b QUALIFY row(motion, person_count, object_class) IS DISTINCT FROM lag(row(motion, person_count, object_class)) OVER (PARTITION BY camera_id ORDER BY at_us)""")
def live_states(t: Lake) -> DataFrame:
    e = F.col("event_id")
    rows = t.events().select((F.col("camera_id") % 20).alias("camera_id"), (F.floor(F.col("at_us") / 60_000_000) * 60_000_000).alias("at_us"), F.when(e % 9 != 0, e % 20).alias("class_id"), F.when(F.col("kind") == "view", "Parked").alias("motion_state"), (e % 4 != 0).alias("ever_active"))
    return tracking.live_states(rows, H)


@query("change_feed", """b AS (SELECT track_id, class_id, plate_text, n_observations AS n FROM tr WHERE track_id % 5 <> 0), a AS (SELECT track_id, class_id, CASE WHEN track_id % 7 <> 0 THEN plate_text END AS plate_text, n_observations AS n FROM tr WHERE track_id % 6 <> 0)
    SELECT track_id, coalesce(a.class_id, b.class_id) AS class_id, CASE WHEN a.track_id IS NULL THEN b.plate_text ELSE a.plate_text END AS plate_text, coalesce(a.n, b.n) AS n, CASE WHEN b.track_id IS NULL THEN 'insert' WHEN a.track_id IS NULL THEN 'delete' ELSE 'update' END AS change
    FROM a FULL JOIN b USING (track_id) WHERE a.track_id IS NULL OR b.track_id IS NULL OR a.plate_text IS DISTINCT FROM b.plate_text""")
def change_feed(t: Lake) -> DataFrame:
    rows = t.tracks().select("track_id", "class_id", "plate_text", F.col("n_observations").alias("n"))
    before = rows.filter("track_id % 5 <> 0")
    after = rows.filter("track_id % 6 <> 0").withColumn("plate_text", F.when(F.col("track_id") % 7 != 0, F.col("plate_text")))
    return tables.changes(before, after, ["track_id"])


@query("motion_states")
def motion_states(t: Lake) -> DataFrame:
    """Users stand in for tracks: boxes jump with some kinds of events and jitter with the others."""
    e, u = F.col("event_id"), F.col("track_id")
    x = (u % 7) * 40.0 + (e % 5) + F.when(F.col("kind") == "purchase", 90.0).otherwise(0.0)
    rows = t.events().select((u % 20).alias("camera_id"), "at_us", e.alias("detection_id"), "track_id", F.when(u % 3 == 0, "person").otherwise("car").alias("class_name"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 60).alias("x2"), F.lit(80.0).alias("y2"), (e % 13 == 0).alias("coasted"))
    day = 24 * H
    return motion.motion_states(rows, motion.Motion(still_share=0.05, window_us=2 * day, park_us=4 * day, spot_us=3 * day, moved_us=5 * day, lost_us=4 * day))


@query("associated")
def associated(t: Lake) -> DataFrame:
    """Frames of five minutes; boxes lie by user and wander a little, the vector is that of the user."""
    e, u = F.col("event_id"), F.col("track_id")
    x = (u % 7) * 40.0 + (e % 9) * 2
    look = F.array((u % 3).cast("double"), (u % 5).cast("double"), F.lit(1.0))
    rows = t.events().select((u % 20).alias("camera_id"), (F.floor(F.col("at_us") / 300_000_000) * 1_000_000).alias("at_us"), e.alias("detection_id"), F.when(u % 3 == 0, "person").otherwise("car").alias("class_name"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 60).alias("x2"), F.lit(80.0).alias("y2"), look.alias("embedding"))
    return association.associated(rows, association.Association(lost_us=40 * 1_000_000, remembered_us=400 * 1_000_000, longest_step_us=60 * 1_000_000, outage_us=600 * 1_000_000))


@query("birth_spots")
def birth_spots(t: Lake) -> DataFrame:
    e, u = F.col("event_id"), F.col("track_id")
    x = (u % 7) * 40.0 + (e % 5)
    rows = t.events().select((u % 20).alias("camera_id"), "at_us", e.alias("detection_id"), "track_id", F.when(u % 3 == 0, "person").otherwise("car").alias("class_name"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 60).alias("x2"), F.lit(80.0).alias("y2"), (F.col("kind") == "purchase").alias("moved"), (F.col("value") / 100).alias("confidence"))
    return births.birth_spots(rows, births.Registry(births=3, span_us=24 * H, confidence=0.9, most_spots=4, spot_us=200 * H, lost_us=10 * H))


_LIGHT = "CASE WHEN {ir} THEN 1 WHEN {y} < 40 THEN 2 WHEN {y} < 90 THEN 3 WHEN {y} < 150 THEN 4 ELSE 5 END"
_HELD = " OR ".join(f"s.b = {i} AND r.y >= {a} - 8 AND r.y < {z} + 8" for i, a, z in ((2, -1e9, 40), (3, 40, 90), (4, 90, 150), (5, 150, 1e9)))
_READINGS = "r AS (SELECT track_id % 20 AS camera_id, event_id, CASE WHEN event_id % 17 = 0 THEN -1.0 ELSE value * 1.8 END AS y, event_id % 10 = 0 AS ir, row_number() OVER (PARTITION BY track_id % 20 ORDER BY at_us, event_id) AS n FROM ev)"
_MEANS = f"CASE WHEN r.ir THEN 1 WHEN r.y < 0 THEN NULL WHEN {_HELD} THEN s.b ELSE {_LIGHT.format(ir='r.ir', y='r.y')} END"
_NAMES = "['ir', 'dark', 'dim', 'normal', 'bright'][b]"


def _readings(t: Lake) -> DataFrame:
    e = F.col("event_id")
    return t.events().select((F.col("track_id") % 20).alias("camera_id"), "event_id", "at_us", F.when(e % 17 == 0, -1.0).otherwise(F.col("value") * 1.8).alias("luma"), F.when(e % 10 == 0, 0.6).otherwise(F.when(e % 34 == 0, -1.0).otherwise(0.1)).alias("ir"))


@query("held_light", "SELECT 1")
def held_light(t: Lake) -> DataFrame:
    return telemetry.held_light(_readings(t), ["camera_id"], "at_us", "event_id", F.col("luma"), F.col("ir"), width_us=12 * H).select("camera_id", "event_id", "band")


ORACLES["held_light"] = sql(f"""{_READINGS}, s AS (SELECT camera_id, n, event_id, CASE WHEN NOT ir AND y < 0 THEN 0 ELSE {_LIGHT.format(ir="ir", y="y")} END AS b FROM r WHERE n = 1
    UNION ALL SELECT r.camera_id, r.n, r.event_id, coalesce({_MEANS}, s.b) FROM s JOIN r ON r.camera_id = s.camera_id AND r.n = s.n + 1)
    SELECT camera_id, event_id, {_NAMES} AS band FROM s""").replace("WITH", "WITH RECURSIVE", 1)


@query("switched_light", "SELECT 1")
def switched_light(t: Lake) -> DataFrame:
    return telemetry.switched_light(_readings(t), ["camera_id"], "at_us", "event_id", F.col("luma"), F.col("ir"), F.col("event_id") % 7 == 0, width_us=12 * H).select("camera_id", "event_id", "band")


ORACLES["switched_light"] = sql(f"""{_READINGS}, s AS (SELECT camera_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 0 AS b, 0 AS w FROM r WHERE n = 1
    UNION ALL SELECT camera_id, n, event_id, CASE WHEN m = w AND m <> b AND event_id % 7 <> 0 AND NOT skip THEN m ELSE b END, CASE WHEN skip THEN w WHEN m IS NULL OR m = b OR m = w THEN 0 ELSE m END
    FROM (SELECT r.camera_id, r.n, r.event_id, s.b, s.w, r.event_id % 34 = 0 AND r.event_id % 10 <> 0 AS skip, {_MEANS} AS m FROM s JOIN r ON r.camera_id = s.camera_id AND r.n = s.n + 1))
    SELECT camera_id, event_id, {_NAMES} AS band FROM s WHERE n > 0""").replace("WITH", "WITH RECURSIVE", 1)
