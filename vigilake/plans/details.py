"""Further registered queries: geometry, scalar functions, gates, joins of places and plates, sinks, composed views.

Each has the SQL that must give the same rows; all read whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import payload as P
from ..functions import times as T
from ..functions import vectors as V
from ..operators import analytics, detection, identity, occupancy, plates, presence, ranked, recordings, retention, rules, telemetry, visits
from ..sources import sinks, tables
from .catalog import COS, SINCE, UNTIL, D, H, query
from .logical import Lake

M = T.MINUTE


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


BOXED = """b AS (SELECT event_id, e % 97 AS x1, e % 89 AS y1, e % 97 + 5 + e % 13 AS x2, e % 89 + 3 + e % 7 AS y2, (e * 7) % 97 AS u1, (e * 5) % 89 AS v1, (e * 7) % 97 + 20 AS u2, (e * 5) % 89 + 30 AS v2, CASE WHEN e % 10 = 0 THEN 0.0 ELSE 100.0 END AS fh
    FROM (SELECT event_id, CAST(event_id AS DOUBLE) AS e FROM ev))"""


def _boxed(t: Lake) -> DataFrame:
    e = F.col("event_id")
    own = _box(e % 97, e % 89, e % 97 + 5 + e % 13, e % 89 + 3 + e % 7)
    other = _box(e * 7 % 97, e * 5 % 89, e * 7 % 97 + 20, e * 5 % 89 + 30)
    return t.events().select("event_id", own.alias("box"), other.alias("other"), F.when(e % 10 == 0, 0.0).otherwise(100.0).alias("fh"))


@query("box_sizes", f"""{BOXED} SELECT event_id, round(CASE WHEN fh > 0 THEN 100 * greatest((x2 - x1) / 120, (y2 - y1) / fh) ELSE 0 END, 6) AS size_pct,
    ((x2 - x1) / 40) * ((y2 - y1) / 12) > 0.4 OR ((x2 - x1) / 40 > 0.85 AND (y2 - y1) / 12 > 0.75) AS oversized, round(x1 / 120, 6) AS left_share, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM b""")
def box_sizes(t: Lake) -> DataFrame:
    b, w, h = F.col("box"), F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    return _boxed(t).select(
        "event_id",
        F.round(G.size_percent(w, h, F.lit(120.0), F.col("fh")), 6).alias("size_pct"),
        G.oversized(b, F.lit(40.0), F.lit(12.0)).alias("oversized"),
        F.round(G.scaled(b, F.lit(120.0), F.lit(100.0))["x1"], 6).alias("left_share"),
        G.foot(b)["x"].alias("foot_x"),
        G.foot(b)["y"].alias("foot_y"),
    )


@query("box_relations", f"""{BOXED}, f AS (SELECT *, (x1 + x2) / 2 AS fx, y2 AS fy FROM b)
    SELECT event_id, round(greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) / ((x2 - x1) * (y2 - y1)), 6) AS contained,
      fx BETWEEN u1 AND u2 AND fy BETWEEN v1 AND v2 AS foot_inside, round(sqrt(greatest(u1 - fx, 0, fx - u2) ** 2 + greatest(v1 - fy, 0, fy - v2) ** 2), 6) AS gap,
      round(x1 + (u1 - x1) * CASE WHEN event_id % 5 > 0 THEN 0.5 ELSE 0 END, 6) AS between_x1,
      (x1 - 10 <= 2) OR (y1 - 0 <= 2 AND FALSE) OR (60 - x2 <= 2) OR (50 - y2 <= 2) AS clipped FROM f""")
def box_relations(t: Lake) -> DataFrame:
    b, o = F.col("box"), F.col("other")
    after = (F.col("event_id") % 5 * 1000).cast("long")
    tile = _box(F.lit(10), F.lit(0), F.lit(60), F.lit(50))
    return _boxed(t).select(
        "event_id",
        F.round(G.containment(b, o), 6).alias("contained"),
        G.inside_box(G.foot(b), o).alias("foot_inside"),
        F.round(G.gap_to_box(G.foot(b), o), 6).alias("gap"),
        F.round(G.between(b, o, F.lit(0).cast("long"), after, F.floor(after / 2).cast("long"))["x1"], 6).alias("between_x1"),
        G.seam_clipped(b, tile, F.lit(120.0), F.lit(100.0)).alias("clipped"),
    )


@query("tile_plan", """c AS (SELECT camera_id, 1000.0 + camera_id % 3 * 100 AS w, 600.0 AS h FROM cam), s AS (SELECT *, w / 2.8 AS tw, h / 1.9 AS th FROM c)
    SELECT camera_id, CAST(r.i * 3 + k.i AS INTEGER) AS tile, round(k.i * tw * 0.9, 6) AS x1, round(r.i * th * 0.9, 6) AS y1, round(k.i * tw * 0.9 + tw, 6) AS x2, round(r.i * th * 0.9 + th, 6) AS y2 FROM s, range(0, 2) r(i), range(0, 3) k(i)""")
def tile_plan(t: Lake) -> DataFrame:
    c = t.cameras().select("camera_id", F.posexplode(G.tiles(F.lit(1000.0) + F.col("camera_id") % 3 * 100, F.lit(600.0), 3, 2, 0.1)).alias("tile", "b"))
    return c.select("camera_id", "tile", *(F.round(f"b.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")))


@query("zone_interior", """p AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS x, (event_id % 7) / 10.0::DOUBLE AS y FROM ev)
    SELECT event_id, x > 0.1 AND x < 0.8 AND y > 0.1 AND y < 0.6 AS inside, CAST(least(1, 0.1 + event_id % 3) AS DOUBLE) AS low_x, CAST(least(1, 0.8 + event_id % 3) AS DOUBLE) AS high_x, round(sqrt(0.7 ** 2 + 0.5 ** 2), 6) AS spread FROM p""")
def zone_interior(t: Lake) -> DataFrame:
    corners = [(0.1, 0.1), (0.8, 0.1), (0.8, 0.6), (0.1, 0.6)]
    zone = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners))
    moved = F.transform(zone, lambda p: F.struct((p["x"] + F.col("event_id") % 3).alias("x"), p["y"].alias("y")))
    x, y = F.col("event_id") % 11 / 10.0, F.col("event_id") % 7 / 10.0
    return t.events().select("event_id", G.strictly_inside(x, y, zone).alias("inside"), G.bounds(moved)["x1"].alias("low_x"), G.bounds(moved)["x2"].alias("high_x"), F.round(G.spread(zone), 6).alias("spread"))


@query("time_functions", f"""SELECT track_id, (ended_us - started_us) / 1000000.0 AS seconds, CAST(strftime(make_timestamp(started_us) + INTERVAL 1 HOUR, '%Y-%m-%d') AS DATE) AS day, greatest(800000000000000, least(started_us, 900000000000000)) AS clamped,
    greatest(0.0, (ended_us - started_us - {5 * T.SECOND}) / 1000000.0) AS seek_s FROM tr""")
def time_functions(t: Lake) -> DataFrame:
    s, e = F.col("started_us"), F.col("ended_us")
    return t.tracks().select(
        "track_id",
        T.seconds_between(s, e).alias("seconds"),
        T.local_day(s, "+01:00").alias("day"),
        T.clamp(s, F.lit(800_000_000_000_000), F.lit(900_000_000_000_000)).alias("clamped"),
        T.seek_offset(e, s, 5 * T.SECOND).alias("seek_s"),
    )


@query("segment_names", """p AS (SELECT recording_id, CASE WHEN recording_id % 4 = 0 THEN 'cam/notes.txt' ELSE 'cam/' || strftime(make_timestamp(started_us), '%Y%m%d-%H%M%S') || '.mp4' END AS path FROM rec)
    SELECT recording_id, CASE WHEN recording_id % 4 <> 0 THEN epoch_us(strptime(path[5:19], '%Y%m%d-%H%M%S')) END AS started_us FROM p""")
def segment_names(t: Lake) -> DataFrame:
    name = F.date_format(F.timestamp_micros("started_us"), "yyyyMMdd-HHmmss")
    path = F.when(F.col("recording_id") % 4 == 0, "cam/notes.txt").otherwise(F.concat(F.lit("cam/"), name, F.lit(".mp4")))
    return t.recordings().select("recording_id", T.segment_start(path).alias("started_us"))


@query("text_functions", """SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'rtsp://user:***@host/' || c_custkey || '?token=***&x=1' AS url,
    sha1(c_custkey || chr(1) || 'doorbell' || chr(1) || chr(0)) AS key, upper(c_mktsegment[1:1]) AS initial FROM customer""")
def text_functions(t: Lake) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    return t.raw("customer").select(
        "c_custkey",
        P.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"),
        P.masked_url(F.concat(F.lit("rtsp://user:pa55@host/"), k, F.lit("?token=abc&x=1"))).alias("url"),
        P.event_key(F.col("c_custkey"), F.lit("doorbell"), F.lit(None)).alias("key"),
        F.upper(F.substring("c_mktsegment", 1, 1)).alias("initial"),
    )


@query("payload_functions", """SELECT event_id, '{"a":"1","b":"' || event_id % 3 || '","c":"9"}' AS merged, CASE WHEN event_id % 2 = 0 THEN 0.5 END AS least_confidence, CASE WHEN event_id % 3 = 0 THEN 1500 END AS dwell_ms,
    CASE WHEN event_id % 3 = 1 THEN ['c'] ELSE ['b', 'c'] END AS changed, event_id % 5 IN (0, 1) AS known FROM ev""")
def payload_functions(t: Lake) -> DataFrame:
    e = F.col("event_id")
    three = (e % 3).cast("string")
    left = F.lit('{"a":"1","b":"1"}')
    right = F.concat(F.lit('{"b":"'), three, F.lit('","c":"9"}'))
    conf = F.when(e % 2 == 0, "0.5").otherwise('"much"')
    dwell = F.when(e % 3 == 0, "1500").otherwise('"no"')
    rule = F.concat(F.lit('{"car":{"min_confidence":'), conf, F.lit(',"min_dwell_ms":'), dwell, F.lit("}}"))
    own = P.class_rules(rule)["car"]
    kind = "map<string,string>"
    diff = P.changed(F.from_json(left, kind), F.from_json(P.merged(left, right), kind))
    return t.events().select("event_id", P.merged(left, right).alias("merged"), own["min_confidence"].alias("least_confidence"), own["min_dwell_ms"].alias("dwell_ms"), F.sort_array(F.map_keys(diff)).alias("changed"), P.class_of_kind(F.element_at(F.array(*map(F.lit, ("person", "pet", "sofa", "tree", "sky"))), (e % 5 + 1).cast("int"))).isNotNull().alias("known"))


@query("vector_functions", """n AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: x * x)) AS s, lead(v) OVER (ORDER BY vec_id) AS w FROM vec), m AS (SELECT vec_id, v, list_transform(list_zip(v, coalesce(w, v)), lambda z: z[1] * 0.8 + z[2] * 0.2) AS e, coalesce(w, v) AS w FROM n)
    SELECT vec_id, round(list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))) / len(v), 6) AS steadiness, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS ema, round(v[3] + w[3], 6) AS added, true AS parsed FROM m""")
def vector_functions(t: Lake) -> DataFrame:
    v = t.vectors().select("vec_id", "v")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    rows = v.join(after, "vec_id", "left").withColumn("w", F.coalesce("w", "v"))
    a, b = F.col("v"), F.col("w")
    return rows.select("vec_id", F.round(V.mean_abs_difference(a, b), 6).alias("steadiness"), F.round(V.ema(a, b, 0.2)[0], 6).alias("ema"), F.round(V.added(a, b)[2], 6).alias("added"), (F.abs(V.parsed(V.literal(a))[1] - a[1]) < 6e-7).alias("parsed"))


@query("class_remap", """SELECT sample_id, CASE WHEN camera_id = 3 AND class_id = 1 THEN 7 WHEN camera_id = 4 AND class_id = 2 THEN 0 ELSE class_id END AS class_id, CASE WHEN camera_id = 3 AND class_id = 1 THEN 'truck' WHEN camera_id = 4 AND class_id = 2 THEN 'person' ELSE 'thing' END AS class_name FROM sa""")
def class_remap(t: Lake) -> DataFrame:
    from ..schemas import class_dim

    table = t.spark.createDataFrame([(3, 1, 7), (4, 2, 0), (5, 3, 999)], "camera_id long, from_class int, to_class int")
    return detection.remapped(t.samples().select("sample_id", "camera_id", "class_id", F.lit("thing").alias("class_name")), table, class_dim(t.spark)).select("sample_id", "class_id", "class_name")


ZONED = """z AS (SELECT event_id, ['gate', 'street', 'yard'][event_id % 3 + 1] AS zone_kind, CASE WHEN event_id % 4 = 0 THEN 'moving_only' WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN 'odd' END AS g, CASE WHEN event_id % 5 < 2 THEN 'parked' WHEN event_id % 5 = 2 THEN 'ACTIVE' END AS m, ['person', 'car', 'dog'][event_id % 7 % 3 + 1] AS c FROM ev)"""


@query("zone_gates", ZONED + """SELECT event_id, coalesce(nullif(g, ''), CASE WHEN zone_kind = 'street' THEN 'moving_only' END) IS NULL OR c = 'person' OR coalesce(nullif(g, ''), CASE WHEN zone_kind = 'street' THEN 'moving_only' END) <> 'moving_only' OR lower(coalesce(m, 'active')) = 'active' AS listens,
    event_id % 6 = 0 OR c = 'car' AS accepted, CASE WHEN event_id % 6 > 0 AND c = 'car' THEN 0.4 END AS rule,
    CASE WHEN c = 'person' THEN NULL WHEN event_id % 2 = 0 THEN 'off-zone' WHEN event_id % 8 > 3 AND event_id % 9 > 0 THEN 'sub-dwell' END AS verdict FROM z""")
def zone_gates(t: Lake) -> DataFrame:
    e = F.col("event_id")
    one = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    zone, name = one(("gate", "street", "yard"), e % 3), one(("person", "car", "dog"), e % 7 % 3)
    gate = F.when(e % 4 == 0, "moving_only").when(e % 4 == 1, "").when(e % 4 == 2, "odd")
    motion = F.when(e % 5 < 2, "parked").when(e % 5 == 2, "ACTIVE")
    accepted, rule = detection.zone_rule(F.when(e % 6 != 0, F.create_map(F.lit("car"), F.lit(0.4))), name)
    return t.events().select("event_id", detection.motion_allows(gate, zone, motion, name, {"street": "moving_only"}).alias("listens"), accepted.alias("accepted"), rule.alias("rule"), detection.zone_verdict(e % 2 != 0, e % 8 <= 3, e % 9 == 0, name == "person").alias("verdict"))


@query("track_verdicts", """SELECT track_id, CASE WHEN class_id <> 0 AND n_observations % 20 > 0 AND (track_id % 13) / CAST(n_observations % 20 AS DOUBLE) < 0.5 THEN 'static' END AS static, ended_us - started_us >= 60000000000 AND n_observations >= 30 AS lasts FROM tr""")
def track_verdicts(t: Lake) -> DataFrame:
    static = detection.static_verdict((F.col("track_id") % 13).cast("double"), (F.col("n_observations") % 20).cast("double"), F.col("class_id") == 0)
    return t.tracks().select("track_id", static.alias("static"), detection.exists_long_enough(F.col("started_us"), F.col("ended_us"), F.col("n_observations"), 60_000_000, 30).alias("lasts"))


@query("class_sets", """SELECT camera_id, list_sort(list_filter(CASE WHEN camera_id % 2 = 0 THEN ['car', 'person', 'truck'] ELSE ['car', 'person'] END, lambda c: NOT (camera_id % 3 = 0 AND c = 'car'))) AS classes FROM cam""")
def class_sets(t: Lake) -> DataFrame:
    c = F.col("camera_id")
    a = lambda *x: F.array(*map(F.lit, x))
    return t.cameras().select("camera_id", detection.class_set(a("person", "car"), F.when(c % 2 == 0, a("truck")), F.when(c % 3 == 0, a("car"))).alias("classes"))


@query("every_rule", """g AS (SELECT k AS class_id, k % 2 = 0 AS en, k * 0.1 AS mc FROM range(0, 4) x(k)), o AS (SELECT camera_id, 2 + camera_id % 4 AS class_id FROM cam WHERE camera_id % 10 = 0),
    w AS (SELECT camera_id, class_id FROM cam, g UNION SELECT camera_id, class_id FROM o)
    SELECT w.camera_id, CAST(w.class_id AS INTEGER) AS class_id, CASE WHEN g.class_id IS NULL THEN 'not-allowed' WHEN o.camera_id IS NOT NULL THEN 'override' ELSE 'global' END AS source, CAST(CASE WHEN g.class_id IS NULL THEN 1 WHEN o.camera_id IS NOT NULL THEN 0.9 ELSE mc END AS DOUBLE) AS least
    FROM w LEFT JOIN g USING (class_id) LEFT JOIN o ON o.camera_id = w.camera_id AND o.class_id = w.class_id""")
def every_rule(t: Lake) -> DataFrame:
    cams, k = t.cameras().select("camera_id"), F.col("id")
    shared = t.spark.range(4).select(k.cast("int").alias("class_id"), (k % 2 == 0).alias("enabled"), (k * F.lit(0.1)).alias("min_confidence"), F.lit(None).cast("double").alias("min_box_pct"))
    own = cams.filter("camera_id % 10 = 0").select("camera_id", (F.col("camera_id") % 4 + 2).cast("int").alias("class_id"), F.lit(None).cast("boolean").alias("enabled"), F.lit(0.9).alias("min_confidence"), F.lit(None).cast("double").alias("min_box_pct"))
    return detection.all_effective_rules(cams, shared, own).select("camera_id", "class_id", "source", F.col("min_confidence").alias("least"))


@query("layered_settings", """SELECT camera_id, 'gain' AS name, CAST(greatest(0.1, least(5, coalesce(CASE WHEN camera_id % 3 = 0 AND camera_id % 2 = 1 THEN camera_id / 4.0 END, 2.5))) AS DOUBLE) AS value FROM cam UNION ALL SELECT camera_id, 'rate', 1.5 FROM cam""")
def layered_settings(t: Lake) -> DataFrame:
    cams = t.cameras().select("camera_id")
    wanted = cams.withColumn("name", F.explode(F.array(F.lit("gain"), F.lit("rate"))))
    c = F.col("camera_id")
    own = cams.filter(c % 3 == 0).select("camera_id", F.lit("gain").alias("name"), F.when(c % 2 == 1, (c / 4.0).cast("string")).otherwise("off").alias("value"))
    shared = t.spark.createDataFrame([("gain", "2.5"), ("rate", "fast")], "name string, value string")
    return rules.layered(wanted, own, shared, 1.5, 0.1, 5.0)


@query("segments_in_window", "SELECT recording_id FROM rec WHERE coalesce(ended_us, started_us + 120000000) >= 800000000000000 AND started_us <= 810000000000000")
def segments_in_window(t: Lake) -> DataFrame:
    return recordings.in_window(t.recordings(), 800_000_000_000_000, 810_000_000_000_000).select("recording_id")


PLACES = """ep AS (SELECT event_id AS episode_id, 'P' || camera_id % 12 AS place, camera_id % 12 AS cam, at_us AS occupied_us, CASE WHEN event_id % 3 > 0 THEN at_us + (event_id % 50) * 60000000 END AS released_us, CASE WHEN event_id % 4 = 0 THEN 'car-' || event_id % 9 END AS global_id FROM ev WHERE kind = 'purchase'),
    rd AS (SELECT event_id AS read_id, 'P' || camera_id % 12 AS place, at_us AS read_us, event_id % 5 AS readings, CASE WHEN event_id % 3 = 0 THEN 'car-' || event_id % 9 END AS global_id FROM ev WHERE kind = 'view')"""


def _episodes(t: Lake) -> DataFrame:
    e, c = F.col("event_id"), F.col("camera_id") % 12
    return t.events().filter("kind = 'purchase'").select(
        e.alias("episode_id"),
        F.concat(F.lit("P"), c.cast("string")).alias("place"),
        F.col("at_us").alias("occupied_us"),
        F.when(e % 3 > 0, F.col("at_us") + e % 50 * M).alias("released_us"),
        F.when(e % 4 == 0, F.concat(F.lit("car-"), (e % 9).cast("string"))).alias("global_id"),
        F.array(c, c + 1).alias("cameras"),
        F.when(e % 2 == 0, "plate").otherwise("visit").alias("evidence"),
        (e % 40).alias("plate_read_id"),
    )


def _reads(t: Lake) -> DataFrame:
    e = F.col("event_id")
    return t.events().filter("kind = 'view'").select(e.alias("read_id"), F.concat(F.lit("P"), (F.col("camera_id") % 12).cast("string")).alias("place"), F.col("at_us").alias("read_us"), (e % 5).alias("readings"), F.when(e % 3 == 0, F.concat(F.lit("car-"), (e % 9).cast("string"))).alias("global_id"))


@query("departure_names", f"""{PLACES}, m AS (SELECT episode_id, rd.global_id, read_id, row_number() OVER (PARTITION BY episode_id ORDER BY rd.global_id IS NULL, abs(read_us - released_us), readings DESC, read_id) AS n
    FROM ep JOIN rd ON ep.place = rd.place AND abs(read_us - released_us) <= {2 * H} WHERE ep.global_id IS NULL AND read_id % 10 <> 0) SELECT episode_id, global_id, read_id FROM m WHERE n = 1""")
def departure_names(t: Lake) -> DataFrame:
    reads = _reads(t)
    return occupancy.departure_names(_episodes(t), reads, reads.filter("read_id % 10 = 0"), 2 * H)


@query("departure_windows", f"""{PLACES}, s AS (SELECT camera_id % 13 AS cam, at_us FROM ev WHERE kind = 'click'), f AS (SELECT episode_id, min(at_us) AS f FROM ep JOIN s ON s.cam IN (ep.cam, ep.cam + 1) AND at_us BETWEEN released_us - {2 * H} AND released_us GROUP BY 1)
    SELECT episode_id, least(coalesce(f, released_us), released_us - 60000000) AS from_us, released_us FROM ep LEFT JOIN f USING (episode_id) WHERE released_us IS NOT NULL""")
def departure_windows(t: Lake) -> DataFrame:
    persons = t.events().filter("kind = 'click'").select((F.col("camera_id") % 13).alias("camera_id"), F.col("at_us").alias("started_us"))
    return occupancy.departure_windows(_episodes(t), persons, 2 * H)


@query("witness_cameras", f"""{PLACES}, w AS (SELECT episode_id, unnest([cam, cam + 1]) AS camera_id FROM ep), j AS (SELECT w.episode_id, camera_id, slug, w.episode_id % 5 = 0 AND camera_id % 2 = 0 AS r FROM w JOIN cam USING (camera_id))
    SELECT episode_id, camera_id FROM j QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY NOT r, slug) = 1""")
def witness_cameras(t: Lake) -> DataFrame:
    e = _episodes(t)
    read = e.filter("episode_id % 5 = 0").select("episode_id", F.explode("cameras").alias("camera_id")).filter("camera_id % 2 = 0")
    return occupancy.witness(e, t.cameras(), read)


@query("vehicle_behind", f"""{PLACES} SELECT episode_id AS fill_id FROM ep WHERE EXISTS (SELECT 1 FROM tr WHERE tr.camera_id = ep.cam AND tr.class_id = 2 AND tr.started_us + 800000000000000 <= ep.occupied_us + {D} AND tr.ended_us + 800000000000000 >= ep.occupied_us - {H})""")
def vehicle_behind(t: Lake) -> DataFrame:
    fills = _episodes(t).select(F.col("episode_id").alias("fill_id"), "place", F.col("occupied_us").alias("filled_us"))
    cars = t.tracks().filter("class_id = 2").select("camera_id", (F.col("started_us") + 800_000_000_000_000).alias("started_us"), (F.col("ended_us") + 800_000_000_000_000).alias("ended_us"))
    regions = t.spark.range(12).select(F.col("id").alias("camera_id"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("place"))
    return occupancy.vehicle_behind(fills, cars, regions, H, D).select("fill_id")


@query("place_reconcile", f"""{PLACES}, v AS (SELECT 'P' || camera_id % 12 AS place, bool_or(kind = 'view' AND event_id % 50 = 0) AS present, bool_or(kind = 'click' AND event_id % 200 = 0) AS empty FROM ev GROUP BY 1), o AS (SELECT place, min(occupied_us) AS occupied_us FROM ep WHERE place <> 'P3' AND place <> 'P4' GROUP BY 1)
    SELECT place, CASE WHEN occupied_us IS NULL AND present THEN 'claim' WHEN occupied_us IS NOT NULL AND coalesce(empty, FALSE) AND NOT coalesce(present, FALSE) THEN 'release' ELSE 'hold' END AS action FROM v FULL JOIN o USING (place)""")
def place_reconcile(t: Lake) -> DataFrame:
    e = F.col("event_id")
    said = F.when((F.col("kind") == "view") & (e % 50 == 0), "present").when((F.col("kind") == "click") & (e % 200 == 0), "empty").otherwise("unknown")
    votes = occupancy.place_votes(t.events().select(F.concat(F.lit("P"), (F.col("camera_id") % 12).cast("string")).alias("place"), said.alias("state")))
    held = _episodes(t).filter("place NOT IN ('P3', 'P4')").groupBy("place").agg(F.min("occupied_us").alias("occupied_us"))
    return occupancy.reconciled(held, votes, UNTIL).select("place", "action")


@query("rivals_demoted", f"""{PLACES}, o AS (SELECT episode_id, place, occupied_us, global_id, row_number() OVER (PARTITION BY global_id ORDER BY CASE WHEN episode_id % 2 = 0 THEN 0 ELSE 2 END, occupied_us DESC, place) AS n FROM ep WHERE released_us IS NULL) SELECT episode_id, CASE WHEN n = 1 THEN global_id END AS global_id FROM o""")
def rivals_demoted(t: Lake) -> DataFrame:
    return occupancy.rivals_demoted(_episodes(t).filter("released_us IS NULL")).select("episode_id", "global_id")


@query("place_announcements", f"{PLACES} SELECT episode_id FROM ep WHERE released_us IS NOT NULL AND (global_id IS NOT NULL OR released_us <= {UNTIL - 5 * D} - 600000000) AND episode_id % 7 <> 0")
def place_announcements(t: Lake) -> DataFrame:
    e = _episodes(t)
    return occupancy.announcements(e, e.filter("episode_id % 7 = 0"), UNTIL - 5 * D).select("episode_id")


@query("place_history", f"""{PLACES} SELECT place, occupied_us, CASE WHEN global_id = 'car-4' THEN 'Golf' WHEN global_id = 'car-8' THEN 'ZG8' ELSE global_id END AS name, round((coalesce(released_us, {UNTIL}) - occupied_us) / 1000000.0, 3) AS stood_s
    FROM ep WHERE occupied_us < {SINCE + 20 * D} AND (released_us IS NULL OR released_us >= {SINCE + 10 * D})""")
def place_history(t: Lake) -> DataFrame:
    names = t.spark.createDataFrame([("car-4", "Golf", "ZG4"), ("car-8", None, "ZG8")], "global_id string, name string, plate string")
    got = occupancy.history(_episodes(t), names, SINCE + 10 * D, SINCE + 20 * D, UNTIL)
    return got.select("place", "occupied_us", "name", F.round("stood_s", 3).alias("stood_s"))


@query("place_rules_broken", f"""{PLACES} SELECT 'place' AS rule, place AS key FROM ep WHERE released_us IS NULL GROUP BY place HAVING count(*) > 1 UNION ALL SELECT 'vehicle', global_id FROM ep WHERE released_us IS NULL AND global_id IS NOT NULL GROUP BY global_id HAVING count(*) > 1
    UNION ALL SELECT 'read', CAST(episode_id % 40 AS VARCHAR) FROM ep GROUP BY episode_id % 40 HAVING count(*) > 1""")
def place_rules_broken(t: Lake) -> DataFrame:
    return occupancy.one_open_each(_episodes(t))


@query("open_place_cameras", f"{PLACES} SELECT place, list_sort(list(DISTINCT c)) AS cameras FROM (SELECT place, unnest([cam, cam + 1]) AS c FROM ep) GROUP BY 1")
def open_place_cameras(t: Lake) -> DataFrame:
    return occupancy.grouped_cameras(_episodes(t))


@query("reads_kept", f"{PLACES} SELECT read_id FROM rd WHERE read_us > {UNTIL - 10 * D} OR read_id IN (SELECT episode_id % 40 FROM ep)")
def reads_kept(t: Lake) -> DataFrame:
    return retention.plate_reads_kept(_reads(t), _episodes(t), UNTIL, 10).select("read_id")


@query("sibling_tracks", """m AS (SELECT a.track_id, b.track_id AS sibling, row_number() OVER (PARTITION BY a.track_id ORDER BY abs(b.started_us - a.started_us), b.track_id) AS n FROM tr a JOIN tr b ON a.camera_id <> b.camera_id AND b.started_us <= a.ended_us + 45000000 AND b.ended_us >= a.started_us - 45000000
    WHERE a.class_id = 7 AND b.class_id = 7) SELECT track_id, sibling FROM m WHERE n <= 4""")
def sibling_tracks(t: Lake) -> DataFrame:
    return occupancy.siblings(t.tracks().filter("class_id = 7"))


@query("host_rows", """w AS (SELECT * FROM tr WHERE class_id = 0 AND track_id % 2 = 0), m AS (SELECT w.track_id, f.track_id AS host, row_number() OVER (PARTITION BY w.track_id ORDER BY f.started_us, CAST(f.track_id AS VARCHAR)) AS n FROM w JOIN tr f ON f.camera_id = w.camera_id AND f.started_us <= w.ended_us AND f.ended_us >= w.started_us AND f.class_id IN (2, 7))
    SELECT track_id, CAST(host AS VARCHAR) AS host FROM m WHERE n = 1""")
def host_rows(t: Lake) -> DataFrame:
    feed = t.tracks().withColumn("visit_id", F.col("track_id").cast("string"))
    return occupancy.host_row(t.tracks().filter("class_id = 0 AND track_id % 2 = 0").select("track_id", "camera_id", "started_us", "ended_us"), feed, "track_id", F.col("class_id").isin(2, 7))


@query("sample_claims", """s AS (SELECT event_id AS sample_id, camera_id % 20 AS camera_id, event_id % 3 AS l, at_us AS c FROM ev), t AS (SELECT track_id, camera_id, track_id % 3 AS l, started_us + 800000000000000 AS s, ended_us + 800000000000000 AS e FROM tr)
    SELECT sample_id, track_id FROM s JOIN t ON s.camera_id = t.camera_id AND s.l = t.l AND c BETWEEN s - 60000000 AND e + 60000000 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, track_id) = 1""")
def sample_claims(t: Lake) -> DataFrame:
    s = t.events().select(F.col("event_id").alias("sample_id"), (F.col("camera_id") % 20).alias("camera_id"), (F.col("event_id") % 3).alias("local_track_id"), F.col("at_us").alias("captured_us"))
    own = t.tracks().select("track_id", "camera_id", (F.col("track_id") % 3).alias("local_track_id"), (F.col("started_us") + 800_000_000_000_000).alias("started_us"), (F.col("ended_us") + 800_000_000_000_000).alias("ended_us"))
    return identity.samples_of_tracks(s, own, M)


@query("drive_off_walks", f"""d AS (SELECT event_id AS departure_id, camera_id % 30 AS cam, at_us AS c FROM ev WHERE kind = 'purchase'), u AS (SELECT camera_id % 30 AS cam, at_us AS u FROM ev WHERE kind = 'click'), p AS (SELECT event_id AS p, camera_id % 30 AS cam, at_us AS s, at_us + (event_id % 40) * 60000000 AS e FROM ev WHERE kind = 'view'),
    m AS (SELECT departure_id, any_value(d.cam) AS cam, any_value(c) AS c, coalesce(max(u), any_value(c) - 40000000) AS mv FROM d LEFT JOIN u ON u.cam = d.cam AND u > c - {6 * H} AND u <= c GROUP BY 1),
    w AS (SELECT departure_id, s, e, p, min(s) OVER (PARTITION BY departure_id ORDER BY s DESC, p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m JOIN p ON p.cam = m.cam AND e > mv - {6 * H} AND e <= mv),
    b AS (SELECT *, sum(CASE WHEN reach IS NOT NULL AND reach - e > {H} THEN 1 ELSE 0 END) OVER (PARTITION BY departure_id ORDER BY s DESC, p DESC ROWS UNBOUNDED PRECEDING) AS n FROM w), f AS (SELECT departure_id, min(s) AS f FROM b WHERE n = 0 GROUP BY 1)
    SELECT departure_id, least(coalesce(least(f, mv), mv), c - 40000000) AS opens_us, c AS closes_us FROM m LEFT JOIN f USING (departure_id)""")
def drive_off_walks(t: Lake) -> DataFrame:
    e = t.events().withColumn("camera_id", F.col("camera_id") % 30)
    d = e.filter("kind = 'purchase'").select(F.col("event_id").alias("departure_id"), "camera_id", F.col("at_us").alias("closes_us"))
    p = e.filter("kind = 'view'").select(F.col("event_id").alias("track_id"), "camera_id", F.col("at_us").alias("started_us"), (F.col("at_us") + F.col("event_id") % 40 * M).alias("ended_us"))
    return visits.walk_to_drive_off(d, e.filter("kind = 'click'").select("camera_id", "at_us"), p, 6 * H, H)


@query("member_tracks", "SELECT track_id, started_us FROM tr WHERE track_id IN (SELECT unnest(ids) FROM (SELECT list(event_id) AS ids FROM ev WHERE kind = 'error'))")
def member_tracks(t: Lake) -> DataFrame:
    asked = t.events().filter("kind = 'error'").agg(F.collect_list("event_id").alias("ids"))
    return visits.members(t.tracks(), asked, "ids").select("track_id", "started_us")


@query("visit_zone_passes", """v AS (SELECT track_id % 500 AS visit_id, list(track_id % 150) AS ids FROM tr GROUP BY 1), x AS (SELECT DISTINCT visit_id, unnest(ids) AS track_id FROM v)
    SELECT CAST(visit_id AS VARCHAR) AS visit_id, kind, count(*) AS n, min(at_us) AS first_us FROM x JOIN ev USING (track_id) GROUP BY ALL""")
def visit_zone_passes(t: Lake) -> DataFrame:
    rows = t.tracks().groupBy((F.col("track_id") % 500).cast("string").alias("visit_id")).agg(F.collect_list(F.col("track_id") % 150).alias("track_ids"))
    return visits.zone_passes(rows, t.events())


@query("array_updates", "SELECT track_id, CASE track_id % 50 WHEN 3 THEN 'a' WHEN 5 THEN 'b' ELSE global_id END AS global_id FROM tr")
def array_updates(t: Lake) -> DataFrame:
    ids = t.tracks().filter("track_id % 50 IN (3, 5)").select("track_id", F.when(F.col("track_id") % 50 == 3, "a").otherwise("b").alias("new"))
    arrays = ids.agg(F.sort_array(F.collect_list(F.struct("track_id", "new"))).alias("x")).select(F.col("x.track_id").alias("ids"), F.col("x.new").alias("news"))
    return identity.updated(t.tracks(), arrays, "track_id", "ids", "news", "global_id").select("track_id", "global_id")


@query("latest_snapshots", f"""p AS (SELECT camera_id AS service, at_us, event_id, row_number() OVER (PARTITION BY camera_id ORDER BY at_us DESC, event_id DESC) AS n FROM ev) SELECT service, max(at_us) AS at_us, {UNTIL} - max(at_us) > {D} AS stale, count(*) FILTER (n <= 20) AS kept FROM p GROUP BY 1""")
def latest_snapshots(t: Lake) -> DataFrame:
    rows = t.events().select(F.col("camera_id").alias("service"), "at_us", F.col("event_id").alias("snapshot_id"))
    newest, kept = telemetry.latest(rows, UNTIL, 20, D)
    return newest.select("service", "at_us", "stale").join(kept.groupBy("service").agg(F.count("*").alias("kept")), "service")


@query("finalizer_lag", f"SELECT max(at_us) AS newest_us, max(at_us) FILTER (kind = 'signup') AS finalized_us, max(at_us) - max(at_us) FILTER (kind = 'signup') > {H} AS lagging FROM ev")
def finalizer_lag(t: Lake) -> DataFrame:
    return analytics.finalizer_lag(t.events(), t.events().filter("kind = 'signup'"), H)


@query("movement_extents", """SELECT camera_id, CAST(min(event_id % 97 + 5) AS DOUBLE) AS min_x, CAST(max(event_id % 97 + 5) AS DOUBLE) AS max_x, round(sqrt((max(event_id % 97) - min(event_id % 97)) ** 2 + (max(event_id % 89) - min(event_id % 89)) ** 2), 6) AS travel, round(sqrt(200), 6) AS diagonal FROM ev GROUP BY 1""")
def movement_extents(t: Lake) -> DataFrame:
    e = F.col("event_id")
    rows = t.events().select("camera_id", "at_us", _box(e % 97, e % 89, e % 97 + 10, e % 89 + 10).alias("box"))
    got = analytics.extents(rows, ["camera_id"])
    return got.select("camera_id", "min_x", "max_x", F.round("travel", 6).alias("travel"), F.round("diagonal", 6).alias("diagonal"))


@query("fading_class_vote", """s AS (SELECT camera_id, event_id % 4 AS c, sum(0.5) AS w FROM ev WHERE event_id % 4 <> 0 GROUP BY ALL), p AS (SELECT DISTINCT camera_id FROM ev WHERE event_id % 4 = 0 AND event_id % 3 = 0), a AS (SELECT camera_id, CAST(c AS INTEGER) AS class_id, w FROM s QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY w DESC, c) = 1)
    SELECT camera_id, CASE WHEN p.camera_id IS NOT NULL THEN 0 ELSE class_id END AS class_id FROM a LEFT JOIN p USING (camera_id)""")
def fading_class_vote(t: Lake) -> DataFrame:
    # weights stay below the cap here, so the vote is a plain sum; tests/test_bands.py holds the fold with the cap against a plain one
    e = F.col("event_id")
    rows = t.events().filter((e % 4 != 0) | (e % 3 == 0)).select("camera_id", "event_id", (e % 4).cast("int").alias("class_id"), F.lit(0.5).alias("confidence"))
    order = F.col("class_id").cast("long") * 1_000_000_000 + F.col("event_id")
    return analytics.confidence_vote(rows.withColumn("at", F.when(F.col("class_id") == 0, F.lit(2**62)).otherwise(order)), ["camera_id"], "at", 1e9).select("camera_id", "class_id")


@query("counter_percent", "p AS (SELECT event_id, at_us - lag(at_us) OVER w AS g, (event_id % 1000) * 1000 - lag((event_id % 1000) * 1000) OVER w AS u FROM ev WINDOW w AS (PARTITION BY camera_id ORDER BY at_us)) SELECT event_id, round(CASE WHEN g > 0 AND u >= 0 THEN 100.0 * u / (g * 4) END, 9) AS cpu_percent FROM p")
def counter_percent(t: Lake) -> DataFrame:
    rows = t.events().select("event_id", "camera_id", "at_us", (F.col("event_id") % 1000 * 1000).alias("usage_us"), F.lit(4).alias("cores"))
    return telemetry.cpu_percent(rows, ["camera_id"]).select("event_id", F.round("cpu_percent", 9).alias("cpu_percent"))


@query("telemetry_intake", "SELECT at_us, CAST(camera_id AS VARCHAR) AS camera, CASE WHEN event_id % 2 = 0 THEN 'detector' ELSE 'tracker' END AS source, payload FROM ev WHERE event_id % 5 > 0")
def telemetry_intake(t: Lake) -> DataFrame:
    e = F.col("event_id")
    subject = F.when(e % 5 == 0, "telemetry.lonely").otherwise(F.concat(F.lit("site.telemetry."), F.when(e % 2 == 0, "detector").otherwise("tracker"), F.lit("."), F.col("camera_id").cast("string")))
    return tables.telemetry_rows(t.events().select("at_us", subject.alias("subject"), "payload"))


@query("doorbell_rows", "SELECT sha1(camera_id || chr(1) || 'doorbell' || chr(1) || at_us) AS event_key, camera_id, 'doorbell' AS kind, at_us FROM ev WHERE kind = 'click'")
def doorbell_rows(t: Lake) -> DataFrame:
    return tables.doorbell_events(t.events().filter("kind = 'click'").select("camera_id", "at_us")).select("event_key", "camera_id", "kind", "at_us")


@query("raw_trace", f"""r AS (SELECT event_id, camera_id % 5 AS camera_id, at_us - at_us % {H} AS f, value FROM ev WHERE at_us >= {SINCE} AND at_us < {SINCE + 10 * D}), f AS (SELECT camera_id, f, row_number() OVER (PARTITION BY camera_id ORDER BY f) - 1 AS n, count(*) OVER (PARTITION BY camera_id) AS c FROM (SELECT DISTINCT camera_id, f FROM r)), k AS (SELECT camera_id, f FROM f WHERE n % CAST(ceil(c / 50.0) AS BIGINT) = 0)
    SELECT event_id AS detection_id FROM r JOIN k USING (camera_id, f) QUALIFY row_number() OVER (PARTITION BY camera_id, f ORDER BY value DESC, event_id) <= 2""")
def raw_trace(t: Lake) -> DataFrame:
    rows = t.events().select(F.col("event_id").alias("detection_id"), (F.col("camera_id") % 5).alias("camera_id"), T.floor_to(F.col("at_us"), H).alias("at_us"), F.col("value").alias("confidence"), F.col("at_us").alias("own"))
    return detection.raw_trace(rows.filter((F.col("own") >= SINCE) & (F.col("own") < SINCE + 10 * D)), SINCE, SINCE + 10 * D, 2, 50).select("detection_id")


@query("spot_births", """SELECT event_id, (camera_id % 3 = 0 AND event_id % 3 = 1 AND (event_id % 97 + 5) BETWEEN 20 AND 32 AND event_id % 20 + 10 BETWEEN 8 AND 30
      AND value < 70 AND greatest(0, least(event_id % 97 + 10, 32) - greatest(event_id % 97, 20)) * greatest(0, least(event_id % 20 + 10, 30) - greatest(event_id % 20, 8)) / CAST(100 + 12 * 22 - greatest(0, least(event_id % 97 + 10, 32) - greatest(event_id % 97, 20)) * greatest(0, least(event_id % 20 + 10, 30) - greatest(event_id % 20, 8)) AS DOUBLE) >= 0.2) AS suppressed FROM ev""")
def spot_births(t: Lake) -> DataFrame:
    e = F.col("event_id")
    rows = t.events().select(e.alias("detection_id"), (F.col("camera_id") % 3).alias("camera_id"), (e % 3).cast("int").alias("class_id"), _box(e % 97, e % 20, e % 97 + 10, e % 20 + 10).alias("box"), F.col("value").alias("confidence"))
    spot = F.struct(F.lit(20.0).alias("x1"), F.lit(8.0).alias("y1"), F.lit(32.0).alias("x2"), F.lit(30.0).alias("y2"))
    spots = t.spark.createDataFrame([(0, 1, 25, 0, 0, D), (1, 1, 5, 0, 0, D), (2, 1, 50, 1, 0, D)], "camera_id long, class_id int, births int, movers int, first_us long, last_us long").withColumn("spot", spot)
    return detection.spot_suppressed(rows, spots, 0.2, 20, D, 70.0).select(F.col("detection_id").alias("event_id"), "suppressed")


@query("body_samples", "SELECT camera_id, event_id AS sample_id FROM ev QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY CASE WHEN camera_id % 2 = 0 AND event_id % 3 = 0 THEN 1 ELSE 0 END, value DESC, event_id) = 1")
def body_samples(t: Lake) -> DataFrame:
    rows = t.events().select("camera_id", F.col("event_id").alias("sample_id"), F.col("value").alias("confidence"), F.when(F.col("event_id") % 3 == 0, True).alias("at_rest"))
    return identity.best_body(rows, ["camera_id"], F.col("camera_id") % 2 == 0).select("camera_id", "sample_id")


@query("focus_times", "SELECT recording_id, [started_us, started_us + (ended_us - started_us) // 2, ended_us] AS at, started_us + (ended_us - started_us) // 2 AS middle FROM rec WHERE ended_us IS NOT NULL")
def focus_times(t: Lake) -> DataFrame:
    r = t.recordings().filter("ended_us IS NOT NULL")
    return r.select("recording_id", plates.focus_times(F.col("started_us"), F.col("ended_us"), 3).alias("at"), plates.focus_times(F.col("started_us"), F.col("ended_us"), 1)[0].alias("middle"))


@query("null_order", "SELECT recording_id, retain_until_us FROM rec ORDER BY retain_until_us DESC NULLS LAST, recording_id LIMIT 3000")
def null_order(t: Lake) -> DataFrame:
    return t.recordings().orderBy(F.col("retain_until_us").desc_nulls_last(), "recording_id").limit(3000).select("recording_id", "retain_until_us")


SEEN = "s AS (SELECT camera_id, kind AS text, event_id, at_us, CAST(event_id % 9 AS DOUBLE) AS x, CAST(event_id % 7 AS DOUBLE) AS y, CAST(event_id % 31 AS DOUBLE) AS ox, CAST(10 + event_id % 3 AS DOUBLE) AS width FROM ev)"


def _sightings(t: Lake) -> DataFrame:
    e = F.col("event_id")
    d = lambda c, n: c.cast("double").alias(n)
    return t.events().select("camera_id", F.col("kind").alias("text"), "event_id", "at_us", d(e % 9, "x"), d(e % 7, "y"), d(e % 31, "owner_x"), F.lit(0.0).alias("owner_y"), d(10 + e % 3, "width"))


@query("plate_fixtures", SEEN + "SELECT camera_id, text, count(*) >= 5 AND sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) <= 0.9 * quantile_cont(width, 0.5) AND max(ox) - min(ox) >= 25 AS fixture FROM s GROUP BY ALL")
def plate_fixtures(t: Lake) -> DataFrame:
    return plates.fixtures(_sightings(t), ["camera_id"], 5, 0.9, 25.0)


@query("plates_not_standing", SEEN + ", k AS (SELECT camera_id, text FROM s GROUP BY ALL HAVING count(*) > 1 AND sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) <= 0.8 * quantile_cont(width, 0.5)) SELECT event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.camera_id = s.camera_id AND k.text = s.text)")
def plates_not_standing(t: Lake) -> DataFrame:
    return plates.not_standing(_sightings(t), ["camera_id"], 0.8).select("event_id")


@query("plates_moving", SEEN + """, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY camera_id ORDER BY at_us)), e AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM d WINDOW w AS (PARTITION BY camera_id ORDER BY at_us))
    SELECT event_id FROM e WHERE sqrt(dx * dx + dy * dy) >= 0.05 * width AND sqrt(px * px + py * py) >= 0.05 * width AND dx * px + dy * py > 0""")
def plates_moving(t: Lake) -> DataFrame:
    return plates.moving(_sightings(t), ["camera_id"], "at_us").select("event_id")


@query("plate_places", SEEN + """, r AS (SELECT camera_id, p, CAST(p * 6 AS DOUBLE) AS x1, 0.0 AS y1, CAST(p * 6 + 2 AS DOUBLE) AS x2, 2.0 AS y2 FROM cam, range(0, 3) k(p)), m AS (SELECT event_id, 'P' || p AS place, sqrt(greatest(x1 - x, 0, x - x2) ** 2 + greatest(y1 - y, 0, y - y2) ** 2) AS gap, width FROM s JOIN r USING (camera_id))
    SELECT event_id, place, round(gap, 6) AS gap FROM m WHERE gap <= 0.2 * width QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, place) = 1""")
def plate_places(t: Lake) -> DataFrame:
    p = F.explode(F.sequence(F.lit(0), F.lit(2)))
    regions = t.cameras().select("camera_id", p.alias("p")).select("camera_id", F.concat(F.lit("P"), F.col("p").cast("string")).alias("place"), _box(F.col("p") * 6, F.lit(0), F.col("p") * 6 + 2, F.lit(2)).alias("region"))
    got = plates.nearest_place(_sightings(t), regions, "event_id", 0.2)
    return got.select("event_id", "place", F.round("gap", 6).alias("gap"))


@query("plate_seen_enough", "v AS (SELECT camera_id, upper(kind) AS plate, count(*) AS seen FROM ev GROUP BY ALL) SELECT camera_id, seen FROM v WHERE plate = 'CLICK' AND seen >= 12")
def plate_seen_enough(t: Lake) -> DataFrame:
    votes = t.events().select("camera_id", F.lit("CLICK").alias("plate")).distinct()
    return plates.seen_enough(votes, t.events(), ["camera_id"], "kind", 12).select("camera_id", "seen")


@query("rival_gaps", f"""m AS (SELECT p.vec_id, r.label, min({COS.format(a='p.v', b='r.v')}) AS d FROM vec p, vec r WHERE p.vec_id % 2 = 1 AND r.vec_id % 2 = 0 GROUP BY ALL) SELECT vec_id, label, round(lead(d) OVER w - d, 4) AS gap FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY d, label) QUALIFY row_number() OVER w = 1""")
def rival_gaps(t: Lake) -> DataFrame:
    v = t.vectors()
    d = identity.distances(v.filter("vec_id % 2 = 1"), v.filter("vec_id % 2 = 0"), "vec_id", "label", "v")
    return ranked.rival_gap(d, "vec_id", "label", "dist").select("vec_id", "label", F.round("gap", 4).alias("gap"))


@query("face_audit", f"""m AS (SELECT p.vec_id, r.label, min({COS.format(a='p.v', b='r.v')}) AS d FROM vec p, vec r WHERE p.vec_id % 2 = 1 AND r.vec_id % 2 = 0 GROUP BY ALL), g AS (SELECT vec_id, label, d, lead(d) OVER w - d AS gap FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY d, label) QUALIFY row_number() OVER w = 1)
    SELECT vec.vec_id AS track_id, CASE WHEN d IS NULL THEN 'unusable' WHEN d < 0.9 AND (gap IS NULL OR gap >= 0.02) THEN CASE WHEN g.label = vec.label THEN 'agree' ELSE 'reassign' END ELSE 'clear' END AS verdict FROM vec LEFT JOIN g USING (vec_id)""")
def face_audit(t: Lake) -> DataFrame:
    v = t.vectors()
    d = identity.distances(v.filter("vec_id % 2 = 1"), v.filter("vec_id % 2 = 0"), "vec_id", "label", "v")
    tracks = v.select(F.col("vec_id").alias("track_id"), F.col("label").alias("global_id"))
    return identity.face_audit(tracks, d.select(F.col("vec_id").alias("track_id"), F.col("label").alias("candidate"), "dist"), 0.9, 0.02).select("track_id", "verdict")


@query("naming_cascade", """SELECT track_id, CASE WHEN track_id % 10 = 0 THEN 'f' WHEN track_id % 7 = 0 AND track_id % 2 = 0 THEN 'l' WHEN track_id % 11 = 0 THEN 'p' WHEN track_id % 5 = 0 THEN 'c' WHEN track_id % 4 = 0 THEN 'b' ELSE CAST(track_id AS VARCHAR) END AS global_id,
    CASE WHEN track_id % 10 = 0 THEN 'face' WHEN track_id % 7 = 0 AND track_id % 2 = 0 THEN 'live' WHEN track_id % 11 = 0 THEN 'pet' WHEN track_id % 5 = 0 THEN 'chain' WHEN track_id % 4 = 0 THEN 'body' ELSE 'new' END AS identity_source FROM tr""")
def naming_cascade(t: Lake) -> DataFrame:
    k = t.tracks().select("track_id")
    of = lambda n, name: k.filter(F.col("track_id") % n == 0).select("track_id", F.lit(name).alias("global_id"))
    return identity.named(k, of(10, "f"), of(7, "l").withColumn("fits", F.col("track_id") % 2 == 0), of(11, "p"), of(4, "b"), of(5, "c"))


@query("identity_fits", "SELECT track_id, CASE WHEN track_id % 4 = 0 THEN TRUE WHEN track_id % 4 = 1 THEN reid_group = 'person' ELSE reid_group = 'animal' END AS fits FROM tr")
def identity_fits(t: Lake) -> DataFrame:
    k = F.col("track_id") % 4
    return t.tracks().select("track_id", identity.fits_class(F.when(k == 1, "person").when(k == 2, "pet").when(k == 3, "person"), F.when(k == 3, "pet"), F.col("reid_group")).alias("fits"))


@query("merged_presence", """o AS (SELECT CASE WHEN camera_id % 6 = 5 THEN 1 ELSE camera_id % 6 END AS g, camera_id % 4 AS c, event_id, at_us FROM ev WHERE kind = 'view')
    SELECT CAST(g AS VARCHAR) AS global_id, c AS camera_id, arg_min(event_id, at_us) AS episode_id, min(at_us) AS present_us, max(at_us) + 60000000 AS confirmed_us FROM o GROUP BY ALL""")
def merged_presence(t: Lake) -> DataFrame:
    rows = t.events().filter("kind = 'view'").select(F.col("event_id").alias("episode_id"), (F.col("camera_id") % 6).cast("string").alias("global_id"), (F.col("camera_id") % 4).alias("camera_id"), F.lit("body").alias("evidence"), F.col("at_us").alias("present_us"), (F.col("at_us") + M).alias("confirmed_us"), F.lit(None).cast("long").alias("departed_us"))
    mapping = t.spark.createDataFrame([("5", "1")], "old string, new string")
    return identity.merged_presence(rows, mapping).select("global_id", "camera_id", "episode_id", "present_us", "confirmed_us")


@query("presence_listing", "SELECT track_id AS episode_id, CASE WHEN global_id = 'id-3' THEN 'Ana' END AS name, (CASE WHEN track_id % 2 = 0 THEN ended_us ELSE started_us + 60000000 END - started_us) / 1000000.0 AS lasted_s, track_id % 2 <> 0 AS open FROM tr WHERE global_id IS NOT NULL")
def presence_listing(t: Lake) -> DataFrame:
    rows = t.tracks().filter("global_id IS NOT NULL").select(F.col("track_id").alias("episode_id"), "global_id", "camera_id", F.col("started_us").alias("present_us"), (F.col("started_us") + M).alias("confirmed_us"), F.when(F.col("track_id") % 2 == 0, F.col("ended_us")).alias("departed_us"))
    names = t.spark.createDataFrame([("id-3", "Ana")], "global_id string, name string")
    return presence.listing(rows, names).select("episode_id", "name", "lasted_s", "open")


@query("left_by_vehicle", f"""p AS (SELECT camera_id % 10 AS g, event_id % 3 AS v, at_us, event_id, lag(at_us) OVER w AS b FROM ev WHERE kind = 'purchase' WINDOW w AS (PARTITION BY camera_id % 10, event_id % 3 ORDER BY at_us, event_id))
    SELECT g AS person_gid, v AS vehicle_gid, at_us FROM p WHERE b IS NULL OR at_us - b > {6 * H}""")
def left_by_vehicle(t: Lake) -> DataFrame:
    rows = t.events().filter("kind = 'purchase'").select((F.col("camera_id") % 10).alias("person_gid"), (F.col("event_id") % 3).alias("vehicle_gid"), "at_us", F.col("event_id").alias("episode_id"))
    return presence.left_by_vehicle(rows, 6 * H)


@query("unlinked_media", "SELECT 'p/' || track_id AS path FROM tr WHERE track_id % 6 = 0 AND track_id % 4 <> 0")
def unlinked_media(t: Lake) -> DataFrame:
    rows = t.tracks().select("track_id", F.col("thumbnail").alias("path"))
    return retention.unreferenced(rows.filter("track_id % 6 = 0"), rows.filter("track_id % 4 = 0"))


@query("deleted_rows", f"SELECT event_id FROM ev WHERE at_us > {UNTIL - 10 * D} AND camera_id % 5 <> 0 AND camera_id % 2 = 0")
def deleted_rows(t: Lake) -> DataFrame:
    rows = retention.young(t.events(), "at_us", UNTIL, 10)
    kept = retention.kept(rows, t.cameras().filter("camera_id % 5 = 0"), "camera_id")
    return retention.media_gone(kept, t.cameras().filter("camera_id % 2 = 0"), "camera_id").select("event_id")


@query("incident_actions", """f AS (SELECT camera_id, camera_id % 2 = 0 AS tripped, camera_id % 3 = 0 AS cleared FROM cam), x AS (SELECT *, camera_id % 5 = 0 AS live, camera_id % 7 = 0 AS recent FROM f)
    SELECT camera_id, CASE WHEN tripped AND NOT live AND NOT recent THEN 'open' ELSE 'close' END AS action FROM x WHERE (tripped AND NOT live AND NOT recent) OR (cleared AND live)""")
def incident_actions(t: Lake) -> DataFrame:
    c = F.col("camera_id")
    flags = t.cameras().select("camera_id", F.lit("drop_spike").alias("kind"), (c % 2 == 0).alias("tripped"), (c % 3 == 0).alias("cleared"))
    known = t.cameras().filter("camera_id % 5 = 0").select("camera_id", F.lit("drop_spike").alias("kind"), F.lit("open").alias("status"), F.lit(0).cast("long").alias("opened_us"))
    late = t.cameras().filter("camera_id % 7 = 0").select("camera_id", F.lit("drop_spike").alias("kind"), F.lit("closed").alias("status"), F.lit(UNTIL - H).alias("opened_us"))
    return telemetry.incident_actions(flags, known.unionByName(late), UNTIL).select("camera_id", "action")


@query("incident_changes", """c AS (SELECT event_id AS change_id, camera_id, ['min_confidence', 'idle_fps', 'password', 'min_box_pct'][event_id % 4 + 1] AS field, CAST(event_id % 130 AS VARCHAR) AS value FROM ev)
    SELECT change_id, CASE WHEN field = 'password' THEN 'unknown field' WHEN camera_id % 10 = 0 THEN 'unknown camera' WHEN field = 'min_confidence' AND CAST(value AS DOUBLE) > 1 OR field <> 'min_confidence' AND CAST(value AS DOUBLE) > 100 THEN 'out of range' END AS refused FROM c""")
def incident_changes(t: Lake) -> DataFrame:
    fields = F.element_at(F.array(*map(F.lit, ("min_confidence", "idle_fps", "password", "min_box_pct"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = t.events().select(F.col("event_id").alias("change_id"), "camera_id", fields.alias("field"), (F.col("event_id") % 130).cast("string").alias("value"))
    allowed = {"min_confidence": (0.0, 1.0), "idle_fps": (0.0, 100.0), "min_box_pct": (0.0, 100.0)}
    known = t.spark.range(1, 100_000).select(F.col("id").alias("camera_id")).filter("camera_id % 10 <> 0")
    return telemetry.checked_changes(rows, allowed, known).select("change_id", "refused")


@query("replay_changes", """s AS (SELECT * FROM (VALUES ('now', 0.3), ('then', 0.5)) x(rule_set, mc)), g AS (SELECT rule_set, camera_id, class_id, count(*) FILTER (confidence >= mc) AS b FROM sa, s GROUP BY ALL)
    SELECT camera_id, class_id, CAST(coalesce(sum(b) FILTER (rule_set = 'then'), 0) - coalesce(sum(b) FILTER (rule_set = 'now'), 0) AS BIGINT) AS births_change FROM g GROUP BY ALL""")
def replay_changes(t: Lake) -> DataFrame:
    table = [(s, k, True, c, 0.0) for s, c in (("now", 0.3), ("then", 0.5)) for k in range(5)]
    sets = t.spark.createDataFrame(table, "rule_set string, class_id int, enabled boolean, min_confidence double, min_box_pct double")
    return telemetry.replay_changes(telemetry.replayed(t.samples().withColumn("maintain", F.lit(0.0)), sets), "now", "then")


@query("duty_cycle", f"SELECT camera_id, at_us - at_us % {30 * M} AS bucket_us, CAST(sum(event_id % 40) AS DOUBLE) AS active_s, round(sum(event_id % 40) / CAST(nullif(sum(60), 0) AS DOUBLE), 9) AS duty FROM ev GROUP BY ALL")
def duty_cycle(t: Lake) -> DataFrame:
    a = (F.col("event_id") % 40).cast("double")
    rows = t.events().select("camera_id", "at_us", F.lit("ingestor").alias("source"), F.to_json(F.struct(a.alias("active_s"), (60 - a).alias("idle_s"))).alias("payload"))
    return telemetry.duty(rows).select("camera_id", "bucket_us", "active_s", F.round("duty", 9).alias("duty"))


@query("scene_unsure", """p AS (SELECT camera_id, at_us, CASE WHEN kind = 'error' THEN 'unknown' ELSE kind END AS s FROM ev), q AS (SELECT *, last_value(CASE WHEN s <> 'unknown' THEN s END IGNORE NULLS) OVER w AS k, last_value(CASE WHEN s <> 'unknown' THEN at_us END IGNORE NULLS) OVER w AS t, first_value(at_us) OVER w AS f FROM p WINDOW w AS (PARTITION BY camera_id ORDER BY at_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT camera_id, at_us, CASE WHEN s <> 'unknown' THEN s WHEN at_us - coalesce(t, f) >= 36000000000 THEN 'unknown' ELSE coalesce(k, 'unknown') END AS shown FROM q""")
def scene_unsure(t: Lake) -> DataFrame:
    rows = t.events().select("camera_id", "at_us", F.when(F.col("kind") == "error", "unknown").otherwise(F.col("kind")).alias("s"))
    return telemetry.unsure(rows, ["camera_id"], "at_us", "s", 10 * H).select("camera_id", "at_us", "shown")


@query("upsert", "SELECT camera_id, CASE WHEN camera_id % 3 = 0 THEN 'new-' || camera_id ELSE slug END AS slug FROM cam UNION ALL SELECT 1000000 + camera_id, 'new-' || (1000000 + camera_id) FROM cam WHERE camera_id % 3 = 0")
def upsert(t: Lake) -> DataFrame:
    c = t.cameras().select("camera_id", "slug")
    third = c.filter("camera_id % 3 = 0").select("camera_id")
    ids = third.union(third.select(F.col("camera_id") + 1_000_000)).withColumn("slug", F.concat(F.lit("new-"), F.col("camera_id").cast("string"))).withColumn("seq", F.lit(2))
    return sinks.merged(c, ids.unionByName(ids.withColumn("slug", F.lit("old")).withColumn("seq", F.lit(1))), ["camera_id"], "seq")


@query("heat_upsert", "c AS (SELECT camera_id % 4 AS camera_id, event_id % 3 AS cell, count(*) AS n FROM ev GROUP BY ALL), a AS (SELECT camera_id, list(n ORDER BY cell) AS cells FROM c GROUP BY 1) SELECT camera_id, CASE WHEN camera_id = 2 THEN cells ELSE list_transform(cells, lambda x: 2 * x) END AS cells FROM a")
def heat_upsert(t: Lake) -> DataFrame:
    counts = t.events().groupBy((F.col("camera_id") % 4).alias("camera_id"), (F.col("event_id") % 3).alias("cell")).agg(F.count("*").alias("n"))
    arrays = counts.groupBy("camera_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "n"))), lambda x: x["n"]).alias("cells"))
    return sinks.heat_merged(arrays.filter("camera_id <> 2"), arrays, ["camera_id"])


@query("event_routes", "SELECT event_id, CASE kind WHEN 'click' THEN 'bell' WHEN 'purchase' THEN 'place' ELSE 'event' END AS subject, slug FROM ev LEFT JOIN cam USING (camera_id)")
def event_routes(t: Lake) -> DataFrame:
    rows = t.events().withColumn("kind", F.when(F.col("kind") == "click", "doorbell").when(F.col("kind") == "purchase", "place_filled").otherwise(F.col("kind")))
    return sinks.routed(rows, t.cameras()).select("event_id", "subject", "slug")


@query("state_changes", "SELECT camera_id, CASE WHEN camera_id % 3 = 0 THEN '{}' ELSE 's' || camera_id % 5 END AS body FROM cam WHERE NOT (camera_id % 2 = 0 AND camera_id % 3 <> 0)")
def state_changes(t: Lake) -> DataFrame:
    c = F.col("camera_id")
    now = t.cameras().select("camera_id", F.when(c % 3 != 0, F.concat(F.lit("s"), (c % 5).cast("string"))).alias("body"))
    before = t.cameras().filter(c % 2 == 0).select("camera_id", F.concat(F.lit("s"), (c % 5).cast("string")).alias("body"))
    return sinks.changed_states(now, before)


@query("newest_in_queue", "SELECT event_id FROM ev QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY at_us DESC) <= 8")
def newest_in_queue(t: Lake) -> DataFrame:
    return sinks.keep_newest(t.events(), ["camera_id"], "at_us", 8).select("event_id")


@query("event_keys", "SELECT event_id, sha1(camera_id || chr(1) || track_id || chr(1) || kind || chr(1) || chr(0) || chr(1) || at_us) AS event_key FROM ev")
def event_keys(t: Lake) -> DataFrame:
    return sinks.keyed_events(t.events()).select("event_id", "event_key")


@query("roster", """SELECT camera_id, coalesce(z, 0) AS zones, coalesce(r, 0) AS regions, f AS first_zone FROM cam LEFT JOIN (SELECT camera_id, count(*) AS z, min(event_id) AS f FROM ev WHERE kind = 'view' GROUP BY 1) USING (camera_id) LEFT JOIN (SELECT camera_id, count(*) AS r FROM ev WHERE kind = 'click' GROUP BY 1) USING (camera_id)""")
def roster(t: Lake) -> DataFrame:
    zones = t.events().filter("kind = 'view'").select("camera_id", F.col("event_id").alias("zone_id"), "kind")
    regions = t.events().filter("kind = 'click'").select("camera_id", F.col("event_id").alias("region_id"), F.col("kind").alias("place"))
    got = rules.roster(t.cameras().select("camera_id"), zones, regions)
    return got.select("camera_id", F.size("zones").cast("long").alias("zones"), F.size("regions").cast("long").alias("regions"), F.get("zones", F.lit(0))["zone_id"].alias("first_zone"))


@query("rule_snapshot", "SELECT camera_id, list(class_id ORDER BY class_id) AS classes, list(camera_id * 10 + class_id ORDER BY class_id) AS values FROM (SELECT camera_id, k AS class_id FROM cam, range(0, 5) x(k) WHERE (camera_id + k) % 3 > 0) GROUP BY 1")
def rule_snapshot(t: Lake) -> DataFrame:
    rows = t.cameras().select("camera_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("class_id")).filter((F.col("camera_id") + F.col("class_id")) % 3 > 0)
    got = rules.snapshot(rows.withColumn("value", F.col("camera_id") * 10 + F.col("class_id")))
    return got.select("camera_id", F.col("rules.class_id").alias("classes"), F.col("rules.value").alias("values"))


@query("journal_revert", "SELECT camera_id AS incident_id, arg_max(kind, at_us) AS before FROM ev GROUP BY 1")
def journal_revert(t: Lake) -> DataFrame:
    return rules.reverted(t.events().select(F.col("camera_id").alias("incident_id"), "at_us", F.col("event_id").alias("entry_id"), F.col("kind").alias("before")))


@query("work_lists", f"""w AS (SELECT track_id FROM tr WHERE track_id % 3 <> 0 ORDER BY started_us DESC, track_id LIMIT 200), l AS (SELECT camera_id, max(at_us) AS m FROM ev GROUP BY 1)
    SELECT 'work' AS list, track_id AS id FROM w UNION ALL SELECT 'retry', camera_id FROM cam LEFT JOIN l USING (camera_id) WHERE m IS NULL OR m <= {UNTIL - D}""")
def work_lists(t: Lake) -> DataFrame:
    rows = t.tracks().select("track_id", "started_us")
    work = rules.work_list(rows, rows.filter("track_id % 3 = 0"), "track_id", "started_us", 200).select(F.lit("work").alias("list"), F.col("track_id").alias("id"))
    retry = rules.retry_list(t.cameras(), t.events(), "camera_id", UNTIL, D).select(F.lit("retry").alias("list"), F.col("camera_id").alias("id"))
    return work.union(retry)


@query("free_colour", "u AS (SELECT DISTINCT camera_id % 12 AS c FROM cam WHERE camera_id % 12 <> 7) SELECT CAST(min(i) AS INTEGER) AS colour FROM range(0, 12) x(i) WHERE i NOT IN (SELECT c FROM u)")
def free_colour(t: Lake) -> DataFrame:
    return analytics.first_free_colour(t.cameras().select((F.col("camera_id") % 12).cast("int").alias("colour")).filter("colour <> 7"))


@query("event_list", """w AS (SELECT ev.event_id, ev.at_us - 800000000000000 AS t, ev.camera_id % 20 AS cam, tr.class_name FROM ev LEFT JOIN tr ON tr.track_id = ev.track_id), m AS (SELECT w.event_id, recording_id, coalesce(ended_us, started_us + 120000000) AS u, t, row_number() OVER (PARTITION BY event_id ORDER BY started_us DESC, recording_id DESC) AS n FROM w JOIN rec ON rec.camera_id = w.cam AND rec.started_us <= w.t)
    SELECT w.event_id, w.class_name, CASE WHEN m.u > m.t THEN recording_id END AS recording_id FROM w LEFT JOIN m ON m.event_id = w.event_id AND m.n = 1""")
def event_list(t: Lake) -> DataFrame:
    rows = t.events().withColumn("at_us", F.col("at_us") - 800_000_000_000_000)
    return visits.event_list(rows, t.tracks(), t.recordings(), F.col("camera_id") % 20).select("event_id", "class_name", "recording_id")


@query("identity_detail", """SELECT global_id, count(*) AS n_tracks, CASE WHEN global_id = 'id-3' THEN 'Ana' ELSE any_value(identity_name) END AS name, bool_or(face_verified) AS face_confirmed, list(track_id ORDER BY started_us, track_id) AS track_ids, list(DISTINCT camera_id ORDER BY camera_id) AS cameras FROM tr WHERE global_id IS NOT NULL GROUP BY 1""")
def identity_detail(t: Lake) -> DataFrame:
    names = t.spark.createDataFrame([("id-3", "Ana")], "global_id string, name string")
    got = identity.detail(t.tracks(), names)
    return got.select("global_id", "n_tracks", "name", "face_confirmed", F.col("tracks.track_id").alias("track_ids"), "cameras")


@query("plate_rematch", """SELECT track_id, CASE WHEN plate_text = 'ZG24' THEN 'car-a' WHEN plate_text IS NOT NULL AND plate_text LIKE '%8' THEN 'car-b' ELSE global_id END AS global_id FROM tr""")
def plate_rematch(t: Lake) -> DataFrame:
    found = t.tracks().filter("plate_text IS NOT NULL").select(F.col("plate_text").alias("plate"), F.when(F.col("plate_text") == "ZG24", "car-a").when(F.col("plate_text").endswith("8"), "car-b").alias("global_id")).distinct()
    return plates.rematched(t.tracks(), found, "plate_text").select("track_id", "global_id")


@query("late_faces", f"""SELECT track_id, CASE WHEN track_id % 3 <> 0 AND track_id % 8 = 0 THEN 'face-' || track_id % 4 ELSE global_id END AS global_id, track_id % 3 <> 0 AND track_id % 8 = 0 OR face_verified AS face_verified,
    CASE WHEN track_id % 3 <> 0 AND track_id % 8 = 0 THEN ended_us + {90 * D} END AS retain_until_us FROM tr""")
def late_faces(t: Lake) -> DataFrame:
    won = t.tracks().filter("track_id % 8 = 0").select("track_id", F.concat(F.lit("face-"), (F.col("track_id") % 4).cast("string")).alias("global_id"), F.lit(0.2).alias("distance"))
    return identity.late_named(t.tracks(), won, 90).select("track_id", "global_id", "face_verified", "retain_until_us")


@query("tar_at_far", f"""m AS (SELECT p.vec_id, r.label, min({COS.format(a='p.v', b='r.v')}) AS d FROM vec p, vec r WHERE p.vec_id % 2 = 1 AND r.vec_id % 2 = 0 GROUP BY ALL), r AS (SELECT d, m.label = vec.label AS same FROM m JOIN vec USING (vec_id)), q AS (SELECT quantile_cont(d, 0.01) FILTER (NOT same) AS t FROM r)
    SELECT round(any_value(t), 4) AS threshold, round(avg(CASE WHEN d < t THEN 1.0 ELSE 0.0 END) FILTER (same), 4) AS tar FROM r, q""")
def tar_at_far(t: Lake) -> DataFrame:
    v = t.vectors()
    d = identity.distances(v.filter("vec_id % 2 = 1"), v.filter("vec_id % 2 = 0"), "vec_id", "label", "v")
    got = identity.tar_at_far(d, "vec_id", "label", v.select("vec_id", "label"), 0.01)
    return got.select(*(F.round(c, 4).alias(c) for c in got.columns))


@query("sticky_light", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'ir' WHEN event_id % 3 = 0 AND value >= 32 AND value <= 98 THEN 'dim' WHEN value < 40 THEN 'dark' WHEN value < 90 THEN 'dim' WHEN value < 150 THEN 'normal' ELSE 'bright' END AS band FROM ev""")
def sticky_light(t: Lake) -> DataFrame:
    held = F.when(F.col("event_id") % 3 == 0, "dim")
    return t.events().select("event_id", telemetry.sticky_band(F.col("value"), F.when(F.col("event_id") % 10 == 0, 0.6).otherwise(0.1), held).alias("band"))


@query("scene_light", "SELECT camera_id, round(avg(value), 6) AS luma, round(avg((abs(event_id % 256 - 128) + abs((event_id * 3) % 256 - 128)) / 2.0), 6) AS chroma, round(avg(CASE WHEN event_id % 256 = 128 THEN 1.0 ELSE 0.0 END), 6) AS ir_ratio FROM ev GROUP BY 1")
def scene_light(t: Lake) -> DataFrame:
    e = F.col("event_id")
    rows = t.events().select("camera_id", F.col("value").alias("y"), (e % 256).cast("double").alias("u"), (e * 3 % 256).cast("double").alias("v"))
    got = telemetry.light_sample(rows, ["camera_id"], F.col("u") == 128)
    return got.select("camera_id", *(F.round(c, 6).alias(c) for c in ("luma", "chroma", "ir_ratio")))


@query("headlights", f"""b AS (SELECT camera_id, event_id, at_us, value, avg(value) OVER (PARTITION BY camera_id ORDER BY at_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base FROM ev), h AS (SELECT * FROM b WHERE event_id % 4 > 0 AND base > 0 AND value > base * 2.0), g AS (SELECT *, lag(at_us) OVER (PARTITION BY camera_id ORDER BY at_us) AS p FROM h) SELECT event_id FROM g WHERE p IS NULL OR at_us - p > {H}""")
def headlights(t: Lake) -> DataFrame:
    rows = t.events().select("camera_id", "event_id", "at_us", F.col("value").alias("luma"), (F.col("event_id") % 4 > 0).alias("night"))
    return telemetry.headlights(rows, ["camera_id"], 2.0, 20, H).select("event_id")
