"""Registered queries over the logical tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload, quantiles
from ..functions import times as T
from ..functions import vectors as V
from ..operators import analytics, asof, detection, islands, rangejoin, ranked, recordings, retention, visits
from ..sources import tables
from .logical import Lake, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
        QUERIES[name] = lambda spark, root: f(Lake(spark, root))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return f

    return add


H, D = T.HOUR, T.DAY
SINCE, UNTIL = 1_704_067_200_000_000, 1_704_067_200_000_000 + 30 * D  # January 2024


@query("events_by_hour", f"SELECT at_us - at_us % {H} AS hour_us, count(*) AS n FROM ev WHERE at_us >= {SINCE} AND at_us < {UNTIL} GROUP BY 1")
def events_by_hour(t: Lake) -> DataFrame:
    return analytics.events_by_hour(t.events(), SINCE, UNTIL)


@query(
    "events_by_hour_dense",
    f"""c AS (SELECT at_us - at_us % {H} AS hour_us, count(*) AS n FROM ev GROUP BY 1)
    SELECT r.h AS hour_us, coalesce(n, 0) AS n FROM (SELECT unnest(range({SINCE}, {UNTIL}, {H})) AS h) r LEFT JOIN c ON c.hour_us = r.h""",
)
def events_by_hour_dense(t: Lake) -> DataFrame:
    return analytics.dense_hours(analytics.events_by_hour(t.events(), SINCE, UNTIL), SINCE, UNTIL)


@query("events_hour_peak", f"""c AS (SELECT at_us // {H} AS h, count(*) AS n FROM ev GROUP BY 1),
    d AS (SELECT coalesce(n, 0) AS n FROM (SELECT unnest(range({SINCE}, {UNTIL}, {H})) // {H} AS h) r LEFT JOIN c USING (h))
    SELECT avg(n) AS average, max(n) AS peak FROM d""")
def events_hour_peak(t: Lake) -> DataFrame:
    return analytics.hour_summary(events_by_hour_dense(t))


@query("events_by_camera", f"""SELECT c.camera_id, c.slug, coalesce(n, 0) AS n FROM cam c LEFT JOIN
    (SELECT camera_id, count(*) AS n FROM ev WHERE at_us >= {SINCE} AND at_us < {SINCE + 20 * D} GROUP BY 1) e USING (camera_id)""")
def events_by_camera(t: Lake) -> DataFrame:
    rows = analytics.where(t.events(), [analytics.in_window(F.col("at_us"), SINCE, SINCE + 20 * D)])
    return analytics.per_camera(t.cameras().select("camera_id", "slug"), rows, {"n": F.count("*")})


@query("events_by_kind", "SELECT kind, count(*) AS n FROM ev GROUP BY 1")
def events_by_kind(t: Lake) -> DataFrame:
    return analytics.by_kind(t.events())


@query("dashboard_stats", f"""SELECT e.*, r.* FROM (SELECT count(*) AS events, count(*) FILTER (at_us >= {UNTIL - D}) AS events_day, count(DISTINCT kind) AS kinds,
    count(DISTINCT camera_id) FILTER (at_us >= {UNTIL - D}) AS active_cameras FROM ev) e, (SELECT count(*) AS segments, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM rec) r""")
def dashboard_stats(t: Lake) -> DataFrame:
    return analytics.dashboard(t.events(), t.recordings(), UNTIL)


@query("storage_usage", """SELECT c.camera_id, c.slug, coalesce(segments, 0) AS segments, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, coalesce(oldest_us, 0) AS oldest_us, coalesce(newest_us, 0) AS newest_us
    FROM cam c LEFT JOIN (SELECT camera_id, count(*) AS segments, sum(size_bytes) AS bytes, min(started_us) AS oldest_us, max(started_us) AS newest_us FROM rec GROUP BY 1) r USING (camera_id)""")
def storage_usage(t: Lake) -> DataFrame:
    measures = {"segments": F.count("*"), "bytes": F.sum("size_bytes"), "oldest_us": F.min("started_us"), "newest_us": F.max("started_us")}
    return analytics.per_camera(t.cameras().select("camera_id", "slug"), t.recordings(), measures)


@query("event_facets", "SELECT list_sort(list(DISTINCT kind)) AS kind, list_sort(list(DISTINCT camera_id % 7)) AS slot FROM ev")
def event_facets(t: Lake) -> DataFrame:
    return analytics.facets(t.events().withColumn("slot", F.col("camera_id") % 7), ["kind", "slot"])


@query("default_kinds", "SELECT event_id, kind FROM ev WHERE kind <> 'signup'")
def default_kinds(t: Lake) -> DataFrame:
    rows = t.events().withColumn("kind", F.when(F.col("kind") == "signup", "track_finalized").otherwise(F.col("kind")))
    return rows.filter(analytics.wanted_kinds(F.col("kind"), None)).select("event_id", "kind")


@query("tracks_overlapping", f"SELECT track_id FROM tr WHERE ended_us >= {900_000_000_000_000} AND started_us < {910_000_000_000_000}")
def tracks_overlapping(t: Lake) -> DataFrame:
    return t.tracks().filter(analytics.overlaps_window(F.col("started_us"), F.col("ended_us"), 900_000_000_000_000, 910_000_000_000_000)).select("track_id")


@query("active_or_unknown", "SELECT track_id FROM tr WHERE suppressed_reason IS NULL AND NOT (reid_group = 'vehicle' AND ever_active IS NOT DISTINCT FROM FALSE)")
def active_or_unknown(t: Lake) -> DataFrame:
    rows = tables.visible(t.tracks())
    return rows.filter(~((F.col("reid_group") == "vehicle") & F.col("ever_active").eqNullSafe(False))).select("track_id")


@query("evidence_gate", "SELECT track_id FROM tr WHERE face_verified OR identity_name IS NOT NULL OR EXISTS (SELECT 1 FROM sa WHERE sa.track_id = tr.track_id AND sa.confidence > 0.9)")
def evidence_gate(t: Lake) -> DataFrame:
    strong = t.samples().filter(F.col("confidence") > 0.9).select("track_id", F.lit(True).alias("_seen")).distinct()
    got = t.tracks().join(strong, "track_id", "left")
    return got.filter(F.col("face_verified") | F.col("identity_name").isNotNull() | F.coalesce("_seen", F.lit(False))).select("track_id")


@query("suppressed_tracks", "SELECT track_id, suppressed_reason FROM tr WHERE suppressed_reason IS NOT NULL ORDER BY started_us DESC, track_id DESC LIMIT 100")
def suppressed_tracks(t: Lake) -> DataFrame:
    return tables.suppressed(t.tracks(), 100).select("track_id", "suppressed_reason")


@query("ilike_search", "SELECT camera_id, slug FROM cam WHERE slug ILIKE '%ER#0000001%'")
def ilike_search(t: Lake) -> DataFrame:
    return t.cameras().filter(F.col("slug").ilike("%ER#0000001%")).select("camera_id", "slug")


@query("newest_events", "SELECT event_id, at_us FROM ev ORDER BY at_us DESC, event_id DESC LIMIT 50")
def newest_events(t: Lake) -> DataFrame:
    return t.events().orderBy(F.col("at_us").desc(), F.col("event_id").desc()).limit(50).select("event_id", "at_us")


VISIT_RUNS = """p AS (SELECT *, max(ended_us) OVER (PARTITION BY camera_id, reid_group ORDER BY started_us, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM tr),
    r AS (SELECT *, sum(CASE WHEN reached IS NULL OR started_us - reached > 120000000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, reid_group ORDER BY started_us, track_id ROWS UNBOUNDED PRECEDING) AS run FROM p)"""


@query("visits", f"""{VISIT_RUNS},
    c AS (SELECT camera_id, reid_group, run, class_name, count(*) AS votes, min(started_us) AS f FROM r GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY camera_id, reid_group, run ORDER BY votes DESC, f, class_name) AS n FROM c)
    SELECT r.camera_id, r.reid_group, min(started_us) AS started_us, max(ended_us) AS ended_us, count(*) AS n_tracks, CAST(sum(n_observations) AS BIGINT) AS n_observations,
      first(thumbnail ORDER BY ended_us - started_us DESC, started_us, track_id) AS thumbnail,
      first(plate_text ORDER BY started_us, track_id) FILTER (plate_text IS NOT NULL) AS plate_text,
      first(identity_name ORDER BY n_observations DESC, started_us, track_id) FILTER (identity_name IS NOT NULL) AS identity_name,
      bool_or(face_verified) AS face_verified, any_value(m.class_name) AS class_name, list_sort(list(track_id)) AS track_ids
    FROM r JOIN m ON m.n = 1 AND r.camera_id = m.camera_id AND r.reid_group = m.reid_group AND r.run = m.run GROUP BY r.camera_id, r.reid_group, r.run""")
def visit_rows(t: Lake) -> DataFrame:
    return visits.visits(t.tracks()).select("camera_id", "reid_group", "started_us", "ended_us", "n_tracks", "n_observations", "thumbnail", "plate_text", "identity_name", "face_verified", "class_name", "track_ids")


@query("track_majority_class", """c AS (SELECT track_id, class_id, count(*) AS votes, min(at_us) AS f FROM sa GROUP BY ALL)
    SELECT track_id, class_id, votes FROM c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, f, class_id) = 1""")
def track_majority_class(t: Lake) -> DataFrame:
    return ranked.majority(t.samples(), ["track_id"], "class_id", "at_us")


@query("coverage_merge", """p AS (SELECT camera_id, recording_id, started_us, coalesce(ended_us, started_us + 60000000) AS e FROM rec),
    q AS (SELECT *, max(e) OVER (PARTITION BY camera_id ORDER BY started_us, recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM p),
    r AS (SELECT *, sum(CASE WHEN reached IS NULL OR started_us - reached > 2000000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY started_us, recording_id ROWS UNBOUNDED PRECEDING) AS run FROM q)
    SELECT camera_id, min(started_us) AS started_us, max(e) AS ended_us, count(*) AS pieces FROM r GROUP BY camera_id, run""")
def coverage_merge(t: Lake) -> DataFrame:
    return recordings.coverage(t.recordings())


ASOF = """p AS (SELECT track_id, camera_id, {t} AS t FROM tr), s AS (SELECT *, coalesce(ended_us, started_us + 120000000) AS u FROM rec),
    m AS (SELECT p.track_id, p.t, s.recording_id, s.u, row_number() OVER (PARTITION BY p.track_id ORDER BY s.started_us DESC, s.recording_id DESC) AS n FROM p JOIN s ON p.camera_id = s.camera_id AND s.started_us <= p.t)"""


@query("asof_cover", ASOF.format(t="started_us") + "SELECT tr.track_id, CASE WHEN m.u > m.t THEN m.recording_id END AS recording_id FROM tr LEFT JOIN m ON m.track_id = tr.track_id AND m.n = 1")
def asof_cover(t: Lake) -> DataFrame:
    return recordings.covering_segment(t.tracks().select("track_id", "camera_id", "started_us"), t.recordings(), "started_us", ["recording_id"]).select("track_id", "recording_id")


@query("lateral_cover", """m AS (SELECT tr.track_id, rec.recording_id, row_number() OVER (PARTITION BY tr.track_id ORDER BY rec.started_us DESC, rec.recording_id DESC) AS n
    FROM tr JOIN rec ON tr.camera_id = rec.camera_id AND rec.started_us <= tr.started_us AND tr.started_us < coalesce(rec.ended_us, rec.started_us + 120000000))
    SELECT tr.track_id, m.recording_id FROM tr LEFT JOIN m ON m.track_id = tr.track_id AND m.n = 1""")
def lateral_cover(t: Lake) -> DataFrame:
    r = t.recordings().withColumn("until_us", T.covers_until(F.col("started_us"), F.col("ended_us")))
    points = t.tracks().select("track_id", "camera_id", F.col("started_us").alias("at"))
    return rangejoin.covering(points, r, ["camera_id"], "track_id", "at", "started_us", "until_us", ["recording_id"], "recording_id", 10 * T.MINUTE).select("track_id", "recording_id")


@query("asof_fallback", """s AS (SELECT *, coalesce(ended_us, started_us + 120000000) AS u FROM rec),
    p AS (SELECT track_id, camera_id, started_us AS t, 1 AS w FROM tr UNION ALL SELECT track_id, camera_id, started_us + (ended_us - started_us) // 2, 2 FROM tr),
    m AS (SELECT p.track_id, p.w, p.t, s.recording_id, s.u, row_number() OVER (PARTITION BY p.track_id, p.w ORDER BY s.started_us DESC, s.recording_id DESC) AS n FROM p JOIN s ON p.camera_id = s.camera_id AND s.started_us <= p.t),
    g AS (SELECT track_id, w, CASE WHEN u > t THEN recording_id END AS r FROM m WHERE n = 1)
    SELECT tr.track_id, coalesce(a.r, b.r) AS recording_id FROM tr LEFT JOIN g a ON a.track_id = tr.track_id AND a.w = 1 LEFT JOIN g b ON b.track_id = tr.track_id AND b.w = 2""")
def asof_fallback(t: Lake) -> DataFrame:
    return recordings.covering_or_middle(t.tracks().select("track_id", "camera_id", "started_us", "ended_us"), t.recordings(), "started_us", "ended_us").select("track_id", "recording_id")


@query("nearest_within", """m AS (SELECT tr.track_id, rec.recording_id, abs(rec.started_us - tr.started_us) AS gap_us, row_number() OVER (PARTITION BY tr.track_id ORDER BY abs(rec.started_us - tr.started_us), rec.recording_id) AS n
    FROM tr JOIN rec ON tr.camera_id = rec.camera_id AND abs(rec.started_us - tr.started_us) <= 3600000000) SELECT tr.track_id, recording_id, gap_us FROM tr LEFT JOIN m ON m.track_id = tr.track_id AND n = 1""")
def nearest_within(t: Lake) -> DataFrame:
    return rangejoin.nearest(t.tracks().select("track_id", "camera_id", F.col("started_us").alias("at")), t.recordings(), ["camera_id"], "track_id", "at", "started_us", H, ["recording_id"], "recording_id").select("track_id", "recording_id", "gap_us")


@query("overlap_pin", """l AS (SELECT max(ended_us) AS last FROM tr)
    SELECT recording_id, max(tr.ended_us + 86400000000) AS retain_until_us FROM rec, l, tr
    WHERE rec.camera_id = tr.camera_id AND tr.class_id = 0 AND rec.started_us <= tr.ended_us + 60000000 AND coalesce(rec.ended_us, greatest(last, rec.started_us)) >= tr.started_us - 60000000 GROUP BY 1""")
def overlap_pin(t: Lake) -> DataFrame:
    persons = t.tracks().withColumn("class_id", F.col("class_id"))
    last = persons.agg(F.max("ended_us").alias("m"))
    own = persons.filter("class_id = 0")
    return _pins(t.recordings(), own, last)


def _pins(rec: DataFrame, persons: DataFrame, last: DataFrame) -> DataFrame:
    closed = rec.crossJoin(F.broadcast(last)).withColumn("ended_us", F.coalesce("ended_us", F.greatest("m", "started_us"))).drop("m")  # one row
    return recordings.pins(closed, persons, T.MINUTE, F.col("ended_us") + D)


@query("overlap_anti", """SELECT recording_id FROM rec WHERE ended_us IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.camera_id = rec.camera_id
    AND tr.started_us - 60000000 <= rec.ended_us AND tr.ended_us + 60000000 >= rec.started_us)""")
def overlap_anti(t: Lake) -> DataFrame:
    return recordings.idle(t.recordings(), t.tracks(), T.MINUTE).select("recording_id")


@query("semi_exists_window", "SELECT event_id FROM ev WHERE kind = 'click' AND EXISTS (SELECT 1 FROM ev o WHERE o.camera_id = ev.camera_id AND o.kind = 'view' AND abs(o.at_us - ev.at_us) <= 3600000000)")
def semi_exists_window(t: Lake) -> DataFrame:
    e = t.events().select("event_id", "camera_id", "kind", "at_us")
    o = e.filter("kind = 'view'").select("camera_id", F.col("at_us").alias("_o"))
    return rangejoin.semi(e.filter("kind = 'click'"), o, "event_id", ["camera_id"], (F.col("at_us") - H, F.col("at_us") + H), (F.col("_o"), F.col("_o")), 2 * H).select("event_id")


@query("anti_not_exists_window", "SELECT event_id FROM ev WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.camera_id = ev.camera_id AND o.kind = 'view' AND abs(o.at_us - ev.at_us) <= 3600000000)")
def anti_not_exists_window(t: Lake) -> DataFrame:
    e = t.events().select("event_id", "camera_id", "kind", "at_us")
    o = e.filter("kind = 'view'").select("camera_id", F.col("at_us").alias("_o"))
    return rangejoin.semi(e.filter("kind = 'click'"), o, "event_id", ["camera_id"], (F.col("at_us") - H, F.col("at_us") + H), (F.col("_o"), F.col("_o")), 2 * H, anti=True).select("event_id")


@query("seen_elsewhere", "SELECT track_id FROM tr WHERE global_id IS NOT NULL AND EXISTS (SELECT 1 FROM tr o WHERE o.global_id = tr.global_id AND o.ended_us > tr.ended_us)")
def seen_elsewhere(t: Lake) -> DataFrame:
    from ..operators import presence

    rows = t.tracks().filter("global_id IS NOT NULL").withColumn("confirmed_us", F.col("ended_us"))
    return presence.seen_elsewhere(rows).select("track_id")


@query("latest_per_key", "SELECT camera_id, track_id FROM tr QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY started_us DESC, track_id DESC) = 1")
def latest_per_key(t: Lake) -> DataFrame:
    return ranked.keep_latest(t.tracks(), ["camera_id"], "started_us", "track_id").select("camera_id", "track_id")


@query("count_with_newest", "SELECT global_id, track_id, count(*) OVER (PARTITION BY global_id) AS n FROM tr WHERE global_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY global_id ORDER BY started_us DESC, track_id DESC) = 1")
def count_with_newest(t: Lake) -> DataFrame:
    rows = t.tracks().filter("global_id IS NOT NULL")
    sums = rows.groupBy("global_id").agg(F.max_by("track_id", F.struct("started_us", "track_id")).alias("track_id"), F.count("*").alias("n"))
    return sums.select("global_id", "track_id", "n")


@query("gap_islands_having", """p AS (SELECT camera_id, at_us, event_id, lag(at_us) OVER (PARTITION BY camera_id ORDER BY at_us, event_id) AS b FROM ev),
    r AS (SELECT *, sum(CASE WHEN b IS NULL OR at_us - b > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
    SELECT camera_id, min(at_us) AS started_us, max(at_us) AS ended_us, count(*) AS pieces FROM r GROUP BY camera_id, run HAVING count(*) >= 3 AND max(at_us) - min(at_us) >= 3600000000""")
def gap_islands_having(t: Lake) -> DataFrame:
    rows = islands.merged(t.events(), ["camera_id"], F.col("at_us"), F.col("at_us"), 6 * H, "event_id")
    return rows.filter((F.col("pieces") >= 3) & (F.col("ended_us") - F.col("started_us") >= H))


@query("successor_close", """SELECT recording_id, coalesce(ended_us, lead(started_us) OVER w) AS ended_us, last_value(codec IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY started_us, recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS codec
    FROM rec WINDOW w AS (PARTITION BY camera_id ORDER BY started_us, recording_id)""")
def successor_close(t: Lake) -> DataFrame:
    return recordings.closed(t.recordings()).select("recording_id", "ended_us", "codec")


@query("evidence_end", """p AS (SELECT camera_id, at_us, value, lag(value) OVER (PARTITION BY camera_id ORDER BY at_us, event_id) AS b, row_number() OVER (PARTITION BY camera_id ORDER BY at_us, event_id) AS n FROM ev)
    SELECT camera_id, max(at_us) AS evidence_us FROM p WHERE n = 1 OR value IS DISTINCT FROM b GROUP BY 1""")
def evidence_end(t: Lake) -> DataFrame:
    rows = t.events().withColumnRenamed("value", "confidence").withColumnRenamed("event_id", "sample_id")
    return visits.evidence_end(rows, ["camera_id"])


@query("running_palette", "SELECT camera_id, CAST((row_number() OVER (ORDER BY camera_id) - 1) % 12 AS INTEGER) AS colour FROM cam")
def running_palette(t: Lake) -> DataFrame:
    return analytics.palette(t.cameras().select("camera_id"), ["camera_id"])


DWELL = """z AS (SELECT camera_id AS track_id, 'gate' AS zone, at_us, event_id, CASE WHEN kind = 'view' THEN 1 ELSE 0 END AS i FROM ev WHERE kind IN ('view', 'click')),
    e AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY track_id ORDER BY at_us, event_id), 0) AS b FROM z),
    s AS (SELECT *, lead(at_us) OVER (PARTITION BY track_id ORDER BY at_us, event_id) AS nx FROM e WHERE i <> b)"""


def _zone_events(t: Lake) -> DataFrame:
    return t.events().withColumn("zone", F.lit("gate"))


@query("zone_dwell_pairs", DWELL + "SELECT track_id, zone, CAST(coalesce(sum(nx - at_us), 0) AS BIGINT) AS dwell_us, count(*) AS n FROM s WHERE i = 1 GROUP BY 1, 2")
def zone_dwell_pairs(t: Lake) -> DataFrame:
    return visits.zone_dwell(_zone_events(t), "view", "click")


@query("zone_pass_spans", DWELL + f", k AS (SELECT camera_id AS track_id, max(at_us) AS ended_us FROM ev GROUP BY 1) SELECT s.track_id, zone, at_us AS enter_us, least(coalesce(nx, ended_us), at_us + {6 * H}) AS exit_us FROM s JOIN k USING (track_id) WHERE i = 1")
def zone_pass_spans(t: Lake) -> DataFrame:
    ends = t.events().groupBy("track_id").agg(F.max("at_us").alias("ended_us"))
    return visits.pass_spans(_zone_events(t), ends, 6 * H, "view", "click")


@query("gallery", """SELECT global_id, count(*) AS n_tracks, count(*) FILTER (face_verified) AS n_faces, min(started_us) AS first_us, max(ended_us) AS last_us, list_sort(list(DISTINCT camera_id)) AS cameras,
    arg_max(thumbnail, n_observations * 10000000 + track_id) AS thumbnail, bool_or(face_verified) AS face_seen FROM tr WHERE global_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def gallery(t: Lake) -> DataFrame:
    from ..operators import identity

    labels = t.spark.createDataFrame([], "global_id string, name string")
    return identity.gallery(t.tracks(), labels, least=2).drop("name")


@query("evidence_union", "SELECT 'photo' AS origin, label AS global_id, count(*) AS n FROM vec WHERE vec_id % 2 = 0 GROUP BY ALL UNION ALL SELECT 'label', label, count(*) FROM vec WHERE vec_id % 5 = 0 GROUP BY ALL")
def evidence_union(t: Lake) -> DataFrame:
    from ..operators import identity

    v = t.vectors().select(F.col("label").alias("global_id"), F.lit("m").alias("model"), F.col("v").alias("embedding"), "vec_id")
    return identity.evidence(v.filter("vec_id % 2 = 0"), v.filter("vec_id % 5 = 0")).groupBy("origin", "global_id").agg(F.count("*").alias("n"))


@query("ids_union", "SELECT global_id FROM tr WHERE global_id IS NOT NULL UNION SELECT 'id-' || (camera_id % 40) FROM cam")
def ids_union(t: Lake) -> DataFrame:
    from ..operators import identity

    return identity.identity_ids(t.tracks(), t.cameras().select(F.concat(F.lit("id-"), (F.col("camera_id") % 40).cast("string")).alias("global_id")))


@query("dominant_value", "c AS (SELECT camera_id, codec, count(*) AS n FROM rec WHERE codec IS NOT NULL GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY n DESC, codec) = 1")
def dominant_value(t: Lake) -> DataFrame:
    return analytics.dominant(t.recordings().filter("codec IS NOT NULL"), ["camera_id"], "codec")


@query("freshness", f"SELECT c.camera_id, ({UNTIL} - m) / 1000000.0 AS age_s, m IS NULL OR {UNTIL} - m > {3000 * D} AS stale FROM cam c LEFT JOIN (SELECT camera_id, max(started_us) AS m FROM rec GROUP BY 1) r USING (camera_id)")
def freshness(t: Lake) -> DataFrame:
    return analytics.freshness(t.cameras(), t.recordings(), UNTIL, 3000 * D)


@query("counter_rates", "p AS (SELECT event_id, event_id - lag(event_id) OVER w AS s, (at_us - lag(at_us) OVER w) / 1000000.0 AS g FROM ev WINDOW w AS (PARTITION BY camera_id ORDER BY at_us)) SELECT event_id, round(CASE WHEN g > 0 AND s >= 0 THEN s / g END, 6) AS rate FROM p")
def counter_rates(t: Lake) -> DataFrame:
    return analytics.rates(t.events(), ["camera_id"], "at_us", "event_id").select("event_id", F.round("rate", 6).alias("rate"))


@query("nearest_rank_quantiles", """s AS (SELECT kind, list_sort(list(value)) AS v FROM ev GROUP BY 1)
    SELECT kind, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INTEGER) + 1] AS p50, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1] AS p95 FROM s""")
def nearest_rank_quantiles(t: Lake) -> DataFrame:
    return quantiles.nearest_rank(t.events(), ["kind"], "value", {"p50": 0.5, "p95": 0.95})


@query("minute_collapse", "SELECT camera_id % 5 AS camera_id, kind, at_us - at_us % 60000000 AS minute_us, min(at_us) AS first_us, max(at_us) AS last_us, count(*) AS n FROM ev GROUP BY ALL")
def minute_collapse(t: Lake) -> DataFrame:
    return analytics.minute_collapse(t.events().withColumn("camera_id", F.col("camera_id") % 5))


@query("json_payload_sum", "SELECT camera_id, CAST(sum(CAST(payload ->> '$.k' AS BIGINT)) AS BIGINT) AS n FROM ev WHERE payload ->> '$.k' IS NOT NULL GROUP BY 1")
def json_payload_sum(t: Lake) -> DataFrame:
    from ..operators import telemetry

    return telemetry.counted_fields(t.events(), "$.k")


@query("payload_keys", "SELECT event_id, json_exists(payload, '$.k') AS has_k, json_exists(payload, '$.z') AS has_z FROM ev")
def payload_keys(t: Lake) -> DataFrame:
    return t.events().select("event_id", payload.has_key(F.col("payload"), "k").alias("has_k"), payload.has_key(F.col("payload"), "z").alias("has_z"))


@query("ordered_lists", "SELECT track_id, list(sample_id ORDER BY sample_id) AS sample_ids, list(confidence ORDER BY sample_id, confidence) AS confidences FROM sa GROUP BY 1")
def ordered_lists(t: Lake) -> DataFrame:
    rows = t.samples()
    lists = rows.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "confidence"))).alias("rows"))
    return lists.select("track_id", F.col("rows.sample_id").alias("sample_ids"), F.col("rows.confidence").alias("confidences"))


@query("gate_classify", """g AS (SELECT *, CASE WHEN class_id = 4 THEN FALSE ELSE TRUE END AS en, CAST(0.2 AS DOUBLE) + class_id * CAST(0.1 AS DOUBLE) AS mc, class_id * CAST(5 AS DOUBLE) AS mb, CASE WHEN camera_id % 3 = 0 THEN NULL ELSE CAST(0.15 AS DOUBLE) END AS mt FROM sa),
    r AS (SELECT *, CASE WHEN NOT en THEN 'disabled' WHEN mb > 0 AND size_pct < mb THEN 'size' WHEN confidence < coalesce(least(mt, mc), mc) THEN 'conf' END AS reason FROM g)
    SELECT camera_id, class_id, coalesce(reason, '-') AS reason, count(*) AS n, count(*) FILTER (reason IS NULL AND confidence >= mc) AS births FROM r GROUP BY ALL""")
def gate_classify(t: Lake) -> DataFrame:
    c = F.col("class_id")
    reason, birth = detection.gate(c != 4, F.lit(0.2) + c * F.lit(0.1), c * F.lit(5.0), F.col("confidence"), F.col("size_pct"), F.when(F.col("camera_id") % 3 != 0, 0.15))
    rows = t.samples().withColumn("_r", reason).withColumn("_b", birth)
    return rows.groupBy("camera_id", "class_id", F.coalesce("_r", F.lit("-")).alias("reason")).agg(F.count("*").alias("n"), F.count_if("_b").alias("births"))


@query("rule_resolution", """w AS (SELECT c.camera_id, k AS class_id FROM cam c, range(0, 8) x(k)),
    g AS (SELECT k AS class_id, k % 2 = 0 AS en, k * 0.1 AS mc, k * 1.0 AS mb FROM range(0, 6) x(k)),
    o AS (SELECT camera_id, camera_id % 8 AS class_id, camera_id % 3 = 0 AS en, CASE WHEN camera_id % 2 = 0 THEN 0.77 END AS mc FROM cam WHERE camera_id % 4 = 0)
    SELECT w.camera_id, CAST(w.class_id AS INTEGER) AS class_id, CASE WHEN g.class_id IS NULL THEN FALSE ELSE coalesce(o.en, g.en) END AS enabled,
      CAST(CASE WHEN g.class_id IS NULL THEN 1.0 ELSE coalesce(o.mc, g.mc) END AS DOUBLE) AS min_confidence, CAST(CASE WHEN g.class_id IS NULL THEN 0.0 ELSE g.mb END AS DOUBLE) AS min_box_pct,
      CASE WHEN g.class_id IS NULL THEN 'not-allowed' WHEN o.camera_id IS NOT NULL THEN 'override' ELSE 'global' END AS source
    FROM w LEFT JOIN g USING (class_id) LEFT JOIN o ON o.camera_id = w.camera_id AND o.class_id = w.class_id""")
def rule_resolution(t: Lake) -> DataFrame:
    cams = t.cameras().select("camera_id")
    wanted = cams.withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(7))))
    k = F.col("id")
    rules = t.spark.range(6).select(k.cast("int").alias("class_id"), (k % 2 == 0).alias("enabled"), (k * F.lit(0.1)).alias("min_confidence"), (k * F.lit(1.0)).alias("min_box_pct"))
    c = F.col("camera_id")
    own = cams.filter(c % 4 == 0).select("camera_id", (c % 8).cast("int").alias("class_id"), (c % 3 == 0).alias("enabled"), F.when(c % 2 == 0, 0.77).alias("min_confidence"), F.lit(None).cast("double").alias("min_box_pct"))
    return detection.effective_rules(wanted, rules, own)


@query("heatmap_cells", """c AS (SELECT camera_id, at_us // 86400000000 AS day, 'person' AS heat_group, CAST(least(floor(y / 360 * 18), 17) * 32 + least(floor(x / 640 * 32), 31) AS INTEGER) AS cell FROM sa)
    SELECT camera_id % 4 AS camera_id, 0 AS day, heat_group, cell, count(*) AS n FROM c GROUP BY ALL""")
def heatmap_cells(t: Lake) -> DataFrame:
    rows = t.samples().select((F.col("camera_id") % 4).alias("camera_id"), F.lit(0).alias("day"), F.lit("person").alias("heat_group"), (F.col("x") / 640).alias("x"), (F.col("y") / 360).alias("y"))
    return analytics.heat_cells(rows)


@query("heatmap_sum", """c AS (SELECT camera_id % 4 AS camera_id, CAST(least(floor(y / 360 * 18), 17) * 32 + least(floor(x / 640 * 32), 31) AS INTEGER) AS cell, count(*) AS n FROM sa GROUP BY ALL),
    g AS (SELECT k.camera_id, r.i, coalesce(n, 0) AS n FROM (SELECT DISTINCT camera_id FROM c) k, (SELECT unnest(range(0, 576)) AS i) r LEFT JOIN c ON c.camera_id = k.camera_id AND c.cell = r.i)
    SELECT camera_id, list(n ORDER BY i) AS cells FROM g GROUP BY 1""")
def heatmap_sum(t: Lake) -> DataFrame:
    rows = t.samples().select((F.col("camera_id") % 4).alias("camera_id"), (F.col("l_linenumber") % 3).alias("day"), F.lit("person").alias("heat_group"), (F.col("x") / 640).alias("x"), (F.col("y") / 360).alias("y"))
    return analytics.heat_sum(analytics.heat_arrays(analytics.heat_cells(rows)), ["camera_id"])


@query("point_in_polygon", """p AS (SELECT sample_id, x / 640 AS x, y / 360 AS y, l_partkey, l_suppkey FROM sa),
    e AS (SELECT * FROM (VALUES (0.1, 0.1, 0.2, 0.8), (0.9, 0.2, 0.1, 0.1), (0.7, 0.9, 0.9, 0.2), (0.5, 0.4, 0.7, 0.9), (0.2, 0.8, 0.5, 0.4)) t(ax, ay, bx, bz))
    SELECT count(*) AS n, CAST(sum(sample_id) AS BIGINT) AS ids FROM (SELECT p.sample_id, p.l_partkey, p.l_suppkey, p.x, p.y FROM p, e
      GROUP BY ALL HAVING count(*) FILTER ((ay > y) <> (bz > y) AND x < (bx - ax) * (y - ay) / (bz - ay) + ax) % 2 = 1) q""")
def point_in_polygon(t: Lake) -> DataFrame:
    from ..functions import geometry as G

    corners = ((0.1, 0.1), (0.9, 0.2), (0.7, 0.9), (0.5, 0.4), (0.2, 0.8))
    polygon = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners))
    rows = t.samples().select("sample_id", (F.col("x") / 640).alias("x"), (F.col("y") / 360).alias("y"), "l_partkey", "l_suppkey").distinct()
    return rows.filter(G.in_polygon(F.col("x"), F.col("y"), polygon)).agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"))


BOXES = "SELECT DISTINCT track_id, l_partkey, l_suppkey, x AS x1, y AS y1, x + size_pct AS x2, y + size_pct AS y2 FROM sa"


@query("iou_pairs", f"""b AS ({BOXES}), p AS (SELECT a.track_id, greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i,
      (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS u FROM b a JOIN b c ON a.track_id = c.track_id AND (a.l_partkey, a.l_suppkey) < (c.l_partkey, c.l_suppkey))
    SELECT track_id, count(*) AS pairs, count(*) FILTER (i > 0) AS touching, round(max(i / (u - i)), 6) AS most FROM p GROUP BY 1""")
def iou_pairs(t: Lake) -> DataFrame:
    from ..functions import geometry as G

    x = F.col
    box = F.struct(x("x").alias("x1"), x("y").alias("y1"), (x("x") + x("size_pct")).alias("x2"), (x("y") + x("size_pct")).alias("y2"))
    rows = t.samples().select("track_id", "l_partkey", "l_suppkey", box.alias("box")).distinct()
    other = rows.select("track_id", F.struct("l_partkey", "l_suppkey").alias("_k"), F.col("box").alias("other"))
    pairs = rows.join(other, "track_id").filter(F.struct("l_partkey", "l_suppkey") < F.col("_k"))
    return pairs.groupBy("track_id").agg(
        F.count("*").alias("pairs"), F.count_if(G.intersection(F.col("box"), F.col("other")) > 0).alias("touching"), F.round(F.max(G.iou(F.col("box"), F.col("other"))), 6).alias("most")
    )


COS = "1 - list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


@query("knn_topk", f"""q AS (SELECT v FROM vec WHERE vec_id = 0), d AS (SELECT vec_id, {COS.format(a="vec.v", b="q.v")} AS d FROM vec, q WHERE vec_id <> 0)
    SELECT vec_id, round(d, 4) AS dist FROM d WHERE d <= 0.95 ORDER BY d, vec_id LIMIT 25""")
def knn_topk(t: Lake) -> DataFrame:
    q = t.vectors().filter("vec_id = 0").select(F.col("v").alias("q"))
    rows = t.vectors().filter("vec_id <> 0").crossJoin(F.broadcast(q)).withColumn("d", V.cosine_distance(F.col("v"), F.col("q")))  # one row
    return rows.filter("d <= 0.95").orderBy("d", "vec_id").limit(25).select("vec_id", F.round("d", 4).alias("dist"))


MIN_REF = f"m AS (SELECT p.vec_id, r.label, min({COS.format(a='p.v', b='r.v')}) AS d FROM vec p, vec r WHERE p.vec_id % 2 = 1 AND r.vec_id % 2 = 0 GROUP BY ALL)"


def _dists(t: Lake) -> DataFrame:
    from ..operators import identity

    v = t.vectors()
    return identity.distances(v.filter("vec_id % 2 = 1"), v.filter("vec_id % 2 = 0"), "vec_id", "label", "v")


@query("min_over_references", MIN_REF + "SELECT vec_id, label, round(d, 4) AS dist FROM m")
def min_over_references(t: Lake) -> DataFrame:
    return _dists(t).select("vec_id", "label", F.round("dist", 4).alias("dist"))


@query("rival_margin", MIN_REF + ", r AS (SELECT *, lead(d) OVER (PARTITION BY vec_id ORDER BY d, label) AS rival, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS n FROM m) SELECT vec_id, label, round(d, 4) AS distance, round(rival, 4) AS rival FROM r WHERE n = 1 AND d < 0.9 AND (rival IS NULL OR rival - d >= 0.02)")
def rival_margin(t: Lake) -> DataFrame:
    from ..operators import identity

    v = t.vectors()
    near = identity.leaders(v.filter("vec_id % 2 = 1"), v.filter("vec_id % 2 = 0"), "vec_id", "label", "v")
    won = ranked.margin_winners(near, "vec_id", "label", "dist", 0.9, 0.02)
    return won.select("vec_id", "label", F.round("distance", 4).alias("distance"), F.round("rival", 4).alias("rival"))


@query("prototype_classify", f"""m AS (SELECT p.vec_id, r.label, min({COS.format(a='p.v', b='r.v')}) AS d FROM vec p, vec r WHERE p.vec_id % 2 = 1 AND r.vec_id % 2 = 0 AND r.label IN (1, 2, 3, 5) GROUP BY ALL),
    r AS (SELECT *, lead(d) OVER (PARTITION BY vec_id ORDER BY d, CAST(label AS VARCHAR)) AS rival, row_number() OVER (PARTITION BY vec_id ORDER BY d, CAST(label AS VARCHAR)) AS n FROM m)
    SELECT vec_id, CASE WHEN d > 0.9 OR (rival IS NOT NULL AND (rival - d < 0.01 OR rival - d < 0.1 * rival)) THEN 'unknown' ELSE CAST(label AS VARCHAR) END AS label, round(d, 4) AS dist FROM r WHERE n = 1""")
def prototype_classify(t: Lake) -> DataFrame:
    from ..operators import identity

    v = t.vectors().withColumn("region", F.lit(1)).withColumn("label", F.col("label").cast("string"))
    q = v.filter("vec_id % 2 = 1").withColumn("states", F.array(*(F.lit(x) for x in "1235")))
    got = identity.classified(q, v.filter("vec_id % 2 = 0"), "vec_id", "region", "label", "v", 0.9, 0.01)
    return got.select("vec_id", "label", F.round("dist", 4).alias("dist"))


@query("centroid_normalised", """e AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM vec), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
    n AS (SELECT label, sqrt(sum(x * x)) AS s FROM m GROUP BY 1) SELECT m.label, CAST(i AS INTEGER) AS i, round(x / s, 4) AS x FROM m JOIN n USING (label)""")
def centroid_normalised(t: Lake) -> DataFrame:
    from ..operators import identity

    c = identity.centroid(t.vectors(), ["label"], "v")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 4).alias("x"))


@query("rank1_dprime", MIN_REF + """, t AS (SELECT m.*, vec.label AS own, row_number() OVER (PARTITION BY m.vec_id ORDER BY d, m.label) AS n FROM m JOIN vec USING (vec_id))
    SELECT round(avg(CASE WHEN label = own THEN 1.0 ELSE 0.0 END) FILTER (n = 1), 4) AS rank1, round(avg(d) FILTER (label = own), 4) AS genuine, round(avg(d) FILTER (label <> own), 4) AS impostor,
    round((avg(d) FILTER (label <> own) - avg(d) FILTER (label = own)) / sqrt((var_pop(d) FILTER (label = own) + var_pop(d) FILTER (label <> own)) / 2), 4) AS d_prime FROM t""")
def rank1_dprime(t: Lake) -> DataFrame:
    from ..operators import identity

    got = identity.rank_one(_dists(t), "vec_id", "label", t.vectors().select("vec_id", "label"))
    return got.select(*(F.round(c, 4).alias(c) for c in got.columns))


@query("threshold_sweep", MIN_REF + """, r AS (SELECT m.d, m.label = vec.label AS ok FROM m JOIN vec USING (vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, m.label) = 1), k AS (SELECT unnest(CAST([0.6, 0.7, 0.8, 0.9] AS DOUBLE[])) AS tau)
    SELECT tau, count(*) FILTER (d < tau AND ok) AS correct, count(*) FILTER (d < tau AND NOT ok) AS wrong, count(*) FILTER (d >= tau) AS anonymous FROM r, k GROUP BY 1""")
def threshold_sweep(t: Lake) -> DataFrame:
    from ..operators import identity

    first = ranked.best(_dists(t), ["vec_id"], [F.col("dist"), F.col("label")])
    rows = first.join(t.vectors().select("vec_id", F.col("label").alias("own")), "vec_id").withColumn("is_right", F.col("label") == F.col("own"))
    return identity.threshold_sweep(rows, [0.6, 0.7, 0.8, 0.9])


@query("best_sample_tiers", """SELECT track_id, max(s) AS best FROM (SELECT track_id, first_value(confidence) OVER (PARTITION BY track_id ORDER BY CASE WHEN flag = 'A' THEN 0 ELSE 1 END, CASE WHEN size_pct <= 20 THEN 0 ELSE 1 END, confidence DESC) AS s FROM sa) GROUP BY 1""")
def best_sample_tiers(t: Lake) -> DataFrame:
    from ..operators import identity

    rows = t.samples().select("track_id", "sample_id", (F.col("flag") == "A").alias("face_realigned"), F.col("size_pct").alias("face_frontality"), F.col("confidence").alias("face_score"))
    return identity.best_face(rows, ["track_id"], 20.0).select("track_id", F.col("face_score").alias("best"))


@query("near_anchor_window", f"""a AS (SELECT vec_id % 20 AS cam, label, vec_id * 3600000000 AS at_us, v FROM vec WHERE vec_id % 2 = 0),
    t AS (SELECT vec_id, vec_id % 20 AS cam, vec_id * 3600000000 AS s, v FROM vec WHERE vec_id % 2 = 1),
    d AS (SELECT t.vec_id, a.label, min({COS.format(a='t.v', b='a.v')}) AS d FROM t JOIN a ON a.at_us BETWEEN t.s - 72000000000 AND t.s + 72000000000 WHERE {COS.format(a='t.v', b='a.v')} < CASE WHEN t.cam = a.cam THEN 0.9 ELSE 0.8 END GROUP BY ALL),
    r AS (SELECT *, lead(d) OVER (PARTITION BY vec_id ORDER BY d, label) AS rival, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS n FROM d)
    SELECT vec_id AS track_id, label AS global_id, round(d, 4) AS distance FROM r WHERE n = 1 AND (rival IS NULL OR rival - d >= 0.01)""")
def near_anchor_window(t: Lake) -> DataFrame:
    from ..operators import identity

    v = t.vectors().select("vec_id", (F.col("vec_id") % 20).alias("camera_id"), (F.col("vec_id") * H).alias("at_us"), F.col("v").alias("embedding"), "label")
    anchors = v.filter("vec_id % 2 = 0").withColumn("class_ids", F.array(F.lit(2), (F.col("vec_id") % 2 + 7).cast("int"))).withColumn("global_id", F.col("label"))
    tracks = v.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("track_id"), "camera_id", F.lit(2).alias("class_id"), F.col("at_us").alias("started_us"), F.col("at_us").alias("ended_us"), "embedding")
    got = identity.near_anchors(tracks, anchors, 20 * H, 0.9, 0.8, 0.01)
    return got.select("track_id", "global_id", F.round("distance", 4).alias("distance"))


@query("plate_normalise", "SELECT p_partkey, regexp_replace(replace(translate(upper(p_name || ' č-Đ ' || p_brand), 'ČĆŽŠ', 'CCZS'), 'Đ', 'DJ'), '[^A-Z0-9]', '', 'g') AS plate FROM part")
def plate_normalise(t: Lake) -> DataFrame:
    from ..functions import plates

    return t.raw("part").select("p_partkey", plates.normalised(F.concat("p_name", F.lit(" č-Đ "), "p_brand")).alias("plate"))


@query("plate_vote", """x AS (SELECT camera_id, at_us, regexp_replace(upper(kind || event_id % 7), '[^A-Z0-9]', '', 'g') AS p FROM ev), l AS (SELECT camera_id, length(p) AS n, count(*) AS c, min(at_us) AS f FROM x GROUP BY ALL),
    b AS (SELECT camera_id, n FROM l QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY c DESC, f, n) = 1),
    s AS (SELECT x.camera_id, at_us, p, n FROM x JOIN b ON x.camera_id = b.camera_id AND length(p) = n), ch AS (SELECT camera_id, at_us, n, i, substr(p, CAST(i AS INTEGER), 1) AS c FROM s, range(1, 30) r(i) WHERE i <= n),
    cc AS (SELECT camera_id, n, i, c, count(*) AS v, min(at_us) AS f FROM ch GROUP BY ALL), w AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY camera_id, i ORDER BY v DESC, f, c) = 1), k AS (SELECT camera_id, count(*) AS n FROM s GROUP BY 1)
    SELECT w.camera_id, string_agg(c, '' ORDER BY i) AS plate, round(sum(v) / (any_value(k.n) * count(*)), 6) AS agreement, any_value(k.n) AS n FROM w JOIN k USING (camera_id) GROUP BY 1""")
def plate_vote(t: Lake) -> DataFrame:
    from ..operators import plates

    rows = t.events().withColumn("text", F.concat("kind", (F.col("event_id") % 7).cast("string")))
    got = plates.vote(rows, ["camera_id"], "text", "at_us")
    return got.select("camera_id", "plate", F.round("agreement", 6).alias("agreement"), "n")


@query("plate_distance")
def plate_distance(t: Lake) -> DataFrame:
    from ..functions import plates

    p = t.raw("part").select("p_partkey", plates.normalised(F.concat("p_brand", F.col("p_size").cast("string"))).alias("a"), plates.normalised(F.concat("p_brand", (F.col("p_size") * 7 % 50).cast("string"))).alias("b"))
    return p.select("p_partkey", plates.distance(F.col("a"), F.col("b")).alias("whole"), plates.distance(F.col("a"), F.col("b"), True).alias("part"))


@query("plate_gallery_match")
def plate_gallery_match(t: Lake) -> DataFrame:
    from ..operators import plates

    known = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("global_id"), F.concat(F.lit("ZG"), (F.col("s_suppkey") * 7919 % 9000 + 1000).cast("string"), F.lit("AB")).alias("plate"))
    reads = t.raw("supplier").select("s_suppkey", F.concat(F.lit("ZG-"), F.translate((F.col("s_suppkey") * 7919 % 9000 + 1000).cast("string"), "058", "OSB"), F.lit("A8")).alias("text"))
    return plates.matched(reads, known, "s_suppkey", "text")


@query("retention_tier", f"""n AS (SELECT DISTINCT global_id FROM tr WHERE identity_name IS NOT NULL AND camera_id % 3 = 0)
    SELECT track_id, ended_us + CASE WHEN n.global_id IS NOT NULL THEN 90 WHEN face_verified THEN 60 ELSE 30 END * {D} AS retain_until_us FROM tr LEFT JOIN n USING (global_id)""")
def retention_tier(t: Lake) -> DataFrame:
    named = t.tracks().filter("identity_name IS NOT NULL AND camera_id % 3 = 0").select("global_id")
    return retention.retained(t.tracks(), named).select("track_id", "retain_until_us")


@query("retention_expired", f"SELECT track_id FROM tr WHERE ended_us + CASE WHEN identity_name IS NOT NULL THEN 90 WHEN face_verified THEN 60 ELSE 30 END * {D} <= 900000000000000")
def retention_expired(t: Lake) -> DataFrame:
    named = t.tracks().filter("identity_name IS NOT NULL").select("global_id")
    return retention.expired(retention.retained(t.tracks(), named), 900_000_000_000_000).select("track_id")


@query("orphan_events", f"SELECT event_id FROM ev WHERE at_us < {UNTIL - D} AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.track_id = ev.track_id AND tr.track_id % 2 = 0)")
def orphan_events(t: Lake) -> DataFrame:
    return retention.orphans(t.events(), t.tracks().filter("track_id % 2 = 0"), UNTIL).select("event_id")


@query("disk_prune", """a AS (SELECT recording_id, coalesce(sum(size_bytes) OVER (ORDER BY started_us, recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM rec WHERE ended_us IS NOT NULL AND (retain_until_us IS NULL OR retain_until_us <= 900000000000000))
    SELECT recording_id FROM a WHERE b < 300000000""")
def disk_prune(t: Lake) -> DataFrame:
    return recordings.prune(t.recordings(), 300_000_000, 900_000_000_000_000).select("recording_id")


@query("merge_identity", "SELECT track_id, CASE global_id WHEN 'id-3' THEN 'id-1' WHEN 'id-7' THEN 'id-2' ELSE global_id END AS global_id FROM tr")
def merge_identity(t: Lake) -> DataFrame:
    from ..operators import identity

    mapping = t.spark.createDataFrame([("id-3", "id-1"), ("id-7", "id-2")], "old string, new string")
    return identity.merged(t.tracks(), mapping).select("track_id", "global_id")


@query("split_identity", "SELECT track_id, CASE WHEN track_id % 9 = 0 THEN CAST(track_id AS VARCHAR) ELSE global_id END AS global_id FROM tr")
def split_identity(t: Lake) -> DataFrame:
    from ..operators import identity

    return identity.split(t.tracks(), t.tracks().filter("track_id % 9 = 0")).select("track_id", "global_id")


@query("presence_close_reason", f"""o AS (SELECT track_id AS episode_id, global_id, camera_id, ended_us AS c, max(ended_us) OVER (PARTITION BY global_id) AS m FROM tr WHERE global_id IS NOT NULL),
    e AS (SELECT DISTINCT camera_id FROM cam WHERE camera_id % 4 = 0), v AS (SELECT global_id, max(ended_us) AS l FROM tr WHERE class_id IN (2, 7) AND global_id IS NOT NULL AND ended_us > 915000000000000 - {900 * D} GROUP BY 1),
    r AS (SELECT episode_id, c, CASE WHEN c < 915000000000000 - {30 * D} AND m > c THEN 'elsewhere' WHEN c < 915000000000000 - {20 * D} AND e.camera_id IS NOT NULL THEN 'absence' WHEN c < l + 60000000 THEN 'vehicle' WHEN c < 915000000000000 - {D} THEN 'stale' END AS closed_by
      FROM o LEFT JOIN e USING (camera_id) LEFT JOIN v USING (global_id)) SELECT episode_id, closed_by, c AS departed_us FROM r WHERE closed_by IS NOT NULL""")
def presence_close_reason(t: Lake) -> DataFrame:
    from ..operators import presence

    open_ = t.tracks().filter("global_id IS NOT NULL").select(F.col("track_id").alias("episode_id"), "global_id", "camera_id", F.col("ended_us").alias("confirmed_us"))
    cars = t.tracks().filter("class_id IN (2, 7) AND global_id IS NOT NULL").select("global_id", F.col("ended_us").alias("left_us"))
    return presence.close_reasons(open_, t.cameras().filter("camera_id % 4 = 0"), cars, 915_000_000_000_000, 30 * D, 20 * D, 900 * D, T.MINUTE, D)


@query("presence_opened", """p AS (SELECT camera_id % 10 AS g, kind, at_us, lag(at_us) OVER w AS b FROM ev WINDOW w AS (PARTITION BY camera_id % 10, 1 ORDER BY at_us)),
    r AS (SELECT *, sum(CASE WHEN b IS NULL OR at_us - b > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS run FROM p),
    s AS (SELECT g, min(at_us) AS present_us, max(at_us) AS confirmed_us, bool_or(kind = 'view') AS f, count(*) AS n FROM r GROUP BY g, run)
    SELECT g AS global_id, present_us, confirmed_us, CASE WHEN f THEN 'face' ELSE 'body' END AS evidence, n FROM s WHERE f OR confirmed_us - present_us >= 1200000000""")
def presence_opened(t: Lake) -> DataFrame:
    from ..operators import presence

    rows = t.events().select((F.col("camera_id") % 10).alias("global_id"), F.lit(1).alias("camera_id"), "at_us", F.when(F.col("kind") == "view", "face").otherwise("body").alias("source"))
    return presence.opened(rows, 20 * T.MINUTE, H).drop("camera_id")


@query("best_read_per_fill", """f AS (SELECT event_id AS fill_id, camera_id % 12 AS place, at_us AS filled_us FROM ev WHERE kind = 'purchase'), r AS (SELECT event_id AS read_id, camera_id % 12 AS place, at_us AS read_us, event_id % 5 AS readings, event_id % 3 = 0 AS m FROM ev WHERE kind = 'view')
    SELECT fill_id, read_id FROM f JOIN r USING (place) WHERE read_us BETWEEN filled_us - 18000000000 AND filled_us + 3600000000 QUALIFY row_number() OVER (PARTITION BY fill_id ORDER BY CASE WHEN m THEN 0 ELSE 1 END, read_us DESC, readings DESC, read_id) = 1""")
def best_read_per_fill(t: Lake) -> DataFrame:
    from ..operators import occupancy

    return occupancy.best_read(*_fills(t), before_us=5 * H, after_us=H)


def _fills(t: Lake) -> tuple[DataFrame, DataFrame]:
    e = t.events().withColumn("place", F.col("camera_id") % 12)
    fills = e.filter("kind = 'purchase'").select(F.col("event_id").alias("fill_id"), "place", F.col("at_us").alias("filled_us"))
    reads = e.filter("kind = 'view'").select(F.col("event_id").alias("read_id"), "place", F.col("at_us").alias("read_us"), (F.col("event_id") % 5).alias("readings"), F.when(F.col("event_id") % 3 == 0, F.lit("g")).alias("global_id"), F.lit(False).alias("departing"))
    return fills, reads


@query("assigned_reads")
def assigned_reads(t: Lake) -> DataFrame:
    from ..operators import occupancy

    return occupancy.assigned_reads(*_fills(t), before_us=5 * H, after_us=H)


@query("scene_hysteresis", """p AS (SELECT camera_id, at_us, kind, lag(kind) OVER w AS b, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY camera_id ORDER BY at_us)), s AS (SELECT *, CASE WHEN kind = b AND n > 1 THEN kind END AS settled FROM p)
    SELECT camera_id, at_us, last_value(settled IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY at_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS published FROM s""")
def scene_hysteresis(t: Lake) -> DataFrame:
    from ..operators import telemetry

    return telemetry.debounced(t.events().select("camera_id", "at_us", "kind"), ["camera_id"], "at_us", "kind", 2).drop("kind")


@query("state_runs", """p AS (SELECT camera_id, at_us, event_id, kind, lag(kind) OVER w AS b, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY camera_id ORDER BY at_us, event_id)),
    r AS (SELECT *, sum(CASE WHEN n > 1 AND kind = b THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
    SELECT camera_id, CAST(run AS BIGINT) AS run, any_value(kind) AS kind, min(at_us) AS first, max(at_us) AS last, count(*) AS n FROM r GROUP BY camera_id, run""")
def state_runs(t: Lake) -> DataFrame:
    return islands.state_runs(t.events(), ["camera_id"], "at_us", "kind", "event_id")


@query("light_band", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'ir' WHEN value - 5 < 0 THEN NULL WHEN value - 5 < 40 THEN 'dark' WHEN value - 5 < 90 THEN 'dim' WHEN value - 5 < 150 THEN 'normal' ELSE 'bright' END AS band FROM ev")
def light_band(t: Lake) -> DataFrame:
    from ..operators import telemetry

    return t.events().select("event_id", telemetry.light_band(F.col("value") - 5, F.when(F.col("event_id") % 10 == 0, 0.6).otherwise(0.1)).alias("band"))


@query("telemetry_accumulate", """g AS (SELECT camera_id, at_us - at_us % 86400000000 AS m, confidence, CASE WHEN size_pct < 10 THEN 'size' WHEN confidence < 0.3 THEN 'conf' END AS r FROM sa)
    SELECT camera_id % 5 AS camera_id, count(*) FILTER (r IS NULL) AS n, count(*) FILTER (r IS NULL AND confidence >= 0.6) AS births, count(*) FILTER (r = 'size') AS size, count(*) FILTER (r = 'conf') AS conf FROM g GROUP BY 1""")
def telemetry_accumulate(t: Lake) -> DataFrame:
    from ..operators import telemetry

    reason = F.when(F.col("size_pct") < 10, "size").when(F.col("confidence") < 0.3, "conf")
    rows = t.samples().select(F.col("sample_id").alias("detection_id"), (F.col("camera_id") % 5).alias("camera_id"), F.lit(0).cast("long").alias("at_us"), F.lit(1).alias("class_id"), "confidence", "size_pct", reason.alias("drop_reason"), (reason.isNull() & (F.col("confidence") >= 0.6)).alias("birth_eligible"))
    return telemetry.accumulated(rows).select("camera_id", "n", F.col("n_birth").alias("births"), F.col("dropped_size").alias("size"), F.col("dropped_conf").alias("conf"))


@query("telemetry_fold", """SELECT camera_id, at_us - at_us % 1800000000 AS bucket_us, kind AS class, CAST(sum(event_id % 9) AS BIGINT) AS n, max(event_id % 9) AS most, round(avg(0.5), 6) AS conf_p50 FROM ev GROUP BY ALL""")
def telemetry_fold(t: Lake) -> DataFrame:
    from ..operators import telemetry

    made = F.to_json(F.struct(F.create_map(F.col("kind"), F.struct((F.col("event_id") % 9).alias("n"), F.lit(0.5).alias("conf_p50"))).alias("published")))
    return telemetry.folded(t.events().select("camera_id", "at_us", F.lit("detector").alias("source"), made.alias("payload")))


@query("drop_spike_incidents", f"""w AS (SELECT camera_id % 10 AS camera_id, sum(event_id % 9) AS p, sum(event_id % 31) AS d FROM ev WHERE at_us > {UNTIL - 5 * D} GROUP BY 1)
    SELECT camera_id, d >= 150 AND d > 3 * p AS tripped, d < 75 OR d <= 1.5 * p AS cleared FROM w""")
def drop_spike_incidents(t: Lake) -> DataFrame:
    from ..operators import telemetry

    published = F.create_map(F.col("kind"), F.struct((F.col("event_id") % 9).alias("n")))
    dropped = F.create_map(F.col("kind"), F.struct((F.col("event_id") % 31).alias("conf"), F.lit(0).alias("size"), F.lit(50).alias("disabled")))
    rows = t.events().select((F.col("camera_id") % 10).alias("camera_id"), "at_us", F.lit("detector").alias("source"), F.to_json(F.struct(published.alias("published"), dropped.alias("dropped"))).alias("payload"))
    flags = telemetry.incident_flags(telemetry.watch(rows, UNTIL, 5 * D))
    return flags.filter("kind = 'drop_spike'").drop("kind")


@query("replay_two_rulesets", """s AS (SELECT * FROM (VALUES ('now', 0.3), ('then', 0.5)) x(rule_set, mc)), g AS (SELECT s.rule_set, camera_id, class_id, CASE WHEN size_pct < 5 THEN 'size' WHEN confidence < least(0.2, mc) THEN 'conf' END AS r, confidence, mc FROM sa, s)
    SELECT rule_set, camera_id, class_id, count(*) FILTER (r IS NULL) AS published, count(*) FILTER (r IS NULL AND confidence >= mc) AS births, count(*) FILTER (r = 'disabled') AS dropped_disabled, count(*) FILTER (r = 'size') AS dropped_size, count(*) FILTER (r = 'conf') AS dropped_conf FROM g GROUP BY ALL""")
def replay_two_rulesets(t: Lake) -> DataFrame:
    from ..operators import telemetry

    rules = [(s, k, True, c, 5.0) for s, c in (("now", 0.3), ("then", 0.5)) for k in range(5)]
    sets = t.spark.createDataFrame(rules, "rule_set string, class_id int, enabled boolean, min_confidence double, min_box_pct double")
    return telemetry.replayed(t.samples().withColumn("maintain", F.lit(0.2)), sets)


@query("rule_dispatch", """r AS (SELECT * FROM (VALUES (1, ['click'], NULL, [1, 2]), (2, NULL, [3, 4, 5], [7]), (3, ['view', 'error'], [1, 2], [2, 9])) x(rule_id, kinds, cams, chans))
    SELECT event_id, CAST(rule_id AS BIGINT) AS rule_id, at_us, CAST(unnest(chans) AS BIGINT) AS channel_id FROM ev, r WHERE (kinds IS NULL OR list_contains(kinds, kind)) AND (cams IS NULL OR list_contains(cams, camera_id))""")
def rule_dispatch(t: Lake) -> DataFrame:
    return _dispatched(t)


def _dispatched(t: Lake) -> DataFrame:
    from ..operators import rules

    rows = [(1, ["click"], None, None, [1, 2]), (2, None, [3, 4, 5], None, [7]), (3, ["view", "error"], [1, 2], None, [2, 9])]
    table = t.spark.createDataFrame(rows, "rule_id long, kinds array<string>, camera_ids array<long>, class_ids array<int>, channel_ids array<long>")
    return rules.dispatched(t.events().withColumn("class_id", F.lit(None).cast("int")), table)


@query("rate_limit")
def rate_limit(t: Lake) -> DataFrame:
    from ..operators import rules

    return rules.rate_limited(_dispatched(t), 3)


@query("audit_timeline", "SELECT event_id AS log_id, at_us, camera_id AS user_id, slug FROM ev LEFT JOIN cam USING (camera_id) WHERE at_us < 1705000000000000 AND kind = 'error' ORDER BY at_us DESC, event_id DESC LIMIT 40")
def audit_timeline(t: Lake) -> DataFrame:
    from ..operators import rules

    log = t.events().select(F.col("event_id").alias("log_id"), "at_us", F.col("camera_id").alias("user_id"), "kind")
    users = t.cameras().select(F.col("camera_id").alias("user_id"), "slug")
    return rules.timeline(log, users, 1_705_000_000_000_000, 40, F.col("kind") == "error").select("log_id", "at_us", "user_id", "slug")


@query("leader_clusters")
def leader_clusters(t: Lake) -> DataFrame:
    from ..operators import greedy

    return greedy.leaders(t.vectors().withColumn("w", F.col("vec_id") % 13), ["label"], "vec_id", "w", "v", 0.8)


@query("farthest_points")
def farthest_points(t: Lake) -> DataFrame:
    from ..operators import greedy

    return greedy.farthest(t.vectors().withColumn("w", F.col("vec_id") % 13), ["label"], "vec_id", "w", "v", 5)


@query("nms_dedup")
def nms_dedup(t: Lake) -> DataFrame:
    x = F.col
    box = F.struct(x("x").cast("double").alias("x1"), x("y").cast("double").alias("y1"), (x("x") + 3 * x("size_pct")).alias("x2"), (x("y") + 3 * x("size_pct")).alias("y2"), x("confidence").alias("confidence"), (x("class_id") * 2).cast("int").alias("class_id"), F.lit(False).alias("clipped"))
    frames = t.samples().groupBy("track_id").agg(F.collect_list(box).alias("boxes"))
    return frames.select("track_id", F.size("boxes").alias("before"), F.size(detection.dedup_frame(F.col("boxes"))).alias("after"))


@query("arrival_fold")
def arrival_fold(t: Lake) -> DataFrame:
    rows = visits.visits(t.tracks()).withColumn("kind", F.lit("visit")).select("visit_id", "camera_id", "class_name", "kind", "started_us", "ended_us")
    return visits.arrival_fold(rows, 30 * T.MINUTE)


@query("feed")
def feed(t: Lake) -> DataFrame:
    gone = t.tracks().filter("class_id IN (2, 7) AND track_id % 3 = 0").select(F.concat(F.lit("P"), (F.col("track_id") % 6).cast("string")).alias("place"), F.col("started_us").alias("occupied_us"), (F.col("ended_us") + T.MINUTE).alias("released_us"), F.array("camera_id").alias("cameras"))
    persons = t.tracks().filter("class_id = 0").select("track_id", "camera_id", "started_us", "ended_us")
    left = t.tracks().filter("class_id IN (2, 7) AND track_id % 6 = 0 AND identity_name IS NOT NULL").select(F.col("track_id").alias("departure_id"), "camera_id", (F.col("ended_us") + T.MINUTE).alias("closes_us"), "identity_name")
    moved = t.tracks().filter("class_id IN (2, 7)").select("camera_id", F.col("ended_us").alias("at_us"))
    spans = visits.walk_to_drive_off(left.select("departure_id", "camera_id", "closes_us"), moved, persons)
    names = left.select("departure_id", "camera_id", F.col("identity_name").alias("name"))
    walks = spans.join(names, "departure_id").select(F.col("departure_id").alias("walk_id"), "camera_id", F.col("opens_us").alias("started_us"), F.col("closes_us").alias("ended_us"), "name")
    return visits.feed(t.tracks(), gone, walks=walks)


@query("asof_forward", """m AS (SELECT tr.track_id, rec.recording_id, row_number() OVER (PARTITION BY tr.track_id ORDER BY rec.started_us, rec.recording_id DESC) AS n FROM tr JOIN rec ON tr.camera_id = rec.camera_id AND rec.started_us >= tr.ended_us)
    SELECT tr.track_id, m.recording_id FROM tr LEFT JOIN m ON m.track_id = tr.track_id AND n = 1""")
def asof_forward(t: Lake) -> DataFrame:
    return asof.asof(t.tracks().select("track_id", "camera_id", "ended_us"), t.recordings(), ["camera_id"], "ended_us", "started_us", ["recording_id"], "recording_id", "forward", width_us=30 * D).select("track_id", "recording_id")


@query("lost_track_runs", f"""p AS (SELECT camera_id % 20 AS camera_id, at_us, event_id, lag(at_us) OVER w AS b FROM ev WINDOW w AS (PARTITION BY camera_id % 20 ORDER BY at_us, event_id)),
    r AS (SELECT *, sum(CASE WHEN b IS NULL OR at_us - b > {H} THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p),
    s AS (SELECT camera_id, min(at_us) AS started_us, max(at_us) AS ended_us, count(*) AS n FROM r GROUP BY camera_id, run HAVING count(*) >= 3 AND max(at_us) - min(at_us) >= 600000000)
    SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.camera_id = s.camera_id AND tr.started_us + 800000000000000 <= s.ended_us + 30000000 AND tr.ended_us + 800000000000000 >= s.started_us - 30000000)""")
def lost_track_runs(t: Lake) -> DataFrame:
    rows = t.events().select((F.col("camera_id") % 20).alias("camera_id"), "at_us", F.col("event_id").alias("sample_id"))
    later = t.tracks().select("camera_id", (F.col("started_us") + 800_000_000_000_000).alias("started_us"), (F.col("ended_us") + 800_000_000_000_000).alias("ended_us"))
    return visits.lost_tracks(rows, later, ["camera_id"], H, 3, 600 * T.SECOND, 30 * T.SECOND)


# the same queries under the names they had while others read a part
for _f in (ordered_lists, iou_pairs, min_over_references, rival_margin, prototype_classify, rank1_dprime, threshold_sweep, near_anchor_window, presence_close_reason):
    QUERIES[f"{_f.__name__}_all"], ORACLES[f"{_f.__name__}_all"] = QUERIES[_f.__name__], ORACLES[_f.__name__]

from . import details as _details  # noqa: E402,F401  registers further queries
from . import motion as _motion  # noqa: E402,F401
from . import late as _late  # noqa: E402,F401
