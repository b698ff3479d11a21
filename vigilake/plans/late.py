"""Registered queries: who is on screen, late naming, how sure a comparison of models is, a reader's feed, repaired zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polygons
from ..functions import times as T
from ..operators import identity, ranked, visits
from ..streaming import live_identity as live
from .catalog import COS, D, H, query
from .logical import Lake

LIVE = live.Rules(most=0.8, margin=0.01)


def live_tables(t: Lake) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Odd vectors are face samples of 40 tracks, each seen then and three seconds later; even ones are references, enrolled over time."""
    v, i = t.vectors(), F.col("vec_id")
    track = [(i % 40 % 5).alias("camera_id"), (i % 40).alias("track_id")]
    faces = v.filter(i % 2 == 1).select(*track, (i * T.SECOND).alias("at_us"), F.col("v").alias("embedding"), F.lit("m").alias("model"), (i % 10 / 10.0).alias("score"))
    seen = faces.select("camera_id", "track_id", F.explode(F.array("at_us", F.col("at_us") + 3 * T.SECOND)).alias("at_us"))
    name = F.col("label").cast("string")
    references = v.filter(i % 2 == 0).select(name.alias("global_id"), F.concat(F.lit("n"), name).alias("name"), F.col("v").alias("embedding"), F.lit("m").alias("model"), F.when(i % 3 == 0, i * T.SECOND).alias("valid_us"))
    return seen, faces, references


@query("live_identity")
def live_identity(t: Lake) -> DataFrame:
    seen, faces, references = live_tables(t)
    return live.verdicts(live.evidence_rows(seen, faces, references, rules=LIVE), LIVE)


_NEXT = "SELECT *, lead(d) OVER (PARTITION BY track_id ORDER BY d, gid) AS rival, row_number() OVER (PARTITION BY track_id ORDER BY d, gid) AS n FROM"
_DIST = COS.format(a="t.v", b="{b}.v")
_UNTIL = f"greatest(CASE WHEN vec_id % 3 = 0 THEN vec_id * {D} END, at_us + {90 * D})"


@query("reswept", f"""t AS (SELECT vec_id AS track_id, vec_id, vec_id % 20 AS cam, vec_id * {H} AS at_us, v, vec_id % 7 = 1 AS has_name, CASE WHEN vec_id % 7 = 1 THEN CAST(label AS VARCHAR) END AS own, vec_id % 14 = 1 AS face FROM vec WHERE vec_id % 2 = 1),
    d AS (SELECT t.track_id, CAST(r.label AS VARCHAR) AS gid, min({_DIST.format(b='r')}) AS d FROM t, vec r WHERE r.vec_id % 2 = 0 AND NOT has_name AND t.vec_id % 3 = 1 GROUP BY ALL),
    f AS (SELECT track_id, gid FROM ({_NEXT} d) WHERE n = 1 AND d < 0.8 AND (rival IS NULL OR rival - d >= 0.01)),
    k AS (SELECT t.*, f.gid AS won, coalesce(own, f.gid) AS gid, face OR f.gid IS NOT NULL AS sure FROM t LEFT JOIN f USING (track_id)),
    b AS (SELECT t.track_id, a.gid AS gid, min({_DIST.format(b='a')}) AS d FROM k t JOIN k a ON a.sure AND a.gid IS NOT NULL AND a.at_us BETWEEN t.at_us - {20 * H} AND t.at_us + {20 * H} WHERE t.gid IS NULL AND {_DIST.format(b='a')} < CASE WHEN t.cam = a.cam THEN 0.9 ELSE 0.8 END GROUP BY ALL),
    c AS (SELECT track_id, gid AS body FROM ({_NEXT} b) WHERE n = 1 AND (rival IS NULL OR rival - d >= 0.01))
    SELECT track_id, coalesce(gid, body) AS global_id, sure AS face_verified, CASE WHEN won IS NOT NULL OR body IS NOT NULL THEN {_UNTIL} WHEN vec_id % 3 = 0 THEN vec_id * {D} END AS retain_until_us FROM k LEFT JOIN c USING (track_id)""")
def reswept(t: Lake) -> DataFrame:
    i, name = F.col("vec_id"), F.col("label").cast("string")
    v = t.vectors()
    odd = v.filter(i % 2 == 1)
    at = i * H
    tracks = odd.select(i.alias("track_id"), (i % 20).alias("camera_id"), F.lit(2).alias("class_id"), at.alias("started_us"), at.alias("ended_us"), F.when(i % 7 == 1, name).alias("global_id"), (i % 14 == 1).alias("face_verified"), F.when(i % 3 == 0, i * D).alias("retain_until_us"), F.col("v").alias("embedding"))
    faces = odd.filter(i % 3 == 1).select(i.alias("track_id"), F.col("v").alias("embedding"), F.lit("m").alias("model"))
    evidence = v.filter(i % 2 == 0).select(name.alias("global_id"), F.col("v").alias("embedding"), F.lit("m").alias("model"))
    got = identity.reswept(tracks, faces, evidence, 2**60, 2**61, 0.8, 0.01, 20 * H, 0.9, 0.8, 0.01, 90)
    return got.select("track_id", "global_id", "face_verified", "retain_until_us")


_CUTS = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in identity.POISSON_CUTS)
_HALF = lambda n: f"list_sum(list_transform(range(1, len(p.v) + 1), lambda i: CASE WHEN i % 2 = {n} THEN p.v[i] * r.v[i] ELSE 0 END)) / sqrt(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: CASE WHEN i % 2 = {n} THEN p.v[i] * p.v[i] ELSE 0 END)) * list_sum(list_transform(range(1, len(p.v) + 1), lambda i: CASE WHEN i % 2 = {n} THEN r.v[i] * r.v[i] ELSE 0 END)))"


@query("rank1_bootstrap", f"""m AS (SELECT p.vec_id, p.label, r.label AS c, min(1 - ({_HALF(1)})) AS x, min(1 - ({_HALF(0)})) AS y FROM vec p, vec r WHERE p.vec_id % 2 = 1 AND r.vec_id % 2 = 0 GROUP BY ALL),
    o AS (SELECT vec_id, label, CAST(arg_min(c, (x, c)) = label AS INTEGER) AS x, CAST(arg_min(c, (y, c)) = label AS INTEGER) AS y FROM m GROUP BY vec_id, label),
    w AS (SELECT rep, x - y AS d, {_CUTS} AS w FROM (SELECT x, y, rep, CAST('0x' || md5('7:' || vec_id || ':' || rep)[1:8] AS BIGINT) AS u FROM o, range(1, 201) AS g(rep))),
    s AS (SELECT rep, CAST(sum(w * d) AS DOUBLE) / sum(w) AS d FROM w GROUP BY 1 HAVING sum(w) > 0)
    SELECT n, round(a, 6) AS mean_first, round(b, 6) AS mean_second, round(e, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT count(*) AS n, avg(x) AS a, avg(y) AS b, avg(x - y) AS e FROM o), (SELECT quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM s)""")
def rank1_bootstrap(t: Lake) -> DataFrame:
    """Two models of a vector: its components of odd and of even place."""
    i, outcome = F.col("vec_id"), []
    for name, rest in (("x", 0), ("y", 1)):
        v = t.vectors().withColumn("v", F.filter("v", lambda _, k: k % 2 == rest))
        d = identity.distances(v.filter(i % 2 == 1), v.filter(i % 2 == 0).withColumnRenamed("label", "c"), "vec_id", "c", "v")
        first = ranked.best(d, ["vec_id"], [F.col("dist"), F.col("c")]).join(v.select("vec_id", "label"), "vec_id")
        outcome.append(first.select("vec_id", (F.col("c") == F.col("label")).cast("int").alias(name)))
    got = identity.paired_bootstrap(outcome[0].join(outcome[1], "vec_id"), "vec_id", "x", "y", 200)
    return got.select("n", *(F.round(c, 6).alias(c) for c in ("mean_first", "mean_second", "difference", "low", "high")))


@query("feed_of_reader")
def feed_of_reader(t: Lake) -> DataFrame:
    """The vehicles of one camera since a day, with what the departures tell and the recording to play."""
    k = F.col("track_id")
    gone = t.tracks().filter("class_id IN (2, 7) AND track_id % 3 = 0").select(F.concat(F.lit("P"), (k % 6).cast("string")).alias("place"), F.col("started_us").alias("occupied_us"), (F.col("ended_us") + T.MINUTE).alias("released_us"), F.array("camera_id", (F.col("camera_id") + 1) % 20).alias("cameras"), "global_id", F.col("identity_name").alias("name"), (k % 2 == 0).alias("by_plate"), "ended_us").withColumn("from_us", F.col("ended_us") - T.MINUTE).drop("ended_us")
    rows = visits.feed(t.tracks(), gone, asked=visits.Asked(camera_id=3, since_us=800_000_000_000_000, class_name="car"))
    return visits.playable(rows, t.recordings()).select("visit_id", "camera_id", "kind", "started_us", "ended_us", "visit_s", "identity_name", "global_id", "recording_id", "seek_s")


@query("zone_repaired", """z AS (SELECT n_nationkey AS zone_id, n_regionkey AS region, 0.05 + n_nationkey / 100.0::DOUBLE AS a FROM nation),
    p AS (SELECT event_id, event_id % 5 AS region, (event_id % 97 + 0.37) / 97 AS x, (event_id % 89 + 0.41) / 89 AS y FROM ev),
    m AS (SELECT event_id, zone_id, x, y, a, 0.1 + 0.8 * (x - a) / (0.9 - a) AS up, 0.9 - 0.8 * (x - a) / (0.9 - a) AS down FROM p JOIN z USING (region))
    SELECT event_id, zone_id FROM m WHERE x > a AND x < 0.9 AND y > least(up, down) AND y < greatest(up, down)""")
def zone_repaired(t: Lake) -> DataFrame:
    """Each nation has a zone drawn as a bow-tie; points meet the zones of their region. The zones are 25 rows."""
    a = F.lit(0.05) + F.col("n_nationkey") / 100.0
    corners = F.array(*(F.struct(x.alias("x"), F.lit(y).alias("y")) for x, y in ((a, 0.1), (F.lit(0.9), 0.9), (F.lit(0.9), 0.1), (a, 0.9))))
    zones = polygons.repaired_zones(t.raw("nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("region"), corners.alias("polygon"))).drop("polygon")
    e = F.col("event_id")
    points = t.events().select("event_id", (e % 5).alias("region"), ((e % 97 + 0.37) / 97).alias("x"), ((e % 89 + 0.41) / 89).alias("y"))
    return points.join(F.broadcast(zones), "region").filter(polygons.strictly_within(F.col("x"), F.col("y"), F.col("rings"))).select("event_id", "zone_id")
