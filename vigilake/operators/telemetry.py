"""Minute buckets, incidents, replays, light bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantiles as Q
from ..functions import times as T
from . import detection, ranked, scan

DETECTOR = "published map<string,struct<n:long,n_birth:long,conf_p50:double>>, dropped map<string,struct<conf:long,size:long,disabled:long>>"
INGESTOR = "active_s double, idle_s double, transitions long, luma_avg double, ir_ratio double"
TRACKER = "n_active long, n_parked long"


def accumulated(detections: DataFrame, most: int = 1000) -> DataFrame:
    """Per camera, minute and class: counts, quantiles of confidence and size from the first `most`, drop reasons."""
    keys = ["camera_id", "minute_us", "class_id"]
    rows = detections.withColumn("minute_us", T.floor_to(F.col("at_us"), T.MINUTE))
    counts = rows.groupBy(*keys).agg(
        F.count_if(F.col("drop_reason").isNull()).alias("n"),
        F.count_if(F.col("birth_eligible")).alias("n_birth"),
        *(F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in ("disabled", "size", "conf")),
    )
    first = ranked.best(rows.filter(F.col("drop_reason").isNull()), keys, [F.col("at_us"), F.col("detection_id")], most)
    conf = Q.nearest_rank(first, keys, "confidence", {"conf_p50": 0.5, "conf_p95": 0.95})
    size = Q.nearest_rank(first, keys, "size_pct", {"size_p50": 0.5, "size_p95": 0.95})
    return counts.join(conf, keys, "left").join(size, keys, "left")


def latest(snapshots: DataFrame, now_us: int, history: int = 360, stale_us: int = 20 * T.SECOND) -> tuple[DataFrame, DataFrame]:
    """(newest snapshot per service with stale, the last `history` of each)."""
    rows = ranked.keep_latest(snapshots, ["service"], "at_us", "snapshot_id", history)
    newest = ranked.keep_latest(snapshots, ["service"], "at_us", "snapshot_id").withColumn("stale", F.lit(now_us) - F.col("at_us") > stale_us)
    return newest, rows


def folded(buckets: DataFrame, width_us: int = 30 * T.MINUTE) -> DataFrame:
    """camera_id, bucket_us, class: totals, the largest minute, the mean of the minutes' medians."""
    own = buckets.filter(F.col("source") == "detector").select("camera_id", T.floor_to(F.col("at_us"), width_us).alias("bucket_us"), F.from_json("payload", DETECTOR).alias("p"))
    rows = own.select("camera_id", "bucket_us", F.explode("p.published").alias("class", "v"))
    return rows.groupBy("camera_id", "bucket_us", "class").agg(F.sum("v.n").alias("n"), F.max("v.n").alias("most"), F.avg("v.conf_p50").alias("conf_p50"))


def duty(buckets: DataFrame, width_us: int = 30 * T.MINUTE) -> DataFrame:
    own = buckets.filter(F.col("source") == "ingestor").select("camera_id", T.floor_to(F.col("at_us"), width_us).alias("bucket_us"), F.from_json("payload", INGESTOR).alias("p"))
    sums = own.groupBy("camera_id", "bucket_us").agg(F.sum("p.active_s").alias("active_s"), F.sum("p.idle_s").alias("idle_s"))
    total = F.col("active_s") + F.col("idle_s")
    return sums.withColumn("duty", F.when(total > 0, F.col("active_s") / total))


def watch(buckets: DataFrame, now_us: int, width_us: int = 15 * T.MINUTE) -> DataFrame:
    """Per camera over the last minutes: activity, published and dropped detections, light. Drops of disabled classes do not count."""
    rows = buckets.filter(F.col("at_us") > now_us - width_us)
    d, i, t = (F.from_json("payload", s) for s in (DETECTOR, INGESTOR, TRACKER))
    rows = rows.withColumn("d", F.when(F.col("source") == "detector", d)).withColumn("i", F.when(F.col("source") == "ingestor", i)).withColumn("t", F.when(F.col("source") == "tracker", t))
    total = lambda m, f: F.coalesce(F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, v: s + f(v)), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy("camera_id").agg(
        zero(F.sum("i.active_s")).alias("active_s"),
        zero(F.sum("i.idle_s")).alias("idle_s"),
        zero(F.sum("i.transitions")).alias("transitions"),
        zero(F.max("t.n_active")).alias("max_active"),
        zero(F.max("t.n_parked")).alias("max_parked"),
        F.sum(total(F.col("d.published"), lambda v: zero(v["n"]))).alias("published"),
        F.sum(total(F.col("d.dropped"), lambda v: zero(v["conf"]) + zero(v["size"]))).alias("dropped"),
        F.avg(F.when(F.col("i.luma_avg") >= 0, F.col("i.luma_avg"))).alias("luma"),
        F.avg(F.when(F.col("i.ir_ratio") >= 0, F.col("i.ir_ratio"))).alias("ir_ratio"),
    )


def incident_flags(window: DataFrame, least_drops: int = 150, ratio: float = 3.0, most_duty: float = 0.8, least_s: float = 600.0) -> DataFrame:
    """camera_id, kind, tripped, cleared; what closes an incident is half of what opens it."""
    covered = F.col("active_s") + F.col("idle_s")
    share = F.when(covered > 0, F.col("active_s") / covered).otherwise(0.0)
    kinds = [
        ("drop_spike", (F.col("dropped") >= least_drops) & (F.col("dropped") > ratio * F.col("published")), (F.col("dropped") < least_drops / 2) | (F.col("dropped") <= ratio / 2 * F.col("published"))),
        ("active_pinned", (share > most_duty) & (covered >= least_s) & (F.col("max_active") == 0), share <= most_duty / 2),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), a.alias("tripped"), b.alias("cleared")) for k, a, b in kinds))
    return window.select("camera_id", F.inline(rows))


def incident_actions(flags: DataFrame, incidents: DataFrame, now_us: int, cooldown_us: int = 24 * T.HOUR) -> DataFrame:
    """camera_id, kind, action: open (unless live or opened within the cooldown) or close (of a live one)."""
    live = incidents.filter(F.col("status").isin("open", "analyzed")).select("camera_id", "kind", F.lit(True).alias("_live")).distinct()
    recent = incidents.filter(F.col("opened_us") > now_us - cooldown_us).select("camera_id", "kind", F.lit(True).alias("_recent")).distinct()
    rows = flags.join(live, ["camera_id", "kind"], "left").join(recent, ["camera_id", "kind"], "left")
    action = F.when(F.col("tripped") & F.col("_live").isNull() & F.col("_recent").isNull(), "open").when(F.col("cleared") & F.col("_live"), "close")
    return rows.select("camera_id", "kind", action.alias("action")).filter(F.col("action").isNotNull())


def replayed(detections: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """rule_set, camera_id, class_id, published, births and drops, gated under each of a few rule sets (a camera's and class's rules)."""
    met = detections.join(F.broadcast(rule_sets), "class_id")  # the rule sets that an operator compares: tens of rows
    reason, birth = detection.gate(F.col("enabled"), F.col("min_confidence"), F.col("min_box_pct"), F.col("confidence"), F.col("size_pct"), F.col("maintain"))
    rows = met.withColumn("_r", reason).withColumn("_b", birth)
    return rows.groupBy("rule_set", "camera_id", "class_id").agg(F.count_if(F.col("_r").isNull()).alias("published"), F.count_if("_b").alias("births"), *(F.count_if(F.col("_r") == k).alias(f"dropped_{k}") for k in ("disabled", "size", "conf")))


def replay_changes(tallies: DataFrame, now: str, then: str) -> DataFrame:
    keys = ["camera_id", "class_id"]
    a = tallies.filter(F.col("rule_set") == now).select(*keys, F.col("births").alias("_a"))
    b = tallies.filter(F.col("rule_set") == then).select(*keys, F.col("births").alias("_b"))
    return a.join(b, keys, "full").select(*keys, (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("births_change")).orderBy(F.col("births_change"), *keys)


def light_band(luma: Column, ir_ratio: Column, edges: tuple[int, int, int] = (40, 90, 150)) -> Column:
    """ir, dark, dim, normal or bright; null without a basis."""
    names = ("dark", "dim", "normal")
    band = F.lit("bright")
    for name, edge in reversed(list(zip(names, edges, strict=True))):
        band = F.when(luma < edge, name).otherwise(band)
    return F.when(ir_ratio >= 0.5, "ir").when(luma < 0, None).otherwise(band)


def debounced(readings: DataFrame, keys: list[str], at: str, state: str, n: int) -> DataFrame:
    """`readings` with published: the state last seen n times in a row; null before the first."""
    by = Window.partitionBy(*keys).orderBy(at)
    same = [F.lag(state, i).over(by).eqNullSafe(F.col(state)) & (F.row_number().over(by) > i) for i in range(1, n)]
    holds = F.lit(True)
    for s in same:
        holds = holds & s
    marked = readings.withColumn("_settled", F.when(holds, F.col(state)))
    return marked.withColumn("published", F.last("_settled", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_settled")


def unsure(readings: DataFrame, keys: list[str], at: str, state: str, hold_us: int = 180 * T.SECOND) -> DataFrame:
    """`readings` with shown: an `unknown` keeps the state before it until it has lasted the hold time."""
    by = Window.partitionBy(*keys).orderBy(at)
    known = F.last(F.when(F.col(state) != "unknown", F.col(state)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    since = F.last(F.when(F.col(state) != "unknown", F.col(at)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first(at).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lasted = F.col(at) - F.coalesce(since, first)
    return readings.withColumn("shown", F.when(F.col(state) != "unknown", F.col(state)).when(lasted >= hold_us, "unknown").otherwise(F.coalesce(known, F.lit("unknown"))))


def cpu_percent(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of all cores from a counter of used microseconds."""
    by = Window.partitionBy(*keys).orderBy("at_us")
    used, gap = F.col("usage_us") - F.lag("usage_us").over(by), F.col("at_us") - F.lag("at_us").over(by)
    return samples.withColumn("cpu_percent", F.when((gap > 0) & (used >= 0), 100.0 * used / (gap * F.col("cores"))))


def counted_fields(buckets: DataFrame, path: str) -> DataFrame:
    """Sum of one number in the payloads that have it."""
    value = F.get_json_object("payload", path)
    return buckets.filter(value.isNotNull()).groupBy("camera_id").agg(F.sum(value.cast("long")).alias("n"))


def sticky_band(luma: Column, ir_ratio: Column, current: Column, slack: float = 8.0, edges: tuple[int, int, int] = (40, 90, 150)) -> Column:
    """light_band, but the current band holds while the light is within `slack` of its edges."""
    low, high = (0, *edges), (*edges, 256)
    holds = F.lit(False)
    for name, a, b in zip(("dark", "dim", "normal", "bright"), low, high, strict=True):
        holds = F.when(current == name, luma.between(a - slack, b + slack)).otherwise(holds)
    plain = light_band(luma, ir_ratio, edges)
    return F.when((plain != "ir") & F.coalesce(holds, F.lit(False)), current).otherwise(plain)


#: The bands of light by number; 0 is none yet.
LIGHTS = (None, "ir", "dark", "dim", "normal", "bright")


def _light_numbers(luma: Column, ir_ratio: Column, slack: float, edges: tuple[int, int, int]) -> Column:
    """The number of the band that a reading means from each band; null without a basis."""
    plain = F.when(ir_ratio >= 0.5, 1).when(luma < 0, None)
    for i, edge in enumerate(edges):
        plain = plain.when(luma < edge, i + 2)
    plain = plain.otherwise(5)
    low, high = (float("-inf"), *edges), (*edges, float("inf"))
    colour = (F.coalesce(ir_ratio, F.lit(0.0)) < 0.5) & (luma >= 0)
    held = [F.when(colour & (luma >= a - slack) & (luma < b + slack), i + 2).otherwise(plain) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    return F.array(plain, plain, *held)


def _named(state: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in LIGHTS)), state + 1)


def held_light(readings: DataFrame, keys: list[str], at: str, tie: str, luma: Column, ir_ratio: Column, slack: float = 8.0, edges: tuple[int, int, int] = (40, 90, 150), width_us: int = T.HOUR) -> DataFrame:
    """`readings` with band: a band holds while the light is within `slack` of its edges; infrared never holds.

    A reading without a basis (luma below 0 and no infrared, or null) leaves the band as it is; null before the first.
    """
    rows = readings.withColumn("_numbers", _light_numbers(luma, F.coalesce(ir_ratio, F.lit(0.0)), slack, edges))
    move = F.when(luma.isNull(), F.sequence(F.lit(0), F.lit(5))).otherwise(F.transform("_numbers", lambda x, i: F.coalesce(x, i)))
    return scan.scanned(rows, keys, at, tie, move, 6, 0, width_us).withColumn("band", _named(F.col("state"))).drop("_numbers", "state")


def switched_light(readings: DataFrame, keys: list[str], at: str, tie: str, luma: Column, ir_ratio: Column, held: Column | None = None, slack: float = 8.0, edges: tuple[int, int, int] = (40, 90, 150), width_us: int = T.HOUR) -> DataFrame:
    """`readings` with band: the band of the second of two readings in a row that mean the same other band.

    What a reading means depends on the band in force (see held_light). A reading without any measure (both below 0, or
    null) is passed over; one that means the band in force, or nothing, ends the wait. Where `held` is true the band
    stays and the wait begins anew. States are pairs of the band and the band waited for.
    """
    lit, infra = F.coalesce(luma.cast("double"), F.lit(-1.0)), F.coalesce(ir_ratio.cast("double"), F.lit(-1.0))
    rows = readings.withColumn("_numbers", _light_numbers(lit, F.greatest(infra, F.lit(0.0)), slack, edges))
    rows = rows.withColumn("_none", (lit < 0) & (infra < 0)).withColumn("_stay", F.coalesce(held, F.lit(False)) if held is not None else F.lit(False))

    def moved(s: Column) -> Column:
        band, waits = F.floor(s / 6).cast("int"), s % 6
        means = F.element_at("_numbers", band + 1)
        return F.when(F.col("_none"), s).when(means.isNull() | (means == band), band * 6).when(means != waits, band * 6 + means).when(F.col("_stay"), band * 6).otherwise(means * 6)

    move = F.transform(F.sequence(F.lit(0), F.lit(35)), moved)
    got = scan.scanned(rows, keys, at, tie, move, 36, 0, width_us)
    return got.withColumn("band", _named(F.floor(F.col("state") / 6).cast("int"))).drop("_numbers", "_none", "_stay", "state")


def light_sample(pixels: DataFrame, keys: list[str], infrared: Column) -> DataFrame:
    """keys, luma, chroma (mean distance of u and v from grey), ir_ratio of samples (y, u, v)."""
    grey = (F.abs(F.col("u") - 128) + F.abs(F.col("v") - 128)) / 2
    return pixels.groupBy(*keys).agg(F.avg("y").alias("luma"), F.avg(grey).alias("chroma"), F.avg(infrared.cast("double")).alias("ir_ratio"))


def headlights(samples: DataFrame, keys: list[str], ratio: float, history: int, cooldown_us: int) -> DataFrame:
    """Samples at night (luma, night) far brighter than the mean of those before, first after a quiet time."""
    by = Window.partitionBy(*keys).orderBy("at_us")
    base = F.avg("luma").over(by.rowsBetween(-history, -1))
    hits = samples.withColumn("_base", base).filter(F.col("night") & (F.col("_base") > 0) & (F.col("luma") > F.col("_base") * ratio))
    before = F.lag("at_us").over(by)
    return hits.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("at_us") - F.col("_before") > cooldown_us)).drop("_base", "_before")


def checked_changes(changes: DataFrame, allowed: dict[str, tuple[float, float]], cameras: DataFrame) -> DataFrame:
    """`changes` (camera_id, field, value) with refused: unknown field, unknown camera, not a number, out of range; else null."""
    low, high = (F.create_map(*(F.lit(x) for k, v in sorted(allowed.items()) for x in (k, v[i]))) for i in (0, 1))
    known = cameras.select("camera_id", F.lit(True).alias("_known")).distinct()
    value = F.col("value").try_cast("double")
    reason = (
        F.when(~F.col("field").isin(*sorted(allowed)), "unknown field")
        .when(F.col("_known").isNull(), "unknown camera")
        .when(value.isNull(), "not a number")
        .when((value < F.try_element_at(low, F.col("field"))) | (value > F.try_element_at(high, F.col("field"))), "out of range")
    )
    return changes.join(known, "camera_id", "left").withColumn("refused", reason).drop("_known")
