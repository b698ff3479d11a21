"""Per-detection gates, rule layers, zones and the clean-up of a frame's boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import greedy

BOX = "array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double,class_id:int,clipped:boolean>>"
NAMED_BOX = BOX.removesuffix(">>") + ",detection_id:bigint,class_name:string>>"


def gate(enabled: Column, min_confidence: Column, min_box_pct: Column, confidence: Column, size_pct: Column, maintain: Column) -> tuple[Column, Column]:
    """(drop_reason, birth_eligible) of a detection: disabled, then size, then conf.

    The floor is the lower of the camera's maintain level and the birth level; a camera without its own keeps birth.
    """
    floor = F.coalesce(F.least(maintain, min_confidence), min_confidence)
    reason = F.when(~enabled, "disabled").when((min_box_pct > 0) & (size_pct < min_box_pct), "size").when(confidence < floor, "conf")
    return reason, reason.isNull() & (confidence >= min_confidence)


def effective_rules(wanted: DataFrame, global_rules: DataFrame, camera_rules: DataFrame) -> DataFrame:
    """`wanted` (camera_id, class_id) with enabled, min_confidence, min_box_pct, source.

    A camera's null inherits; a class without a global rule is not allowed, whatever the camera says; no global
    rules at all allow everything.
    """
    g = global_rules.select("class_id", F.col("enabled").alias("g_enabled"), F.col("min_confidence").alias("g_conf"), F.col("min_box_pct").alias("g_box"), F.lit(True).alias("in_g"))
    c = camera_rules.select("camera_id", "class_id", F.col("enabled").alias("c_enabled"), F.col("min_confidence").alias("c_conf"), F.col("min_box_pct").alias("c_box"), F.lit(True).alias("in_c"))
    any_rule = global_rules.agg((F.count("*") > 0).alias("any_rule"))
    df = wanted.join(g, "class_id", "left").join(c, ["camera_id", "class_id"], "left").crossJoin(F.broadcast(any_rule))  # one row
    free, out = ~F.col("any_rule"), F.col("in_g").isNull()
    return df.select(
        *wanted.columns,
        F.when(free, True).when(out, False).otherwise(F.coalesce("c_enabled", "g_enabled")).alias("enabled"),
        F.when(free, 0.0).when(out, 1.0).otherwise(F.coalesce("c_conf", "g_conf", F.lit(0.0))).alias("min_confidence"),
        F.when(free | out, 0.0).otherwise(F.coalesce("c_box", "g_box", F.lit(0.0))).alias("min_box_pct"),
        F.when(free, "unconfigured").when(out, "not-allowed").when(F.col("in_c"), "override").otherwise("global").alias("source"),
    )


def all_effective_rules(cameras: DataFrame, global_rules: DataFrame, camera_rules: DataFrame) -> DataFrame:
    """Effective rules of every camera for every class of the global rules or its own."""
    own = camera_rules.select("camera_id", "class_id")
    every = cameras.select("camera_id", F.lit(1).alias("_k")).join(global_rules.select("class_id", F.lit(1).alias("_k")), "_k").select("camera_id", "class_id")
    return effective_rules(every.unionByName(own).distinct(), global_rules, camera_rules)


def remapped(detections: DataFrame, remap: DataFrame, class_dim: DataFrame) -> DataFrame:
    """Classes replaced camera by camera (from_class to to_class); an unknown target leaves the row."""
    m = remap.join(class_dim.select(F.col("class_id").alias("to_class"), F.col("class_name").alias("_name")), "to_class").select("camera_id", F.col("from_class").alias("class_id"), F.col("to_class").alias("_to"), "_name")
    got = detections.join(m, ["camera_id", "class_id"], "left")
    return got.withColumn("class_name", F.coalesce("_name", "class_name")).withColumn("class_id", F.coalesce("_to", "class_id")).drop("_to", "_name")


def class_set(globals_: Column, enabled: Column, disabled: Column) -> Column:
    """Classes of a camera: the global ones and its own without those it turned off; null sets are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.array_union(F.coalesce(globals_, none), F.coalesce(enabled, none)), F.coalesce(disabled, none)))


def zone_rule(rules: Column, class_name: Column) -> tuple[Column, Column]:
    """(accepted, rule): a zone without a list accepts all; with one, only its classes."""
    rule = F.try_element_at(rules, class_name)
    return rules.isNull() | rule.isNotNull(), rule


def motion_allows(gate_name: Column, zone_kind: Column, motion_state: Column, class_name: Column, defaults: dict[str, str]) -> Column:
    """Whether a zone listens: the class rule's gate, else the zone kind's. Persons, unknown gates and states pass."""
    default = F.lit(None).cast("string")
    for kind, value in sorted(defaults.items()):
        default = F.when(F.lower(zone_kind) == kind, value).otherwise(default)
    active = F.lower(F.coalesce(motion_state, F.lit("active"))) == "active"
    own = F.coalesce(F.when(gate_name != "", gate_name), default)
    return own.isNull() | (F.lower(F.coalesce(class_name, F.lit(""))) == "person") | (own != "moving_only") | active


def zone_verdict(touched: Column, entered: Column, rested: Column, is_person: Column) -> Column:
    """off-zone, sub-dwell or null; persons pass, a vehicle that came to rest passes the dwell."""
    return F.when(is_person, None).when(~touched, "off-zone").when(~entered & ~rested, "sub-dwell")


def static_verdict(travel: Column, diagonal: Column, is_person: Column, ratio: float = 0.5) -> Column:
    return F.when(~is_person & (diagonal > 0) & (travel / diagonal < ratio), "static")


def exists_long_enough(first_us: Column, last_us: Column, n: Column, least_ms: int = 1500, least_n: int = 5) -> Column:
    return (last_us - first_us >= least_ms * 1000) & (n >= least_n)


def _same(a: Column, b: Column) -> Column:
    group = lambda c: F.when(c.isin(2, 3, 5, 7), -1).otherwise(c)
    return group(a["class_id"]) == group(b["class_id"])


def dedup_frame(boxes: Column, any_class: float = 0.8, same_class: float = 0.55, contained: float = 0.70, kind: str = BOX) -> Column:
    """Boxes (BOX, or `kind` with more fields after those) of a frame, most confident first, each dropped that overlaps one kept: of any class,
    of its class group by less, or cut by a tile's seam and mostly inside."""

    def clashes(held: Column, x: Column) -> Column:
        share = G.iou(held, x)
        return (share >= any_class) | (_same(held, x) & (share >= same_class)) | (_same(held, x) & x["clipped"] & (G.containment(x, held) >= contained))

    order = [(lambda x: x["confidence"], True), (lambda x: x["x1"], False), (lambda x: x["y1"], False)]
    return greedy.suppressed(boxes, kind, order, clashes)


def published(detections: DataFrame, remap: DataFrame, class_dim: DataFrame, global_rules: DataFrame, camera_rules: DataFrame, maintain: DataFrame) -> DataFrame:
    """What becomes of each box of a frame: classes replaced, doubles dropped, the rest gated and marked.

    `detections` (camera_id, at_us, detection_id, box, class_id, class_name, confidence, clipped, frame_width,
    frame_height); `maintain` (camera_id, maintain). Columns: camera_id, at_us, detection_id, class_id, class_name,
    confidence, size_pct, drop_reason (null: published), birth_eligible. A box cut by a seam may keep a track
    alive but not begin one. Doubles do not come out. A frame's boxes meet in one task; a null flag is false.
    """
    box = [F.col(f"box.{k}").cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")]
    item = F.struct(*box, F.col("confidence").cast("double").alias("confidence"), F.col("class_id").cast("int").alias("class_id"), F.coalesce("clipped", F.lit(False)).alias("clipped"), F.col("detection_id").cast("long").alias("detection_id"), "class_name")
    frames = remapped(detections, remap, class_dim).groupBy("camera_id", "at_us").agg(F.max("frame_width").alias("_w"), F.max("frame_height").alias("_h"), F.collect_list(item).alias("_boxes"))
    single = frames.select("camera_id", "at_us", "_w", "_h", F.explode(dedup_frame(F.col("_boxes"), kind=NAMED_BOX)).alias("_b"))
    size = G.size_percent(F.col("_b.x2") - F.col("_b.x1"), F.col("_b.y2") - F.col("_b.y1"), F.col("_w"), F.col("_h"))
    rows = single.select("camera_id", "at_us", "_b.detection_id", "_b.class_id", "_b.class_name", "_b.confidence", "_b.clipped", size.alias("size_pct"))
    ruled = effective_rules(rows, global_rules, camera_rules).join(maintain.select("camera_id", "maintain"), "camera_id", "left")
    reason, birth = gate(F.col("enabled"), F.col("min_confidence"), F.col("min_box_pct"), F.col("confidence"), F.col("size_pct"), F.col("maintain"))
    return ruled.select("camera_id", "at_us", "detection_id", "class_id", "class_name", "confidence", "size_pct", reason.alias("drop_reason"), (birth & ~F.col("clipped")).alias("birth_eligible"))


def dedup_tracks(boxes: Column, overlap: float = 0.6, contained: float = 0.7) -> Column:
    """Boxes of a frame's tracks, largest first, without those that sit on a larger one of their class group."""
    clashes = lambda held, x: _same(held, x) & ((G.iou(held, x) >= overlap) | (G.containment(x, held) >= contained))
    return greedy.suppressed(boxes, BOX, [(G.area, True), (lambda x: x["x1"], False), (lambda x: x["y1"], False)], clashes)


def spot_suppressed(detections: DataFrame, spots: DataFrame, least_overlap: float = 0.5, births: int = 20, span_us: int = 86_400_000_000, confidence: float = 0.70) -> DataFrame:
    """`detections` with suppressed: weak births on a spot that has borne many tracks for a day and no mover.

    `spots` (camera_id, class_id, spot, births, movers, first_us, last_us) is a small learned table per camera.
    """
    bad = spots.filter((F.col("movers") == 0) & (F.col("births") >= births) & (F.col("last_us") - F.col("first_us") >= span_us)).select("camera_id", "class_id", "spot")
    foot = G.foot(F.col("box"))
    hit = detections.join(bad, ["camera_id", "class_id"]).filter(G.inside_box(foot, F.col("spot")) & (G.iou(F.col("box"), F.col("spot")) >= least_overlap) & (F.col("confidence") < confidence))
    return detections.join(hit.select("detection_id", F.lit(True).alias("suppressed")).distinct(), "detection_id", "left").fillna(False, ["suppressed"])


def raw_trace(detections: DataFrame, since_us: int, until_us: int, per_frame: int, most_frames: int) -> DataFrame:
    """A slice of the raw detections: the strongest of each frame, frames thinned evenly to a number."""
    from . import ranked

    rows = detections.filter((F.col("at_us") >= since_us) & (F.col("at_us") < until_us))
    frames = ranked.evenly(rows.select("camera_id", "at_us").distinct(), ["camera_id"], "at_us", "at_us", most_frames)
    return ranked.best(rows.join(frames, ["camera_id", "at_us"], "left_semi"), ["camera_id", "at_us"], [F.col("confidence").desc(), F.col("detection_id")], per_frame)
