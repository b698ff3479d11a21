"""Plate readings: votes, gallery matches, fixtures, places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plates as P
from . import greedy, identity, ranked

READING = "array<struct<text:string,confidence:double,x:double,y:double,width:double>>"


def vote(readings: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """keys, plate, agreement (mean share of the winning characters), n: per column the commonest character.

    Only readings of the commonest length count; ties go to what was seen first.
    """
    own = readings.select(*keys, P.normalised(F.col(text)).alias("_t"), F.col(order).alias("_o")).filter(F.length("_t") > 0).withColumn("_len", F.length("_t"))
    size = ranked.majority(own, keys, "_len", "_o").drop("votes")
    same = own.join(size, [*keys, "_len"])
    chars = same.select(*keys, "_o", F.posexplode(F.split("_t", "")).alias("_i", "_c")).filter(F.col("_c") != "")
    best = ranked.majority(chars, [*keys, "_i"], "_c", "_o")
    n = same.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = best.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_c"))), lambda x: x["_c"]), "").alias("plate"), F.sum("votes").alias("_v"), F.count("*").alias("_l"))
    return joined.join(n, keys).select(*keys, "plate", (F.col("_v") / (F.col("n") * F.col("_l"))).alias("agreement"), "n")


def candidates(texts: DataFrame, plates: DataFrame, edits: int) -> DataFrame:
    """_t, _g: of the distinct texts `_t` and plates `_g`, the pairs that can lie within so many edits, look-alikes apart.

    Both sides are indexed by their shortened forms; texts of the least partial length also by those of the plates'
    parts. A pair is met only where a form is shared, so no text meets every plate.
    """
    form = lambda df, c, forms: df.select(c, F.explode(forms).alias("_form"))
    t, g = P.folded(F.col("_t")), P.folded(F.col("_g"))
    whole = form(texts, "_t", P.shortened(t, edits)).join(form(plates, "_g", P.shortened(g, edits)), "_form")
    short = texts.filter(F.length("_t") == P.LEAST_PARTIAL)
    pieces = P.parts(g, max(P.LEAST_PARTIAL - edits, 1), P.LEAST_PARTIAL + edits)
    forms = F.array_distinct(F.flatten(F.transform(pieces, lambda p: P.shortened(p, edits))))
    part = form(short, "_t", P.shortened(t, edits)).join(form(plates, "_g", forms), "_form")
    return whole.select("_t", "_g").unionByName(part.select("_t", "_g")).distinct()


def matched(readings: DataFrame, gallery: DataFrame, key: str, text: str, most: float = 1.5, margin: float = 1.5) -> DataFrame:
    """key, global_id, distance: the one known plate within `most`, the next at least `margin` farther.

    Readings of six characters may match as a part. A text is measured against those plates alone that the index of
    `candidates` says can be within `most`, or a rival; texts and plates are measured once each.
    """
    texts = readings.select(P.normalised(F.col(text)).alias("_t")).filter(F.length("_t") > 0).distinct()
    known = gallery.select("global_id", P.normalised(F.col("plate")).alias("_g")).filter(F.length("_g") > 0)
    # of the identities that share a plate only the first and one rival can matter
    known = ranked.best(known.distinct(), ["_g"], [F.col("global_id")], 2)
    edits = max(math.floor(most + 1e-9), math.ceil(most + margin - 1e-9) - 1)
    near = candidates(texts, known.select("_g").distinct(), edits)
    short = F.length("_t") == P.LEAST_PARTIAL  # may lie anywhere in a longer plate
    whole = near.withColumn("_whole", P.distance(F.col("_t"), F.col("_g")))
    part = whole.filter(short).withColumn("_part", P.distance(F.col("_t"), F.col("_g"), True)).select("_t", "_g", F.least("_whole", "_part").alias("dist"))
    dist = whole.filter(~short).select("_t", "_g", F.col("_whole").alias("dist")).unionByName(part).join(known, "_g")
    won = ranked.margin_winners(dist, "_t", "global_id", "dist", most + 1e-9, margin)
    return readings.withColumn("_t", P.normalised(F.col(text))).join(won, "_t").select(key, "global_id", "distance")


def seen_enough(votes: DataFrame, readings: DataFrame, keys: list[str], text: str, least: int) -> DataFrame:
    """Votes whose whole text was itself read so many times: an assembled one was not."""
    own = readings.select(*keys, P.normalised(F.col(text)).alias("plate")).groupBy(*keys, "plate").agg(F.count("*").alias("seen"))
    return votes.join(own, [*keys, "plate"]).filter(F.col("seen") >= least)


def one_per_plate(readings: Column, widths: float = 0.5) -> Column:
    """Readings (READING) of a frame, most confident first, one per place of half a width."""
    near = lambda h, x: F.hypot(h["x"] - x["x"], h["y"] - x["y"]) < widths * F.greatest(h["width"], x["width"])
    return greedy.suppressed(readings, READING, [(lambda x: x["confidence"], True), (lambda x: x["x"], False), (lambda x: x["y"], False)], near)


def fixtures(sightings: DataFrame, keys: list[str], least: int, still_widths: float, car_travel: float) -> DataFrame:
    """keys, text, fixture: texts that stayed put while their cars moved.

    Travel is the diagonal of the places' bounding box, in widths of the plate.
    """
    rows = sightings.groupBy(*keys, "text").agg(
        F.count("*").alias("n"),
        F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("plate_travel"),
        F.hypot(F.max("owner_x") - F.min("owner_x"), F.max("owner_y") - F.min("owner_y")).alias("car_travel"),
        F.expr("percentile(width, 0.5)").alias("width"),
    )
    fixed = (F.col("n") >= least) & (F.col("plate_travel") <= still_widths * F.col("width")) & (F.col("car_travel") >= car_travel)
    return rows.select(*keys, "text", fixed.alias("fixture"))


def not_standing(sightings: DataFrame, keys: list[str], widths: float = 0.3) -> DataFrame:
    """Sightings without the texts that did not move by more than a part of their width."""
    travel = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    still = sightings.groupBy(*keys, "text").agg(travel.alias("_t"), F.expr("percentile(width, 0.5)").alias("_w"), F.count("*").alias("_n")).filter((F.col("_n") > 1) & (F.col("_t") <= widths * F.col("_w")))
    return sightings.join(still.select(*keys, "text"), [*keys, "text"], "left_anti")


def moving(samples: DataFrame, keys: list[str], order: str, step: float = 0.05) -> DataFrame:
    """Samples in motion: the last two steps are each a part of the width and point the same way."""
    by = Window.partitionBy(*keys).orderBy(order)
    dx, dy = F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by)
    rows = samples.withColumn("_dx", dx).withColumn("_dy", dy)
    rows = rows.withColumn("_px", F.lag("_dx").over(by)).withColumn("_py", F.lag("_dy").over(by))
    long = lambda a, b: F.hypot(a, b) >= step * F.col("width")
    return rows.filter(long(F.col("_dx"), F.col("_dy")) & long(F.col("_px"), F.col("_py")) & (F.col("_dx") * F.col("_px") + F.col("_dy") * F.col("_py") > 0)).drop("_dx", "_dy", "_px", "_py")


def focus_times(start: Column, end: Column, n: int) -> Column:
    """n times evenly over a span, ends included; the middle for one."""
    if n == 1:
        return F.array(start + F.floor((end - start) / 2).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + F.floor((end - start) * i / (n - 1)).cast("long"))


def nearest_place(points: DataFrame, regions: DataFrame, key: str, reach: float = 2.0) -> DataFrame:
    """key, place: the region nearest to a plate within `reach` widths. Regions are a camera's few."""
    from ..functions import geometry as G

    met = points.join(regions.select("camera_id", "place", "region"), "camera_id")
    gap = G.gap_to_box(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.col("region"))
    near = met.withColumn("gap", gap).filter(F.col("gap") <= reach * F.col("width"))
    return ranked.best(near, [key], [F.col("gap"), F.col("place")]).select(key, "place", "gap")


def rematched(rows: DataFrame, found: DataFrame, plate: str) -> DataFrame:
    """`rows` re-named by the identity that their plate now matches (plate, global_id); others keep theirs."""
    m = found.filter(F.col("global_id").isNotNull()).select(F.col("plate").alias(plate), F.col("global_id").alias("_new"))
    return rows.join(m, plate, "left").withColumn("global_id", F.coalesce("_new", "global_id")).select(rows.columns)
