"""Matching by vectors, naming, galleries, merging and splitting of identities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from ..functions import vectors as V
from . import blockwise, greedy, rangejoin, ranked

def distances(probes: DataFrame, references: DataFrame, probe: str, candidate: str, vector: str, model: str | None = None) -> DataFrame:
    """probe, candidate, dist: the least cosine distance of each probe to each candidate's references.

    Blocks of both sides meet as matrices, so no pair of rows is ever written. Vectors compare only within one
    model key where one is named.
    """
    keys = [model] if model else []
    p = probes.select(F.col(probe).alias("_a"), *keys, F.col(vector).cast("array<double>").alias("_v")).distinct()
    r = references.select(F.col(candidate).alias("_c"), *keys, F.col(vector).cast("array<double>").alias("_v")).distinct()
    met = blockwise.dealt(p, r, keys, blockwise.least, "_c")
    return met.groupBy(F.col("_a").alias(probe), F.col("_c").alias(candidate)).agg(F.min("dist").alias("dist"))


def leaders(probes: DataFrame, references: DataFrame, probe: str, candidate: str, vector: str, model: str | None = None) -> DataFrame:
    """probe, candidate, dist: of `distances` the first two candidates at least of each probe, by distance, then by candidate; none without a distance.

    All that a winner with a margin needs; a block of references adds two rows a probe, however many candidates it holds.
    """
    keys = [model] if model else []
    p = probes.select(F.col(probe).alias("_a"), *keys, F.col(vector).cast("array<double>").alias("_v")).distinct()
    r = references.select(F.col(candidate).alias("_c"), *keys, F.col(vector).cast("array<double>").alias("_v")).distinct()
    met = blockwise.dealt(p, r, keys, blockwise.leading, numbers=blockwise.LEADING_NUMBERS)
    return met.groupBy(F.col("_a").alias(probe), F.col("_c").alias(candidate)).agg(F.min("dist").alias("dist"))


def nearest(table: DataFrame, query: list[float], vector: str, key: str, k: int, most: float | None = None, extra: Column | None = None) -> DataFrame:
    """The k rows nearest to a query vector, exact: filtered first, then the top k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = table.withColumn("dist", V.cosine_distance(F.col(vector), q)).filter(F.col("dist").isNotNull())
    if extra is not None:
        rows = rows.filter(extra)
    if most is not None:
        rows = rows.filter(F.col("dist") <= most)
    return rows.orderBy("dist", key).limit(k)


def centroid(references: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, centroid: the mean vector of a key, brought to length 1."""
    parts = references.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    arrays = means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("_v"))
    return arrays.select(*keys, V.normalised(F.col("_v")).alias("centroid"))


def classified(queries: DataFrame, prototypes: DataFrame, query: str, group: str, label: str, vector: str, most: float, margin: float, separation: float = 0.10) -> DataFrame:
    """query, label, dist: the nearest prototype's label, or unknown.

    Only labels among the group's `states` count; unknown when too far, when the next label is within the
    margin, or when the two best labels differ by less than the separation of the farther one.
    """
    q = queries.filter(F.col("states").isNotNull()).select(F.struct(F.col(query).alias("id"), "states").alias("_q"), group, F.col(vector).alias("_v"))
    asked = queries.select(group, F.explode("states").alias("label")).distinct()
    p = prototypes.select(group, F.col(label).alias("label"), F.col(vector).alias("_v")).join(asked, [group, "label"], "left_semi")
    near = distances(q, p, "_q", "label", "_v", group).filter(F.array_contains("_q.states", F.col("label")))
    least = near.groupBy(F.col("_q.id").alias(query), "label").agg(F.min("dist").alias("dist"))
    by = Window.partitionBy(query).orderBy("dist", "label")
    first = least.withColumn("rival", F.lead("dist").over(by)).withColumn("_n", F.row_number().over(by)).filter("_n = 1")
    doubt = (F.col("dist") > most) | (F.col("rival").isNotNull() & ((F.col("rival") - F.col("dist") < margin) | (F.col("rival") - F.col("dist") < separation * F.col("rival"))))
    return first.select(query, F.when(doubt, "unknown").otherwise(F.col("label")).alias("label"), "dist")


def anchor_pairs(tracks: DataFrame, anchors: DataFrame, window_us: int, same_camera: float, other_camera: float) -> DataFrame:
    """`tracks` with _gid, dist: each anchor near in time and of the class's group that is nearer than the camera's threshold."""
    a = anchors.select(F.explode("class_ids").alias("class_id"), F.col("camera_id").alias("_cam"), F.col("global_id").alias("_gid"), F.col("at_us").alias("_at"), F.col("embedding").alias("_v"), V.norm(F.col("embedding")).alias("_vn"))
    sized = tracks.withColumn("_tn", V.norm(F.col("embedding")))
    pairs = rangejoin.overlapping(sized, a, ["class_id"], (F.col("started_us") - window_us, F.col("ended_us") + window_us), (F.col("_at"), F.col("_at")), max(2 * window_us, 1))
    most = F.when(F.col("camera_id") == F.col("_cam"), same_camera).otherwise(other_camera)
    size = F.col("_tn") * F.col("_vn")
    dist = F.lit(1.0) - V.dot(F.col("embedding"), F.col("_v")) / F.when(size > 0, size)
    near = pairs.withColumn("dist", dist).withColumn("_most", most).filter("dist < _most")
    return near.select(*tracks.columns, "_gid", "dist")


def near_anchors(tracks: DataFrame, anchors: DataFrame, window_us: int, same_camera: float, other_camera: float, margin: float) -> DataFrame:
    """track_id, global_id, distance: anonymous tracks named by the body of a face-verified one near in time.

    The class must be one of the anchor's group; the threshold depends on whether the camera is the same; the
    next identity must be `margin` farther.
    """
    near = anchor_pairs(tracks, anchors, window_us, same_camera, other_camera)
    return ranked.margin_winners(near, "track_id", "_gid", "dist", 3.0, margin).withColumnRenamed("_gid", "global_id")


def gallery(tracks: DataFrame, labels: DataFrame, since_us: int | None = None, least: int = 1) -> DataFrame:
    """One row per identity with tracks or a label: counts, first and last seen, cameras, best picture.

    With `since_us` identities without a track since then are hidden, labelled or not.
    """
    t = tracks.filter(F.col("global_id").isNotNull())
    if since_us is not None:
        t = t.filter(F.col("started_us") >= since_us)
    rows = t.groupBy("global_id").agg(
        F.count("*").alias("n_tracks"),
        F.count_if(F.coalesce("face_verified", F.lit(False))).alias("n_faces"),
        F.min("started_us").alias("first_us"),
        F.max("ended_us").alias("last_us"),
        F.array_sort(F.collect_set("camera_id")).alias("cameras"),
        F.max_by("thumbnail", F.struct("n_observations", "track_id")).alias("thumbnail"),
        F.bool_or(F.coalesce("face_verified", F.lit(False))).alias("face_seen"),
    )
    got = rows.join(labels, "global_id", "full" if since_us is None else "left")
    return got.withColumn("n_tracks", F.coalesce("n_tracks", F.lit(0))).filter((F.col("n_tracks") >= least) | F.col("name").isNotNull())


def evidence(photos: DataFrame, canonical: DataFrame) -> DataFrame:
    """All vectors an identity may be matched by: its photos and its own."""
    names = ["global_id", "model", "embedding"]
    return photos.select(*names, F.lit("photo").alias("origin")).unionByName(canonical.filter(F.col("embedding").isNotNull()).select(*names, F.lit("label").alias("origin")))


def identity_ids(*sources: DataFrame) -> DataFrame:
    out = sources[0].select("global_id")
    for s in sources[1:]:
        out = out.union(s.select("global_id"))
    return out.filter(F.col("global_id").isNotNull()).distinct()


def merged(table: DataFrame, mapping: DataFrame, column: str = "global_id") -> DataFrame:
    """`table` with identities re-keyed by mapping (old, new)."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return table.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).select(table.columns)


def merged_presence(episodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Open episodes of one identity on one camera fold into the earliest; closed ones stay."""
    own = merged(episodes, mapping)
    open_ = own.filter(F.col("departed_us").isNull())
    folded = open_.groupBy("global_id", "camera_id").agg(
        F.min_by("episode_id", F.struct("present_us", "episode_id")).alias("episode_id"),
        F.max("evidence").alias("evidence"),
        F.min("present_us").alias("present_us"),
        F.max("confirmed_us").alias("confirmed_us"),
    )
    return own.filter(F.col("departed_us").isNotNull()).unionByName(folded, allowMissingColumns=True).select(own.columns)


def split(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tracks taken out of their identity get their own id as one."""
    out = ids.select("track_id", F.lit(True).alias("_out"))
    return tracks.join(out, "track_id", "left").withColumn("global_id", F.when(F.col("_out"), F.col("track_id").cast("string")).otherwise(F.col("global_id"))).select(tracks.columns)


def named(tracks: DataFrame, face: DataFrame, live: DataFrame, pets: DataFrame, body: DataFrame, chain: DataFrame) -> DataFrame:
    """track_id, global_id, identity_source by the first that knows: face, live verdict, pet reference, same-camera body, new.

    A still anonymous track (body or new) may then be overruled by the face-anchored chain. Each source has
    (track_id, global_id); the live one also `fits`.
    """
    out = tracks.select("track_id")
    for name, source in (("face", face), ("live", live.filter("fits").drop("fits")), ("pet", pets), ("body", body), ("chain", chain)):
        out = out.join(source.select("track_id", F.col("global_id").alias(f"_{name}")), "track_id", "left")
    sure = F.coalesce("_face", "_live", "_pet")
    source = F.when(F.col("_face").isNotNull(), "face").when(F.col("_live").isNotNull(), "live").when(F.col("_pet").isNotNull(), "pet").when(F.col("_chain").isNotNull(), "chain").when(F.col("_body").isNotNull(), "body").otherwise("new")
    return out.select("track_id", F.coalesce(sure, "_chain", "_body", F.col("track_id").cast("string")).alias("global_id"), source.alias("identity_source"))


def fits_class(kind: Column, match_kind: Column, canonical: Column) -> Column:
    """Whether an identity may name a track of a class: what it matches as decides, else what it is."""
    own = F.coalesce(match_kind, kind)
    return own.isNull() | (F.when(own == "pet", F.lit("animal")).otherwise(own) == canonical)


def best_face(samples: DataFrame, keys: list[str], frontal: float = 0.35) -> DataFrame:
    """The best face sample: re-aligned before not, frontal before not, then by score."""
    tier = F.when(F.coalesce("face_realigned", F.lit(False)), 0).otherwise(1)
    front = F.when(F.col("face_frontality") <= frontal, 0).otherwise(1)
    return ranked.best(samples.filter(F.col("face_score").isNotNull()), keys, [tier, front, F.col("face_score").desc(), F.col("sample_id")])


def best_body(samples: DataFrame, keys: list[str], vehicle: Column) -> DataFrame:
    """The best body sample: of a vehicle one in motion, then by confidence."""
    still = F.when(vehicle & F.coalesce("at_rest", F.lit(False)), 1).otherwise(0)
    return ranked.best(samples, keys, [still, F.col("confidence").desc(), F.col("sample_id")])


def reference_photos(candidates: DataFrame, k: int, least: float) -> DataFrame:
    """Chosen references of each identity: far from one another, and none a near duplicate."""
    far = greedy.farthest(candidates, ["global_id"], "track_id", "n_observations", "embedding", k)
    rows = candidates.join(far, ["global_id", "track_id"])
    return greedy.distinct_vectors(rows, ["global_id"], "track_id", "pick", "embedding", least)


def samples_of_tracks(samples: DataFrame, tracks: DataFrame, slack_us: int) -> DataFrame:
    """Samples bound to the track of their camera and local id whose span, with slack, holds them."""
    t = tracks.select("camera_id", "local_track_id", F.col("track_id").alias("_track"), F.col("started_us").alias("_s"), F.col("ended_us").alias("_e"))
    met = rangejoin.overlapping(samples, t, ["camera_id", "local_track_id"], (F.col("captured_us"), F.col("captured_us")), (F.col("_s") - slack_us, F.col("_e") + slack_us), T.HOUR)
    first = ranked.best(met, ["sample_id"], [F.col("_s").desc(), F.col("_track")])
    return first.select("sample_id", F.col("_track").alias("track_id"))


def face_audit(tracks: DataFrame, dists: DataFrame, most: float, gap: float) -> DataFrame:
    """track_id, verdict of named faces: agree, reassign, clear or unusable."""
    found = ranked.rival_gap(dists, "track_id", "candidate", "dist")
    rows = tracks.select("track_id", "global_id").join(found, "track_id", "left")
    sure = (F.col("distance") < most) & (F.col("gap").isNull() | (F.col("gap") >= gap))
    verdict = F.when(F.col("distance").isNull(), "unusable").when(sure & (F.col("candidate") == F.col("global_id")), "agree").when(sure, "reassign").otherwise("clear")
    return rows.select("track_id", verdict.alias("verdict"), "candidate")


def rank_one(dists: DataFrame, probe: str, candidate: str, truth: DataFrame) -> DataFrame:
    """One row: share of probes whose nearest identity is right, mean distances and d' of genuine and other pairs."""
    rows = dists.join(truth.select(F.col(probe), F.col(candidate).alias("_true")), probe)
    first = ranked.best(rows, [probe], [F.col("dist"), F.col(candidate)])
    hit = first.agg(F.avg((F.col(candidate) == F.col("_true")).cast("double")).alias("rank1"))
    same = F.col(candidate) == F.col("_true")
    stat = rows.agg(
        F.avg(F.when(same, F.col("dist"))).alias("genuine"),
        F.avg(F.when(~same, F.col("dist"))).alias("impostor"),
        F.var_pop(F.when(same, F.col("dist"))).alias("_vg"),
        F.var_pop(F.when(~same, F.col("dist"))).alias("_vi"),
    )
    return hit.crossJoin(stat).select("rank1", "genuine", "impostor", ((F.col("impostor") - F.col("genuine")) / F.sqrt((F.col("_vg") + F.col("_vi")) / 2)).alias("d_prime"))  # one row each


def threshold_sweep(nearest_rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """tau, correct, wrong, anonymous over rows (dist, is_right)."""
    rows = nearest_rows.withColumn("tau", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    within = F.col("dist") < F.col("tau")
    return rows.groupBy("tau").agg(F.count_if(within & F.col("is_right")).alias("correct"), F.count_if(within & ~F.col("is_right")).alias("wrong"), F.count_if(~within).alias("anonymous"))


def updated(table: DataFrame, arrays: DataFrame, key: str, ids: str, values: str, column: str) -> DataFrame:
    """`table` with `column` set for the keys of parallel arrays (ids, values); the keys of all arrays are unique."""
    rows = arrays.select(F.inline(F.arrays_zip(F.col(ids).alias("a"), F.col(values).alias("b")))).toDF(key, "_new")
    return table.join(rows.withColumn("_hit", F.lit(True)), key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(table.columns)


def detail(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per identity: its label's name or its tracks' own, counts, cameras, whether a face confirmed it, its tracks in time."""
    rows = tracks.filter(F.col("global_id").isNotNull()).groupBy("global_id").agg(
        F.count("*").alias("n_tracks"),
        F.min("identity_name").alias("_own"),
        F.bool_or(F.coalesce("face_verified", F.lit(False))).alias("face_confirmed"),
        F.sort_array(F.collect_set("camera_id")).alias("cameras"),
        F.sort_array(F.collect_list(F.struct("started_us", "track_id", "camera_id", "ended_us"))).alias("tracks"),
    )
    return rows.join(labels.select("global_id", "name"), "global_id", "left").withColumn("name", F.coalesce("name", "_own")).drop("_own")


def late_named(tracks: DataFrame, won: DataFrame, days: int) -> DataFrame:
    """Anonymous tracks named by a face found later (track_id, global_id): verified, and kept for the days of the named.

    A track with a name keeps it; a later date already set is never shortened.
    """
    found = won.select("track_id", F.col("global_id").alias("_won"))
    got = tracks.join(found, "track_id", "left").withColumn("_take", F.col("_won").isNotNull() & F.col("global_id").isNull())
    until = F.when(F.col("_take"), F.greatest("retain_until_us", F.col("ended_us") + days * F.lit(T.DAY))).otherwise(F.col("retain_until_us"))
    return got.withColumn("retain_until_us", until).withColumn("face_verified", F.col("_take") | F.coalesce("face_verified", F.lit(False))).withColumn("global_id", F.when(F.col("_take"), F.col("_won")).otherwise(F.col("global_id"))).select(tracks.columns)


def renamed_by_body(tracks: DataFrame, won: DataFrame, days: int) -> DataFrame:
    """Anonymous tracks named by an anchor's body (track_id, global_id): kept as the named are, but no face was seen, so they anchor nothing."""
    seen = tracks.withColumn("_face", F.col("face_verified"))
    return late_named(seen, won, days).withColumn("face_verified", F.col("_face")).select(tracks.columns)


def reswept(tracks: DataFrame, faces: DataFrame, evidence: DataFrame, now_us: int, window_us: int, most: float, margin: float, near_us: int, same_camera: float, other_camera: float, body_margin: float, days: int) -> DataFrame:
    """`tracks` after a late look at those without a name that began in the window: first by face, then by the body of a face.

    `faces` (track_id, embedding, model) are usable samples, `evidence` (global_id, embedding, model) what the named are known
    by. Tracks have class_id, started_us, ended_us, camera_id, embedding, face_verified, global_id, retain_until_us; track_id is unique.
    A track named by face anchors the second step at once. Only faces anchor, so after the second step nothing more can be
    found: two steps reach the fixed point, and a second call changes nothing but what rows of other calls bring.
    """
    recent = lambda df: df.filter(F.col("global_id").isNull() & (F.col("started_us") > now_us - window_us) & F.col("class_id").isNotNull())
    probes = faces.join(recent(tracks).select("track_id"), "track_id", "left_semi").filter(F.col("embedding").isNotNull())
    near = leaders(probes, evidence.filter(F.col("embedding").isNotNull()), "track_id", "global_id", "embedding", "model")
    by_face = ranked.margin_winners(near, "track_id", "global_id", "dist", most, margin).select("track_id", "global_id").persist()  # small, and asked three times
    known = late_named(tracks, by_face, days)
    verified = known.filter(F.coalesce("face_verified", F.lit(False)) & F.col("global_id").isNotNull() & F.col("embedding").isNotNull())
    anchors = verified.select(F.array("class_id").alias("class_ids"), "camera_id", "global_id", F.explode(F.array_distinct(F.array("started_us", "ended_us"))).alias("at_us"), "embedding")
    open_ = recent(known).filter(F.col("embedding").isNotNull()).select("track_id", "camera_id", "class_id", "started_us", "ended_us", "embedding")
    return renamed_by_body(known, near_anchors(open_, anchors, near_us, same_camera, other_camera, body_margin), days)


def paired_bootstrap(outcomes: DataFrame, probe: str, first: str, second: str, replicates: int = 400, seed: int = 7, groups: list[str] | None = None) -> DataFrame:
    """groups, n, mean_first, mean_second, difference, low, high: how far two models differ on the same probes, with the middle 95 % of replicates.

    `first` and `second` are outcomes of a probe (a hit as 0 or 1, or any number); rows with a null one are left out.
    A replicate draws each probe a Poisson number of times, read off a hash of seed, probe and replicate, so all
    replicates are one pass with partial sums, the same at every partitioning, and a probe weighs alike on both models.
    Replicates that draw nothing are left out; a group without rows gives no row.
    """
    keys = groups or []
    rows = outcomes.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*keys, F.col(probe).alias("_p"), F.col(first).cast("double").alias("_a"), F.col(second).cast("double").alias("_b"))
    drawn = rows.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_p").cast("string"), F.col("_rep").cast("string"))), 1, 8), 16, 10).cast("long")
    weight = sum((F.when(u >= cut, 1).otherwise(0) for cut in POISSON_CUTS), F.lit(0))
    sums = drawn.withColumn("_w", weight).groupBy(*keys, "_rep").agg(F.sum(F.col("_w") * (F.col("_a") - F.col("_b"))).alias("_d"), F.sum("_w").alias("_n"))
    spread = sums.filter("_n > 0").groupBy(*keys).agg(*(F.percentile(F.col("_d") / F.col("_n"), q).alias(name) for q, name in ((0.025, "low"), (0.975, "high"))))
    means = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_a").alias("mean_first"), F.avg("_b").alias("mean_second"), F.avg(F.col("_a") - F.col("_b")).alias("difference"))
    if keys:
        return means.join(spread, keys)
    return means.crossJoin(spread).filter("n > 0")  # one row each


#: 2**32 times the share of a Poisson variable of mean 1 that is at most 0, 1, ... 9.
POISSON_CUTS = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))


def tar_at_far(dists: DataFrame, probe: str, candidate: str, truth: DataFrame, far: float) -> DataFrame:
    """One row: the distance below which a share `far` of other pairs lies, and the share of genuine pairs below it."""
    rows = dists.join(truth.select(F.col(probe), F.col(candidate).alias("_true")), probe).withColumn("_same", F.col(candidate) == F.col("_true"))
    cut = rows.filter(~F.col("_same")).agg(F.percentile("dist", far).alias("threshold"))
    hits = rows.filter("_same").crossJoin(F.broadcast(cut))  # one row
    return hits.agg(F.max("threshold").alias("threshold"), F.avg((F.col("dist") < F.col("threshold")).cast("double")).alias("tar"))
