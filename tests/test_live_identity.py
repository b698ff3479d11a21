"""Live identities, late resweeps and the paired bootstrap against plain Python."""

from __future__ import annotations

import json
import math
import os
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.functions import times as T
from vigilake.operators import identity
from vigilake.plans.catalog import QUERIES
from vigilake.plans.logical import Lake
from vigilake.plans import late
from vigilake.streaming import live_identity as L
from vigilake.streaming.ordered import STATE_STORE

S = T.SECOND
SEEN, FACES = "camera_id long, track_id long, at_us long", "camera_id long, track_id long, at_us long, embedding array<double>, model string, score double"
REFERENCES, BODY = "global_id string, name string, embedding array<double>, model string, valid_us long", "camera_id long, track_id long, at_us long, global_id string, name string, dist double"
RULES = L.Rules(most=0.3, margin=0.05, body_margin=0.05)


def cosine(a, b):
    return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def asked(track, now, faces, references, body, rules):
    """The face and the body verdict from all that is known now, each sample with each reference."""

    def best(dists, margin):
        least = {}
        for gid, name, d in dists:
            least[gid] = min(least.get(gid, (9.0, "")), (d, name))
        order = sorted((d, gid, name) for gid, (d, name) in least.items())
        return order[0] if order and (len(order) < 2 or order[1][0] - order[0][0] >= margin) else None

    own = [f for f in faces if f[:2] == track and None not in (f[3], f[4]) and f[2] <= now < f[2] + rules.horizon_us]
    near = best([(r[0], r[1], cosine(f[3], r[2])) for f in own for r in references if r[1] and r[2] and r[3] == f[4] and (r[4] or 0) <= now], rules.margin)
    if near and near[0] >= rules.most:
        near = None
    chain = best([(b[3], b[4], b[5]) for b in body if b[:2] == track and b[2] <= now < b[2] + rules.horizon_us], rules.body_margin)
    return near, max((f[5] or 0.0 for f in own), default=0.0), chain


def plain(seen, faces, references, body, rules):
    out, held, tried, last = [], {}, {}, {}
    for cam, t, now in sorted(seen):
        k = (cam, t)
        if now - last.get(k, now) > rules.forgotten_us:
            held.pop(k, None), tried.pop(k, None)
        last[k] = now
        if held.get(k, ("", "", ""))[2] != "face" and (k not in tried or now - tried[k] >= rules.retry_us):
            tried[k] = now
            face, score, chain = asked(k, now, faces, references, body, rules)
            if face and (k not in held or score >= rules.confident):
                held[k] = (face[1], face[2], "face")
            elif k not in held and chain:
                held[k] = (chain[1], chain[2], "body")
        out.append((cam, t, now, *held.get(k, (None, None, None))))
    return out


def scene(seed=2):
    rng = random.Random(seed)
    people = {f"g{i}": [rng.gauss(0, 1) for _ in range(6)] for i in range(6)}
    near = lambda v, s: [x + rng.gauss(0, s) for x in v]
    references = [(g, f"name {g}", near(v, 0.2), rng.choice(["m", "m", "old"]), rng.choice([None, None, 40 * S, 300 * S])) for g, v in people.items() for _ in range(2)]
    references += [("g0", None, people["g0"], "m", None), ("g1", "name g1", None, "m", None)]
    seen, faces, body = [], [], []
    for t in range(24):
        cam, at, who = t % 3, rng.randint(0, 200) * S // 2, rng.choice(list(people.values()))
        for _ in range(60):
            at += rng.choice([S // 2, S, 3 * S, 3 * S, 20 * S, 310 * S if rng.random() < 0.2 else S])
            seen.append((cam, t, at))
            if rng.random() < 0.15:
                faces.append((cam, t, at - rng.randint(0, 2) * S // 2, rng.choice([near(who, 0.5), near(who, 0.9), None]), rng.choice(["m", "m", "old", None]), rng.choice([0.3, 0.6, 0.9, None])))
            if rng.random() < 0.06:
                body.append((cam, t, at, g := rng.choice(["g0", "g1", "g2"]), f"name {g}", round(rng.uniform(0.05, 0.3), 3)))
    return seen + seen[:5], faces + faces[:3], references, body


def test_verdicts_are_those_of_asking_everything_anew(spark):
    seen, faces, references, body = scene()
    rows = L.evidence_rows(spark.createDataFrame(seen, SEEN), spark.createDataFrame(faces, FACES), spark.createDataFrame(references, REFERENCES), spark.createDataFrame(body, BODY), RULES)
    got, want = sorted(map(tuple, L.verdicts(rows, RULES).collect()), key=str), sorted(plain(seen, faces, references, body, RULES), key=str)
    assert got == want
    turns = {}
    for r in sorted(want, key=lambda r: r[:3]):
        if r[5] and turns.get(r[:2], [None])[-1] != r[5]:
            turns.setdefault(r[:2], []).append(r[5])
    assert ["body", "face"] in turns.values() and ["face"] in turns.values() and ["body"] in turns.values()


def test_a_reference_enrolled_later_names_who_is_still_there_and_a_weak_face_does_not_unseat_a_body(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    seen = [(0, 1, i * S) for i in range(12)] + [(0, 2, i * S) for i in range(12)]
    faces = [(0, 1, 0, a, "m", 0.5), (0, 2, 4 * S, a, "m", 0.5), (0, 2, 8 * S, a, "m", 0.9)]
    references = [("ana", "Ana", a, "m", 5 * S), ("bo", "Bo", b, "m", None)]
    rows = L.evidence_rows(spark.createDataFrame(seen, SEEN), spark.createDataFrame(faces, FACES), spark.createDataFrame(references, REFERENCES), spark.createDataFrame([(0, 2, S, "bo", "Bo", 0.1)], BODY), RULES)
    got = {(r.track_id, r.at_us // S): (r.name, r.source) for r in L.verdicts(rows, RULES).collect()}
    assert [got[1, i] for i in (0, 5, 6, 11)] == [(None, None), (None, None), ("Ana", "face"), ("Ana", "face")]
    assert [got[2, i] for i in (0, 2, 6, 8, 11)] == [(None, None), ("Bo", "body"), ("Bo", "body"), ("Ana", "face"), ("Ana", "face")]
    shown = {(r.at_us // S, r["name"]): r.source for r in L.on_screen(L.verdicts(rows, RULES)).collect()}
    assert shown[11, "Ana"] == "face" and shown[3, "Bo"] == "body" and (11, "Bo") not in shown
    assert L.verdicts(rows.limit(0), RULES).count() == 0


def test_stream_gives_the_rows_of_the_table_however_it_is_cut(spark, tmp_path):
    seen, faces, references, body = scene(5)
    rows = L.evidence_rows(spark.createDataFrame(seen, SEEN), spark.createDataFrame(faces, FACES), spark.createDataFrame(references, REFERENCES), spark.createDataFrame(body, BODY), RULES)
    made, want = sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["at_us"], r["turn"])), sorted(plain(seen, faces, references, body, RULES), key=str)
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        for size in (400, 900):
            folder = tmp_path / str(size)
            (folder / "in").mkdir(parents=True)
            parts = [made[i : i + size] for i in range(0, len(made), size)] + [[{**made[-1], "camera_id": 9, "at_us": made[-1]["at_us"] + 7200 * S}]]
            for i, part in enumerate(parts):
                file = folder / "in" / f"{i:03}.json"
                file.write_text("".join(json.dumps(r) + "\n" for r in part))
                os.utime(file, (1_700_000_000 + 10 * i,) * 2)
            source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
            query = L.stream_verdicts(source, RULES).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
            assert query.awaitTermination(240) and query.exception() is None
            assert sorted((tuple(r) for r in spark.read.parquet(str(folder / "out")).collect() if r.camera_id != 9), key=str) == want
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")
def test_the_query_over_its_whole_table(spark):
    parts = [[tuple(r) for r in df.collect()] for df in late.live_tables(Lake(spark, ROOT))]
    got = sorted(map(tuple, QUERIES["live_identity"](spark, ROOT).collect()), key=str)
    assert got == sorted(plain(*parts, [], late.LIVE), key=str) and len({r[5] for r in got}) == 2


def test_resweep_names_by_face_then_by_that_faces_body_and_no_further(spark):
    h, d = T.HOUR, T.DAY
    face, body, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    step = lambda k: [0.0, 1.0, 0.1 * k]
    tracks = [
        (1, 1, 0, 100 * h, 101 * h, None, False, None, body),  # has Ana's face
        (2, 2, 0, 102 * h, 103 * h, None, False, 50 * d, step(1)),  # only the body, near 1
        (3, 3, 0, 104 * h, 105 * h, None, False, None, step(2)),  # near 2's body alone in time: 2 saw no face
        (4, 1, 0, 100 * h, 101 * h, "bo", False, None, body),  # named already
        (5, 1, 0, 10 * h, 11 * h, None, False, None, body),  # before the window
        (6, 1, 2, 100 * h, 101 * h, None, False, None, body),  # of another class
        (7, 2, 0, 101 * h, 102 * h, None, False, None, None),  # no body
        (8, 2, 0, 101 * h, 102 * h, None, False, None, other),
    ]
    t = spark.createDataFrame(tracks, "track_id long, camera_id long, class_id int, started_us long, ended_us long, global_id string, face_verified boolean, retain_until_us long, embedding array<double>")
    faces = spark.createDataFrame([(1, [0.9, 0.1, 0.0], "m"), (1, None, "m"), (2, face, "old"), (5, face, "m"), (8, [0.5, 0.5, 0.0], "m")], "track_id long, embedding array<double>, model string")
    evidence = spark.createDataFrame([("ana", face, "m"), ("cy", [0.0, 1.0, 0.0], "m"), ("dee", None, "m")], "global_id string, embedding array<double>, model string")
    call = lambda df: identity.reswept(df, faces, evidence, 200 * h, 150 * h, 0.3, 0.05, 2 * h, 0.1, 0.1, 0.01, 90)
    got = {r.track_id: (r.global_id, r.face_verified, r.retain_until_us) for r in call(t).collect()}
    assert got[1] == ("ana", True, 101 * h + 90 * d) and got[2] == ("ana", False, 103 * h + 90 * d)
    assert got == {1: got[1], 2: got[2]} | {r[0]: r[5:8] for r in tracks[2:]}
    assert {r.track_id: (r.global_id, r.face_verified, r.retain_until_us) for r in call(call(t)).collect()} == got
    assert call(t.limit(0)).count() == 0 and call(t).columns == t.columns


def test_resweep_measures_faces_once_and_evidence_without_length_counts_for_nothing(spark):
    h = T.HOUR
    t = spark.createDataFrame([(1, 1, 0, h, h, None, False, None, [0.0, 1.0])], "track_id long, camera_id long, class_id int, started_us long, ended_us long, global_id string, face_verified boolean, retain_until_us long, embedding array<double>")
    faces = spark.createDataFrame([(1, [1.0, 0.1], "m")], "track_id long, embedding array<double>, model string")
    evidence = spark.createDataFrame([("ana", [1.0, 0.0], "m"), ("zed", [0.0, 0.0], "m")], "global_id string, embedding array<double>, model string")
    got = identity.reswept(t, faces, evidence, 2 * h, 2 * h, 0.3, 0.05, h, 0.1, 0.1, 0.01, 90)
    assert [(r.global_id, r.face_verified) for r in got.collect()] == [("ana", True)]
    assert got._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") == 3  # the winners by face, kept


def test_bootstrap_is_that_of_the_same_weights_in_numpy(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b"]), rng.choice([0, 1, 1]), rng.choice([0, 0, 1, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "probe long, person string, x int, y int")

    def want(own):
        cuts = np.array(identity.POISSON_CUTS)
        u = np.array([[int(md5(f"7:{r[0]}:{k}".encode()).hexdigest()[:8], 16) for r in own] for k in range(1, 101)])
        w, d = (u[:, :, None] >= cuts).sum(2), np.array([r[2] - r[3] for r in own])
        reps = (w * d).sum(1) / w.sum(1)
        return len(own), d.mean(), *np.percentile(reps, [2.5, 97.5])

    used = [r for r in rows if r[3] is not None]
    one = identity.paired_bootstrap(df, "probe", "x", "y", 100).collect()
    assert len(one) == 1 and np.allclose([one[0].n, one[0].difference, one[0].low, one[0].high], want(used))
    assert one == identity.paired_bootstrap(df.repartition(7), "probe", "x", "y", 100).collect() and one[0].low < one[0].difference < one[0].high
    for r in identity.paired_bootstrap(df, "probe", "x", "y", 100, groups=["person"]).collect():
        assert np.allclose([r.n, r.difference, r.low, r.high], want([x for x in used if x[1] == r.person]))
    assert identity.paired_bootstrap(df.limit(0), "probe", "x", "y", 10).count() == 0
    weights = F.lit(identity.POISSON_CUTS[0] / 2**32)
    assert abs(spark.range(1).select(weights).first()[0] - math.exp(-1)) < 1e-9
