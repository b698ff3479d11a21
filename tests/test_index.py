"""The plate index and the quantiles by ranges, against all pairs and sorted lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vigilake.functions import plates as P
from vigilake.functions import quantiles as Q
from vigilake.operators import plates

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def changed(rnd, text):
    out = list(text)
    for _ in range(rnd.choice([0, 1, 1, 2, 3])):
        i = rnd.randrange(len(out) + 1)
        kind = rnd.randrange(4)
        if kind == 0:
            out.insert(i, rnd.choice(CHARS))
        elif kind == 1 and len(out) > 1:
            out.pop(i % len(out))
        elif out:
            alike = [g for g in P.LOOK_ALIKE if out[i % len(out)] in g]
            out[i % len(out)] = rnd.choice(rnd.choice(alike)) if alike and kind == 2 else rnd.choice(CHARS)
    return "".join(out) or "A"


def plates_and_texts(seed, n=70):
    rnd = random.Random(seed)
    known = list(dict.fromkeys("".join(rnd.choice("ZGST018BK") if k < 2 else rnd.choice(CHARS) for k in range(rnd.choice([2, 3, 5, 6, 7, 7, 8, 8, 9, 10]))) for _ in range(n)))
    texts = list(dict.fromkeys([changed(rnd, rnd.choice(known)) for _ in range(2 * n)] + [rnd.choice(known)[a : a + 6] for a in (0, 1, 2) for _ in range(n // 3)]))
    return known, texts


def near(t, g):
    whole = P.weighted_distance(t, g, False)
    return min(whole, P.weighted_distance(t, g, True)) if len(t) < 7 else whole


@pytest.mark.parametrize(("seed", "most", "margin"), [(1, 1.5, 1.5), (2, 1.5, 1.5), (3, 1.0, 0.8), (4, 2.0, 0.0)])
def test_matches_equal_all_pairs(spark, seed, most, margin):
    known, texts = plates_and_texts(seed)
    want = {}
    for t in texts:
        by = sorted((near(t, g), i) for i, g in enumerate(known))
        if by[0][0] <= most + 1e-9 and (len(by) == 1 or by[1][0] - by[0][0] >= margin):
            want[t] = (by[0][1], round(by[0][0], 9))
    readings = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, plate string")
    gallery = spark.createDataFrame([(i, g) for i, g in enumerate(known)], "global_id long, plate string")
    got = {texts[r.id]: (r.global_id, round(r.distance, 9)) for r in plates.matched(readings, gallery, "id", "plate", most, margin).collect()}
    ties = {t for t in want if margin == 0 and sum(abs(near(t, g) - want[t][1]) < 1e-9 for g in known) > 1}
    assert {t: x for t, x in got.items() if t not in ties} == {t: x for t, x in want.items() if t not in ties} and len(got) > 20


def test_no_near_pair_is_missed_and_few_others_are_met(spark):
    known, texts = plates_and_texts(9, 150)
    t, g = spark.createDataFrame([(x,) for x in texts], "_t string"), spark.createDataFrame([(x,) for x in known], "_g string")
    met = {tuple(r) for r in plates.candidates(t, g, 2).collect()}
    close = {(a, b) for a in texts for b in known if near(a, b) < 3.0}
    assert close <= met and len(met) < 0.2 * len(texts) * len(known)
    assert plates.candidates(t.limit(0), g, 2).collect() == []


@pytest.mark.parametrize("pieces", [2, 16, 256])
def test_quantiles_equal_sorted_lists(spark, pieces):
    """A hot key, repeated values, a null key, nulls, a key without values, columns named like the work's own."""
    rnd = random.Random(pieces)
    rows = [(1, rnd.choice([rnd.gauss(0, 1000), 7.0, 7.0])) for _ in range(3000)] + [(rnd.choice([2, None]), rnd.choice([None, float(rnd.randrange(9))])) for _ in range(300)] + [(3, None), (4, -0.5)]
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(v for key, v in rows if key == k and v is not None)
        want[k] = tuple(own[round(q * (len(own) - 1))] if own else 0.0 for q in (0.0, 0.5, 0.95, 1.0))
    df = spark.createDataFrame(rows, "_v long, value double").repartition(4)
    got = Q.nearest_rank(df, ["_v"], "value", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}, pieces)
    assert {r._v: (r.a, r.b, r.c, r.d) for r in got.collect()} == want
    assert Q.nearest_rank(df.limit(0), ["_v"], "value", {"a": 0.5}).collect() == []
    assert Q.nearest_rank(df.filter(F.col("_v") == 1), ["_v"], "value", {"b": 0.5}).columns == ["_v", "b"]


def test_pairs_measured_together():
    import random

    rng = random.Random(5)
    text = lambda: "".join(rng.choice("0OQB8AZ2S5") for _ in range(rng.randrange(0, 10)))
    pairs = [(text(), text()) for _ in range(600)]
    for partial in (False, True):
        assert P.weighted_distances(pairs, partial).tolist() == [P.weighted_distance(a, b, partial) for a, b in pairs]
