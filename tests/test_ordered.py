"""Choices that depend on order, and plate matching, against plain Python."""

from __future__ import annotations

import math
import random

from vigilake.functions import plates as P
from vigilake.operators import greedy, plates, rules

COST = {}
for group in P.LOOK_ALIKE:
    for a in group:
        for b in group:
            COST[a, b] = P.LOOK_ALIKE_COST


def edits(a: str, b: str, partial: bool) -> float:
    """The whole table, cell by cell."""
    if not a or not b or (partial and len(a) < P.LEAST_PARTIAL):
        return float(max(len(a), len(b)))
    t = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i:
                t[i][j] = 0.0 if partial else float(j)
            elif not j:
                t[i][j] = float(i)
            else:
                swap = 0.0 if a[i - 1] == b[j - 1] else COST.get((a[i - 1], b[j - 1]), P.OTHER_COST)
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + swap)
    return min(t[-1]) if partial else t[-1][-1]


def test_plates_match_as_a_whole_and_as_a_part(spark):
    rng = random.Random(6)
    sign = lambda n: "".join(rng.choice("ABDEIOQ01258ZGSXK") for _ in range(n))
    known = {f"g{i}": sign(rng.choice((6, 7, 8, 12))) for i in range(25)}
    known["long"] = "QQZG123ABXXKK"
    reads = {0: "ZG123A", 1: "G123AB"}  # parts of a plate twice as long
    for i in range(2, 80):
        t = list(rng.choice(list(known.values())))
        t[rng.randrange(len(t))] = rng.choice("ABDEIOQ01258")
        reads[i] = "".join(t[: rng.choice((6, len(t)))])
    got = plates.matched(spark.createDataFrame(list(reads.items()), "read long, text string"), spark.createDataFrame(list(known.items()), "global_id string, plate string"), "read", "text").collect()
    want = {}
    for i, t in reads.items():
        d = sorted((min(edits(t, k, False), edits(t, k, True)) if len(t) < 7 else edits(t, k, False), g) for g, k in known.items())
        if d[0][0] <= 1.5 and d[1][0] - d[0][0] >= 1.5:
            want[i] = (d[0][1], round(d[0][0], 6))
    assert {r.read: (r.global_id, round(r.distance, 6)) for r in got} == want
    assert want[0] == want[1] == ("long", 0.0)


def test_weighted_distance(spark):
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("A8B0OQZ2") for _ in range(rng.randrange(9))) for _ in range(2))
        for partial in (False, True):
            assert abs(P.weighted_distance(a, b, partial) - edits(a, b, partial)) < 1e-9, (a, b, partial)


def near(a, b):
    return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)


def test_leaders_and_far_points(spark):
    rng = random.Random(9)
    rows = [(i % 3, i, rng.randrange(5), [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, i int, w int, v array<double>")
    leader, pick = {}, {}
    for k in range(3):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        heads = []
        for r in own:
            found = [h for h in heads if near(h[3], r[3]) < 0.5]
            leader[r[1]] = found[0][1] if found else r[1]
            heads += [] if found else [r]
        chosen = [own[0]]
        while len(chosen) < 5:
            chosen.append(max((r for r in own if r not in chosen), key=lambda r: min(near(c[3], r[3]) for c in chosen)))
        pick |= {c[1]: n + 1 for n, c in enumerate(chosen)}
    assert {r.i: r.leader for r in greedy.leaders(df, ["k"], "i", "w", "v", 0.5).collect()} == leader
    assert {r.i: r.pick for r in greedy.farthest(df, ["k"], "i", "w", "v", 5).collect()} == pick


def test_pairs_and_the_token_bucket(spark):
    rng = random.Random(10)
    pairs = [(i % 2, rng.randrange(12), rng.randrange(12), rng.randrange(6)) for i in range(80)]
    taken, used = set(), set()
    for p, a, b, s in sorted(pairs, key=lambda r: (r[0], r[3], r[1], r[2])):
        if ("a", p, a) not in used and ("b", p, b) not in used:
            used |= {("a", p, a), ("b", p, b)}
            taken.add((p, a, b))
    df = spark.createDataFrame(pairs, "p int, a int, b int, s int")
    assert {tuple(r) for r in greedy.one_to_one(df, ["p"], "a", "b", ["s"]).collect()} == taken
    sent = [(c, c * 1000 + i, rng.randrange(120_000_000)) for c in range(3) for i in range(40)]
    sent += [(c, c * 1000 + 100 + i, 300_000_000 * (1 + i % 3) + rng.randrange(20_000_000)) for c in range(2) for i in range(30)]  # after pauses
    want = {}
    for c in range(3):
        tokens, last = 3.0, None
        for _, e, at in sorted((r for r in sent if r[0] == c), key=lambda r: (r[2], r[1])):
            tokens = min(3.0, tokens + (0 if last is None else (at - last) * 3 / 60e6))
            last, want[e] = at, tokens >= 1 - 1e-9
            tokens -= want[e]
    sent.append((1, 9999, None))
    want[9999] = None
    df = spark.createDataFrame(sent, "channel_id long, event_id long, at_us long")
    assert {r.event_id: r.allowed for r in rules.rate_limited(df, 3).collect()} == want
