from __future__ import annotations

import numpy as np
import pytest

from vigilake.llm import ann, topk

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, asked, k, scale=None, nonzero=False):
    clean = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or (nonzero and not any(v)):
            continue
        x = np.array(v, np.float32).astype(float)
        clean[i] = np.floor(x * scale).astype(np.int64) if scale else x
    out = []
    for q in sorted({x for x in asked if x in clean}):
        found = sorted(((-clean[q] @ v, i) for i, v in clean.items() if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def vectors(n, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims))
    x = centres[rng.integers(9, size=n)] + 0.4 * rng.normal(size=(n, dims))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


ODD = [(5500, None), (5501, [None] * 16), (5502, [NAN] * 16), (5503, [INF] * 16), (5504, []), (None, [0.5] * 16)]


@pytest.mark.parametrize("block_rows", [64, 5000])
def test_topk_matches_brute_force(spark, block_rows):
    rows = vectors(400) + [(600 + i, [0.25] * 16) for i in range(30)] + ODD
    asked = [i for i, _ in rows if i is not None and i % 20 == 0]
    df = table(spark, rows)
    found = topk.search(df, df.filter("vec_id % 20 = 0"), k=7, block_rows=block_rows)
    assert got(found) == brute(rows, asked, 7, 1024)


def test_topk_with_few_candidates_and_none(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0])]
    df = table(spark, rows)
    assert got(topk.search(df, df, k=10)) == brute(rows, [0, 1, 2], 10, 1024)
    assert got(topk.search(table(spark, []), table(spark, []), k=10)) == []


def test_ann_recall_and_exact_scores(spark):
    rows = vectors(2500) + [(3000 + i, [0.25] * 16) for i in range(40)] + [(4000, [0.0] * 16)] + ODD
    df = table(spark, rows)
    asked = [i for i, _ in rows if i is not None and i % 20 == 0]
    found = got(ann.search(df, df.filter("vec_id % 20 = 0"), k=20, leaf_rows=256))
    want = brute(rows, asked, 20, nonzero=True)
    assert len(found) == len(want)
    assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    clean = {i: np.array(v) for i, v in rows if i is not None and i < 5000 and v and None not in v}
    assert all(abs(float(clean[q] @ clean[v]) - s) < 1e-9 for q, _, v, s in found)
    assert all(q != v for q, _, v, _ in found)


def test_ann_of_an_empty_table(spark):
    assert got(ann.search(table(spark, []), table(spark, []), k=3)) == []
