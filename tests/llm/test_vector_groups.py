"""A query travels once for each group of leaves it opens, and a group answers with k rows at most."""

from __future__ import annotations

import numpy as np

from vigilake.llm import ann


def grown(n=4000, depth=7, dims=24):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, ann.grow(x, rng.normal(size=(dims + 1, 24)), 1.0, depth), ann.chi_square_quantile(0.85, 24)


def test_open_groups_are_those_of_the_open_leaves():
    x, tree, stop = grown()
    q, known = x[:60], np.where(np.arange(60) % 3 == 0, -np.inf, np.linspace(0.2, 0.9999, 60))
    home = tree.leaf(tree.project(q, query=True))
    got = ann.open_groups(tree, q, known, home, 8, stop)
    points = tree.project(q, query=True)
    for i, groups in enumerate(got):
        d = np.maximum(np.maximum(tree.low - points[i], points[i] - tree.high), 0)
        leaves = np.flatnonzero((d * d).sum(axis=1) <= stop * max(0, 1 + 1 - 2 * known[i]) + 1e-9) if np.isfinite(known[i]) else np.arange(128)
        assert groups.tolist() == sorted(set((leaves // 8).tolist()) - {home[i] // 8})
    assert len(got) == 60 and max(map(len, got)) == 15 and min(map(len, got)) < 15


def test_a_group_answers_with_its_k_best():
    x, tree, stop = grown()
    leaves = tree.leaf(tree.project(x))
    rows = np.flatnonzero(leaves < 16)
    q, ids = x[::80], np.arange(len(x))
    home = tree.leaf(tree.project(q, query=True))
    found = verified = apart = 0
    for i, at, scores, n in ann.search_group(tree, leaves[rows], ids[rows], x[rows], q, ids[::80], np.full(len(q), -np.inf), home, 10, stop):
        s = x[rows] @ q[i]
        s[rows == 80 * i] = -9
        assert len(at) == len(set(at.tolist())) == 10 and np.allclose(scores, s[at]) and (np.diff(scores) <= 0).all()
        found += len(set(at.tolist()) & set(np.argsort(-s)[:10].tolist()))
        verified += n
        apart += sum(len(rows) and m for *_, m in [y for leaf in range(16) for own in [rows[leaves[rows] == leaf]] for y in ann.search_leaf(tree, ids[own], x[own], tree.project(x[own]), q[i : i + 1], ids[::80][i : i + 1], np.array([-np.inf]), 10, stop)])
    assert found >= 0.85 * 10 * len(q) and verified < apart  # the k-th best goes from leaf to leaf


def test_the_search_over_groups_finds_the_nearest(spark, monkeypatch):
    """Leaves in groups, queries in parts; answers leave a task by the group, and all that is routed is a row for each query."""
    monkeypatch.setattr(ann, "GROUPS", 8)
    monkeypatch.setattr(ann, "PART_CELLS", 24 * 100)
    x, _, _ = grown(3000)
    tables, real = [], ann.stored
    monkeypatch.setattr(ann, "stored", lambda df: tables.append(real(df)) or tables[-1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=10, leaf_rows=32).collect()
    routed = [t for t in tables if "groups" in t.columns]
    assert len(routed) == 1 and routed[0].count() == 150
    s = x[::20] @ x.T
    s[np.arange(150), 20 * np.arange(150)] = -9
    want = {(20 * i, int(j)) for i in range(150) for j in np.argsort(-s[i])[:10]}
    assert len(got) == 1500 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * 1500
    assert all(abs(x[r.query_id] @ x[r.vec_id] - r.score) < 1e-9 for r in got)
