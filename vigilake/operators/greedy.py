"""Choices whose outcome depends on order: suppression, leaders, far points, one-to-one pairs.

Each works on one bounded unit (the boxes of a frame, the references of an identity, the fills of
a place). Nested arrays are folded by expressions, without a shuffle; what compares against all
earlier choices with vectors runs as a small numpy loop over one group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def suppressed(items: Column, kind: str, order: list[tuple[Callable[[Column], Column], bool]], clashes: Callable[[Column, Column], Column]) -> Column:
    """Items of an array kept one by one in order unless one kept already clashes.

    `order` has (key, descending) of an item; numbers only. `kind` is the array's type.
    """
    keyed = F.transform(items, lambda x: F.struct(*((-key(x) if down else key(x)).cast("double").alias(f"k{i}") for i, (key, down) in enumerate(order)), x.alias("item")))
    ranked = F.transform(F.array_sort(keyed), lambda x: x["item"])
    return F.aggregate(ranked, F.array().cast(kind), lambda held, x: F.when(F.exists(held, lambda h: clashes(h, x)), held).otherwise(F.concat(held, F.array(x))))


def _matrix(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def leaders(df: DataFrame, keys: list[str], item: str, weight: str, vector: str, most: float) -> DataFrame:
    """keys, item, leader: the heaviest items lead; each other joins the first leader nearer than `most`."""

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([weight, item], ascending=[False, True], kind="stable").reset_index(drop=True)
        m, heads, own = _matrix(frame[vector]), [], []
        for i in range(len(frame)):
            near = [h for h in heads if 1 - float(m[h] @ m[i]) < most]
            own.append(near[0] if near else i)
            if not near:
                heads.append(i)
        return frame[[*keys, item]].assign(leader=frame[item].to_numpy()[own])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, item]) + f", leader {kinds[item]}"
    return df.select(*keys, item, weight, vector).groupBy(*keys).applyInPandas(cluster, schema)


def farthest(df: DataFrame, keys: list[str], item: str, weight: str, vector: str, k: int) -> DataFrame:
    """keys, item, pick (from 1): the heaviest, then again and again the one farthest from those picked.

    Each pick is one aggregation over all rows, so no group has to fit a task; of rows as far the heavier, then the
    smaller item goes first. `df` is read k times; a repeated item counts as one. A vector of length 0 has distance 1 from all.
    """
    rows = df.select(*keys, F.col(item).alias("_item"), F.isnull(weight).alias("_none"), (-F.col(weight)).alias("_w"), V.normalised(F.col(vector)).alias("_v"))
    order = F.struct("_none", "_w", "_item")
    best = lambda frame, by: frame.groupBy(*keys).agg(F.min_by(F.struct("_item", "_v"), by).alias("_best"))
    picks = best(rows, order).select(*keys, F.array("_best").alias("_picks"))
    for _ in range(k - 1):
        p = picks.select(*(F.col(c).alias(f"_k_{c}") for c in keys), "_picks")
        joined = rows.join(p, [rows[c].eqNullSafe(p[f"_k_{c}"]) for c in keys])
        open_ = joined.filter(~F.exists("_picks", lambda x: x["_item"] == F.col("_item")))
        gap = F.array_min(F.transform("_picks", lambda x: 1 - V.dot(x["_v"], F.col("_v"))))
        found = best(open_, F.struct(-gap, order)).select(*(F.col(c).alias(f"_f_{c}") for c in keys), "_best")
        more = picks.join(found, [picks[c].eqNullSafe(found[f"_f_{c}"]) for c in keys], "left")
        picks = more.select(*keys, F.when(F.col("_best").isNull(), F.col("_picks")).otherwise(F.concat("_picks", F.array("_best"))).alias("_picks"))
    return picks.select(*keys, F.posexplode("_picks").alias("_n", "_p")).select(*keys, F.col("_p._item").alias(item), (F.col("_n") + 1).alias("pick"))


def distinct_vectors(df: DataFrame, keys: list[str], item: str, order: str, vector: str, least: float) -> DataFrame:
    """keys, item: in order, those at least `least` away from every one kept before."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([order, item], kind="stable").reset_index(drop=True)
        m, held = _matrix(frame[vector]), []
        for i in range(len(frame)):
            if not held or float((1 - m[held] @ m[i]).min()) >= least:
                held.append(i)
        return frame.loc[held, [*keys, item]]

    kinds = dict(df.dtypes)
    return df.select(*keys, item, order, vector).groupBy(*keys).applyInPandas(choose, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, item]))


def one_to_one(pairs: DataFrame, keys: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """keys, left, right: pairs taken in order, each left and each right at most once; for candidate pairs of one place."""

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*order, left, right], kind="stable")
        used: tuple[set, set] = (set(), set())
        rows = []
        for i, a, b in zip(frame.index, frame[left], frame[right], strict=True):
            if a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                rows.append(i)
        return frame.loc[rows, [*keys, left, right]]

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(*keys).applyInPandas(take, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, left, right]))
