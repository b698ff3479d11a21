"""Approximate nearest neighbours by stable random projections, a kd-tree and a chi-square stop.

A normal (2-stable) projection to m dimensions turns a squared distance D into D times a
chi-square variable of m degrees of freedom. A kd-tree over the projected vectors, fitted to
a bounded sample, deals all vectors to its leaves. In a leaf a query takes its projected
neighbours a few at a time in ascending projected distance and verifies each by its true
score. It stops when the next projected distance is so large that a vector nearer than the
k-th best found so far would lie beyond it with probability 1 - confidence at most. The home
leaf comes first; its k-th best then tells which other leaves the test leaves open. Neighbouring
leaves form a group that one task walks, carrying a query's k-th best from leaf to leaf: the home
group first, then the others in parallel, each from the home group's bound on. So a query
travels once for each group it opens, not for each leaf, and a group answers with k rows at most.

The largest inner product is the smallest distance once every vector is lengthened by a
coordinate that brings it to the largest norm; a query's own added coordinate is 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, block_of, first_copies, matrix, ranked, usable
from .common import bounded_sample, stored

SCHEMA = "query_id long, vec_id long, score double"
#: Vectors that the tree is fitted to at most, in expectation, and their numbers; every vector is indexed.
SAMPLE, SAMPLE_CELLS = 16_384, 4_000_000
#: Numbers of a group's vectors and of a part of the queries, about, that a task holds; groups that there are where leaves suffice.
GROUP_CELLS, PART_CELLS, GROUPS = 2_097_152, 1_048_576, 64


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile for an even number m of degrees of freedom."""

    def upper(x: float) -> float:
        return math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1.0
    while upper(high) > 1 - p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > 1 - p else (low, mid)
    return high


@dataclass
class Tree:
    """A projection and a kd-tree whose leaves are numbered from 0; low and high bound each leaf's cell."""

    projection: np.ndarray
    norm2: float
    axis: list[int]
    cut: list[float]
    low: np.ndarray
    high: np.ndarray

    def project(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.norm2 - (rows * rows).sum(axis=1), 0))
        return rows @ self.projection[:-1] + extra[:, None] * self.projection[-1]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """Nodes are numbered as in a heap; the last level are the leaves."""
        node, inner = np.zeros(len(points), np.int64), len(self.axis)
        axis, cut = np.array(self.axis, np.int64), np.array(self.cut)
        for _ in range((inner + 1).bit_length() - 1):
            right = points[np.arange(len(points)), axis[node]] > cut[node]
            node = 2 * node + 1 + right
        return node - inner

    def gap2(self, points: np.ndarray, leaf: int) -> np.ndarray:
        """Squared distances to a leaf's cell."""
        d = np.maximum(np.maximum(self.low[leaf] - points, points - self.high[leaf]), 0)
        return (d * d).sum(axis=1)


def grow(sample: np.ndarray, projection: np.ndarray, norm2: float, depth: int) -> Tree:
    """Median cuts along the axis of largest spread, to a full tree of 2**depth leaves."""
    tree = Tree(projection, norm2, [], [], np.empty(0), np.empty(0))
    m = projection.shape[1]
    points = tree.project(sample)
    level = [(points, np.full(m, -np.inf), np.full(m, np.inf))]
    for _ in range(depth):
        after = []
        for own, low, high in level:
            a = int(own.std(axis=0).argmax()) if len(own) else 0
            c = float(np.median(own[:, a])) if len(own) else 0.0
            tree.axis.append(a)
            tree.cut.append(c)
            left_high, right_low = high.copy(), low.copy()
            left_high[a] = right_low[a] = c
            side = own[:, a] > c
            after += [(own[~side], low, left_high), (own[side], right_low, high)]
        level = after
    tree.low, tree.high = np.array([x[1] for x in level]), np.array([x[2] for x in level])
    return tree


def walked(gap2: np.ndarray, rows: np.ndarray, q: np.ndarray, bound: float, k: int, limit: Callable[[float], float], step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, how many were verified) of the projected neighbours that one query meets in a leaf.

    `gap2` has their squared projected distances, `bound` a k-th best score known (-inf for none), and
    limit(bound) the projected distance at which the test holds. Of the verified only those that may be
    among the k best come back.
    """
    reach = limit(bound)
    order = np.flatnonzero(gap2 <= reach)
    ascending = gap2[order]
    by = np.argsort(ascending)
    order, ascending = order[by], ascending[by]
    at, size = 0, step if np.isfinite(bound) else 4 * k
    places, scores = [], []
    nearest = np.empty(0)
    while at < len(order) and ascending[at] <= reach:
        own = order[at : at + size]
        found = rows[own] @ q
        places.append(own)
        scores.append(found)
        at, size = at + len(own), step
        nearest = np.concatenate([nearest, found])
        if len(nearest) >= k:
            nearest = np.partition(nearest, len(nearest) - k)[len(nearest) - k :]
            bound = max(bound, float(nearest[0]))
            reach = limit(bound)
    if not places:
        return np.empty(0, np.int64), np.empty(0), 0
    # the product above rounds by place; what may count is scored again, row by row, so that equal vectors tie
    able = np.concatenate(places)[np.concatenate(scores) >= bound - 1e-9 * (1 + abs(bound))] if np.isfinite(bound) else np.concatenate(places)
    return able, (rows[able] * q).sum(axis=1), at


def search_leaf(tree: Tree, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, queries: np.ndarray, own: np.ndarray, known: np.ndarray, k: int, stop: float, width: int = 512, step: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, places, scores, how many it verified): for each query what a leaf adds to its k best."""
    base2 = (points * points).sum(axis=1)
    for first in range(0, len(queries), width):
        q = queries[first : first + width]
        at = tree.project(q, query=True)
        gaps = np.maximum(0, (at * at).sum(axis=1)[:, None] + base2 - 2 * (at @ points.T))
        gaps[ids == own[first : first + width, None]] = np.nan  # a query does not meet itself
        q2 = (q * q).sum(axis=1)
        for i in range(len(q)):

            def limit(bound: float, i: int = i) -> float:
                return stop * max(0.0, q2[i] + tree.norm2 - 2 * bound) * (1 + 1e-9) + 1e-9 if np.isfinite(bound) else np.inf

            with np.errstate(invalid="ignore"):
                places, scores, n = walked(gaps[i], rows, q[i], float(known[first + i]), k, limit, step)
            top = best(scores, ids[places], k)
            yield first + i, places[top], scores[top], n


def reach(tree: Tree, q2: np.ndarray, known: np.ndarray, stop: float) -> np.ndarray:
    """The squared distance beyond which the test shuts out a cell, for queries of squared norms q2."""
    return stop * np.maximum(0, q2 + tree.norm2 - 2 * known) * (1 + 1e-9) + 1e-12


def search_group(tree: Tree, leaves: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, known: np.ndarray, home: np.ndarray, k: int, stop: float, width: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, places, scores, how many it verified): for each query its k best among the leaves of a group.

    `leaves` has the leaf of each row, `home` that of each query, which it walks first if it lies here. The k-th best
    so far goes from leaf to leaf.
    """
    points = tree.project(rows)
    parts = [(n, at, ids[at], rows[at], points[at]) for n in np.unique(leaves) for at in [np.flatnonzero(leaves == n)]]
    for first in range(0, len(queries), width):
        some = slice(first, first + width)
        q, bound, homes = queries[some], known[some].astype(float), home[some]
        at, q2, verified = tree.project(q, query=True), (q * q).sum(axis=1), np.zeros(len(q), np.int64)
        found = [(np.empty(0, np.int64), np.empty(0))] * len(q)
        for at_home in (True, False):
            for n, places, *leaf in parts:
                walks = homes == n if at_home else (homes != n) & (tree.gap2(at, n) <= reach(tree, q2, bound, stop))
                who = np.flatnonzero(walks)
                for j, met, scores, count in search_leaf(tree, *leaf, q[who], own[some][who], bound[who], k, stop, width):
                    i = who[j]
                    verified[i] += count
                    met, scores = np.concatenate([found[i][0], places[met]]), np.concatenate([found[i][1], scores])
                    top = best(scores, ids[met], k)
                    found[i] = met[top], scores[top]
                    if len(top) == k:
                        bound[i] = max(bound[i], scores[top[-1]])
        for i, answer in enumerate(found):
            yield first + i, *answer, int(verified[i])


def open_groups(tree: Tree, queries: np.ndarray, known: np.ndarray, home: np.ndarray, group: int, stop: float) -> list[np.ndarray]:
    """For each query the groups of `group` leaves each, but its home's, in which the test leaves a leaf open."""
    points = tree.project(queries, query=True)
    far = reach(tree, (queries * queries).sum(axis=1), known, stop)
    open_leaves = np.stack([tree.gap2(points, n) <= far for n in range(len(tree.low))], axis=1)
    of_groups = np.logical_or.reduceat(open_leaves, np.arange(0, len(tree.low), group), axis=1)
    of_groups[np.arange(len(queries)), home // group] = False
    return [np.flatnonzero(x).astype("int32") for x in of_groups]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, dims: int = 24, confidence: float = 0.85, leaf_rows: int = 2048, query_rows: int = 32_768, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: nearest other rows of each query by inner product, best first.

    Both tables have vec_id and embedding. Ties go to the smaller vec_id. Vectors that are null, empty,
    zero or hold null or non-finite parts take no part; a shorter vector counts as ending in zeros.
    """
    if dims % 2:
        raise ValueError("dims must be even")
    nonzero = F.exists("v", lambda c: c != 0)
    clean = stored(usable(vectors).filter(nonzero))
    asked = usable(queries).filter(nonzero).withColumnRenamed("vec_id", "query_id")
    shape = clean.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("norm2")).first()
    if not shape.n:
        return ranked(asked.sparkSession.createDataFrame([], SCHEMA), k)
    width, stop = shape.d, chi_square_quantile(confidence, dims)
    chosen = bounded_sample(clean, min(sample, SAMPLE_CELLS // width), F.col("vec_id")).select("v").collect()
    depth = max(0, min(math.ceil(math.log2(max(1, shape.n / leaf_rows))), int(math.log2(max(1, len(chosen) / 16)))))
    projection = np.random.default_rng(seed).normal(size=(width + 1, dims))
    tree = grow(matrix([r.v for r in chosen], width), projection, shape.norm2, depth)
    leaves = 1 << depth
    subs = max(1, -(-shape.n // (leaves * leaf_rows * 4)))
    group = max(1, min(leaves // GROUPS, GROUP_CELLS * leaves * subs // (shape.n * width)))
    nothing = F.lit(float("-inf"))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(leaf=tree.leaf(tree.project(matrix(f.v, width))).astype("int32") if len(f) else np.zeros(0, "int32"))

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(leaf=tree.leaf(tree.project(matrix(f.v, width), query=True)).astype("int32") if len(f) else np.zeros(0, "int32"))

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query, however many groups it opens: Spark deals it out."""
        for f in frames:
            for first in range(0, len(f), 1024):
                own = f.iloc[first : first + 1024]
                yield own.assign(groups=open_groups(tree, matrix(own.v, width), own.known.to_numpy(float), own.leaf.to_numpy(), group, stop))

    def searched(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(rows):
            ids, qids = rows.vec_id.to_numpy(), own.query_id.to_numpy()
            for i, at, scores, _ in search_group(tree, rows.leaf.to_numpy(), ids, matrix(rows.v, width), matrix(own.v, width), qids, own.known.to_numpy(float), own.leaf.to_numpy(), k, stop):
                out.append((np.full(len(at), qids[i]), ids[at], scores))  # a frame for each query would take far more memory than its rows
        return pd.DataFrame({c: np.concatenate([x[n] for x in out]) for n, c in enumerate(("query_id", "vec_id", "score"))}) if out else pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})

    data = first_copies(clean, k + 1).mapInPandas(placed, "vec_id long, v array<double>, leaf int")
    data = data.withColumn("sub", block_of(subs, "vec_id")).withColumn("group", F.floor(F.col("leaf") / group).cast("int"))
    at_home = stored(asked.mapInPandas(home, "query_id long, v array<double>, leaf int"))
    parts = max(1, -(-at_home.count() // max(1, min(query_rows, PART_CELLS // width))))

    def over(which: DataFrame) -> DataFrame:
        """A group of leaves goes to the parts of the queries that open it, and to no other."""
        dealt = which.withColumn("part", block_of(parts, "query_id"))
        met = data.join(dealt.groupBy("group").agg(F.collect_set("part").alias("_parts")), "group").withColumn("part", F.explode("_parts")).drop("_parts")
        keys = ["group", "sub", "part"]
        return dealt.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1)))).groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(searched, SCHEMA)

    in_home = over(at_home.withColumn("known", nothing).withColumn("group", F.floor(F.col("leaf") / group).cast("int")))
    first = stored(ranked(in_home, k))
    bound = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(nothing).alias("known"))
    rest = at_home.join(bound, "query_id", "left").select("query_id", "v", "leaf", F.coalesce("known", nothing).alias("known"))
    rest = stored(rest.mapInPandas(routed, "query_id long, v array<double>, leaf int, known double, groups array<int>"))
    elsewhere = over(rest.select("query_id", "v", "known", "leaf", F.explode("groups").alias("group")))
    return ranked(first.drop("rank").unionByName(elsewhere), k)


def op3_ann(spark, sf_dir: str) -> DataFrame:
    """Every twentieth vector's twenty nearest among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
