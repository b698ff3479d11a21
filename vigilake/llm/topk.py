"""Exact top-k by inner product with sorted access alone (no random access) and bounds.

The vectors lie in blocks of bounded size, by the nearest of a few pivot vectors. In a block
every dimension is a list sorted by value, which a query reads step by step from its better
end, all lists at one depth. Of a vector it knows the sum of the parts it has read; with the
lists' present positions for the unread parts that is an upper bound, with their far ends a
lower bound. While the present positions alone add up to the k-th best score known, a vector
of which nothing was read could still qualify and reading goes on; after that the vectors
whose upper bound falls short are dropped, until few are left or the lists end, and the scores
of those are resolved. A block whose list heads cannot reach the known score is not read. The
block nearest to a query comes first and gives the score with which the others start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, block_of, first_copies, matrix, ranked, usable
from .common import bounded_sample, stored

SCHEMA = "query_id long, vec_id long, score long"
#: Pivots at most.
PIVOTS = 256


class SortedLists:
    """A block: rows x dims, and each dimension as a list from its lower end and one from its upper end."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.heads = ids, rows, np.stack([rows.min(axis=0), rows.max(axis=0)]).astype(float)
        self.lists: tuple | None = None
        self.masks: dict[int, np.ndarray] = {}
        self.multiplied = 0  # read parts and resolved rows, to be held against rows x dims a query

    def _opened(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, values, where each row stands) of both lists of every dimension, made when first read."""
        if self.lists is None:
            order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
            values = np.take_along_axis(self.rows.T, order, axis=1).astype(float)
            stand = np.empty_like(order)
            np.put_along_axis(stand, order, np.broadcast_to(np.arange(len(self.ids), dtype=np.int32), order.shape), axis=1)
            self.lists = (np.stack([order, order[:, ::-1]]).astype(np.int64), np.stack([values, values[:, ::-1]]), np.stack([stand, len(self.ids) - 1 - stand]))
        return self.lists

    def _unread(self, depth: int) -> np.ndarray:
        """rows x 2 dims: 1 where a row lies below `depth` in a dimension's upper list, then in its lower list."""
        if depth not in self.masks:
            stand = self._opened()[2]
            self.masks[depth] = (np.concatenate([stand[1], stand[0]]) >= depth).T.astype(float)
        return self.masks[depth]

    def search(self, queries: np.ndarray, own: np.ndarray, known: np.ndarray, k: int, steps: int = 16, width: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, places, scores) of the k best rows other than `own` that reach the score `known` of each query."""
        n, few, dim = len(self.ids), max(4 * k, 64), np.arange(self.rows.shape[1])
        step = -(-n // steps)
        for first in range(0, len(queries), width):
            asking = queries[first : first + width]
            q, at_least = asking.astype(float), known[first : first + width]
            side = (q > 0).astype(int)
            # sums of doubles are exact below 2**53; beyond, bounds give way by more than their rounding
            size = np.abs(q) @ np.abs(self.heads).max(axis=0)
            slack = np.where(size < 2**53, 0.0, size * len(dim) * 2.0**-50)
            able = (self.heads[side, dim] * q).sum(axis=1) >= at_least - slack
            live = (self.ids != own[first : first + width, None]) & able[:, None]
            active = np.flatnonzero(able) if n > few else np.empty(0, np.int64)
            seen = np.zeros((len(q), n)) if len(active) else None
            for at in range(0, n - step, step):
                if not len(active):
                    break
                places, values, _ = self._opened()
                end, up = at + step, side[active] == 1
                for i in active.tolist():
                    parts = values[side[i], dim, at:end] * q[i][:, None]
                    seen[i] += np.bincount(places[side[i], dim, at:end].ravel(), parts.ravel(), n)
                    self.multiplied += parts.size
                floor = at_least[active].copy()
                if (blind := np.flatnonzero(np.isneginf(floor))).size and n - 1 >= k:
                    # the k-th best lower bound stands in for a score not known yet
                    far = values[side[active[blind]], dim, -1] * q[active[blind]]
                    low = seen[active[blind]] + (self._unread(end) @ np.hstack([far * up[blind], far * ~up[blind]]).T).T
                    low[~live[active[blind]]] = -np.inf
                    floor[blind] = np.partition(low, n - k, axis=1)[:, n - k]
                floor -= slack[active]
                front = values[side[active], dim, end] * q[active]
                # while the present positions alone reach the score, one of which nothing was read could qualify
                if (ready := np.flatnonzero(front.sum(axis=1) < floor)).size:
                    who = active[ready]
                    high = seen[who] + (self._unread(end) @ np.hstack([front * up, front * ~up])[ready].T).T
                    live[who] &= high >= floor[ready, None]
                    active = np.setdiff1d(active, who[live[who].sum(axis=1) <= few])
            for i in np.flatnonzero(able).tolist():
                found = np.flatnonzero(live[i])
                scores = self.rows[found] @ asking[i]
                self.multiplied += self.rows[found].size
                found, scores = found[scores >= at_least[i]], scores[scores >= at_least[i]]
                top = best(scores, self.ids[found], k)
                yield first + i, found[top], scores[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, integers: int = 1024, block_rows: int = 32_768, query_rows: int = 32_768, list_rows: int = 4096, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with other rows.

    Both tables have vec_id and embedding; a component x counts as floor(integers * x). Ties go to the
    smaller vec_id, a query has fewer rows only if there are fewer candidates. An id names one vector:
    rows that repeat it are one, the smallest. Vectors that are null, empty or hold null or non-finite parts
    take no part; a shorter vector counts as ending in zeros. Scores must fit a long.
    """
    clean, asked = stored(usable(vectors, integers)), usable(queries, integers)
    shape = clean.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n_queries, width = asked.count(), shape.d or 1
    if not shape.n or not n_queries:
        return ranked(asked.sparkSession.createDataFrame([], SCHEMA), k)
    # a block has many lists' rows, so that few copies of queries and rows travel; small tables get more blocks
    block_rows = min(block_rows, max(shape.n // 64, 2048))
    chosen = bounded_sample(clean, PIVOTS, F.col("vec_id")).select("v").collect() if shape.n > block_rows else []
    pivots = matrix([r.v for r in chosen], width) if chosen else np.zeros((1, width))
    parts = max(1, -(-n_queries // query_rows))

    def celled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(cell=(matrix(f.v, width) @ pivots.T).argmax(axis=1).astype("int32") if len(f) else np.zeros(0, "int32"))

    data = first_copies(clean, k + 1).mapInPandas(celled, "vec_id long, v array<long>, cell int")
    asked = asked.withColumnRenamed("vec_id", "query_id").mapInPandas(celled, "query_id long, v array<long>, cell int").withColumn("part", block_of(parts, "query_id"))
    # cells of more rows than a block are cut; of a cell at most PIVOTS numbers come here
    sizes = {r.cell: r.n for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    cuts = {c: -(-n // block_rows) for c, n in sizes.items()}
    names = [(c, i) for c in sorted(cuts) for i in range(cuts[c])]
    first_of, number = {}, {}
    for at, (c, i) in enumerate(names):
        first_of.setdefault(c, at)
        number[c] = cuts[c]
    base = F.create_map(*(F.lit(x) for c in first_of for x in (c, first_of[c])))
    count = F.create_map(*(F.lit(x) for c in number for x in (c, number[c])))

    def placed(df: DataFrame, key: str) -> DataFrame:
        cell = F.when(F.map_contains_key(base, F.col("cell")), F.col("cell")).otherwise(F.lit(min(first_of)))
        return df.withColumn("cell", cell).withColumn("block", (base[F.col("cell")] + F.pmod(F.xxhash64(key, F.lit(97)), count[F.col("cell")])).cast("int")).drop("cell")

    data = placed(data, "vec_id")
    asked = placed(asked, "query_id").withColumnRenamed("block", "home")

    def searched(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(rows):
            asking, qids, known = matrix(own.v, width, np.int64), own.query_id.to_numpy(), own.known.to_numpy(float)
            ids, x = rows.vec_id.to_numpy(), matrix(rows.v, width, np.int64)
            for a in range(0, len(ids), list_rows):
                lists = SortedLists(ids[a : a + list_rows], x[a : a + list_rows])
                for i, at, scores in lists.search(asking, qids, known, k):
                    if len(at):
                        out.append(pd.DataFrame({"query_id": qids[i], "vec_id": lists.ids[at], "score": scores}))
                    if len(at) == k:
                        known[i] = max(known[i], float(scores[-1]))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    def over(which: DataFrame) -> DataFrame:
        """`which` has query_id, v, known, part, block; a block goes to the parts that ask it."""
        met = data.join(which.groupBy("block").agg(F.collect_set("part").alias("_parts")), "block").withColumn("part", F.explode("_parts")).drop("_parts")
        return which.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInPandas(searched, SCHEMA)

    nothing = F.lit(float("-inf"))
    first = over(asked.withColumn("block", F.col("home")).withColumn("known", nothing))
    bound = ranked(first, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(nothing).alias("known"))
    rest = (
        asked.join(bound, "query_id", "left")
        .withColumn("known", F.coalesce("known", nothing))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
        .filter(F.col("block") != F.col("home"))
    )
    return ranked(first.unionByName(over(rest)), k)


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """Every hundredth vector's ten best among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP8_SQL = """
WITH clean AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""
