"""Cosine distances of two tables of vectors, block by block: Spark deals blocks of both sides, a task multiplies two of them.

A product of matrices in single precision finds which pairs can count; those few are measured again term by term in
double, so a distance does not depend on how the blocks fell and equal vectors are equally far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Numbers of one block, pairs of one product, and distances that a block's answer may hold.
BLOCK_NUMBERS, TILE_PAIRS, ANSWER_ROWS = 1_000_000, 4_000_000, 2_000_000
#: Numbers of one block whose answer is two rows a left row: larger blocks, as each side is sent once for every block of the other.
LEADING_NUMBERS = 2_000_000


def _vectors(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length; those that are null or hold a null are in none."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten()
    sizes = np.where(flat.is_null().to_numpy(zero_copy_only=False), -1, pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    good = sizes >= 0
    if values.null_count:
        holes = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False))
        good[np.searchsorted(starts + np.maximum(sizes, 0), holes, "right")] = False
    x = values.to_numpy(zero_copy_only=False).astype(float)
    for w in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == w))
        yield at, x[starts[at, None] + np.arange(w)]


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * x[:, k]
    return np.sqrt(out)


def _unit(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in single precision; those whose length is of an odd magnitude become nan, so that each is measured."""
    own = np.where((size > 1e-100) & (size < 1e100), size, np.nan)
    return (x / own[:, None]).astype(np.float32)


def _measured(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances, whether there is one) of rows i of a and j of b, summed in order as `vectors.cosine_distance` does."""
    out, some = np.empty(len(i)), np.empty(len(i), bool)
    for at in range(0, len(i), 65_536):
        own = slice(at, at + 65_536)
        p, q = a[i[own]], b[j[own]]
        dot = np.zeros(len(p))
        for k in range(a.shape[1]):
            dot += p[:, k] * q[:, k]
        size = na[i[own]] * nb[j[own]]
        some[own] = (size > 0) | np.isnan(size)
        out[own] = 1.0 - dot / size
    return out, some


def _tiles(left: pa.Table, right: pa.Table, order: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left places, right places, distances) of the pairs that `wanted` picks by near distances; right rows come in `order`.

    `wanted` is given the near distances and the right places of their columns. Pairs come by left place, then in order.
    """
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    others = {x.shape[1]: (at, x) for at, x in _vectors(right.column("_v"))}
    for at, x in _vectors(left.column("_v")):
        if x.shape[1] not in others:
            continue
        bt, y = others[x.shape[1]]
        by = np.argsort(rank[bt])
        bt, y = bt[by], y[by]
        with np.errstate(all="ignore"):
            na, nb = _norms(x), _norms(y)
            # a length of 0 has no distance, but to what is not finite
            keep, kept = (na != 0) | ~np.isfinite(nb).all(), (nb != 0) | ~np.isfinite(na).all()
            at, x, na, bt, y, nb = at[keep], x[keep], na[keep], bt[kept], y[kept], nb[kept]
            if not len(at) or not len(bt):
                continue
            u, v = _unit(x, na), np.ascontiguousarray(_unit(y, nb).T)
            step = max(1, TILE_PAIRS // len(bt))
            for first in range(0, len(at), step):
                near = u[first : first + step] @ v
                np.subtract(1, near, out=near)
                i, j = np.divmod(np.flatnonzero(wanted(near, bt)), len(bt))
                d, some = _measured(x, y, na, nb, i + first, j)
                yield at[i[some] + first], bt[j[some]], d[some]


def _slack(table: pa.Table) -> float:
    """How far two near distances together may be off: each by a rounding of 2**-24 for every term of a product and a few more."""
    longest = pc.max(pc.list_value_length(table.column("_v"))).as_py()
    return 2.0**-22 * (16 + (longest or 0))


def _coded(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's value, a place of each number's value); a struct's values are numbered by their parts."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_struct(flat.type):
        parts = np.stack([_coded(c)[0] for c in flat.flatten()], axis=1)
        _, first, own = np.unique(parts, axis=0, return_index=True, return_inverse=True)
        return own.reshape(-1), first
    own = flat.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    _, first, own = np.unique(own, return_index=True, return_inverse=True)
    return own.reshape(-1), first


def least(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    """Each left row with each candidate (`_c`) of the right rows: the least distance, null where there is none."""
    codes, some = _coded(right.column("_c"))
    n, slack, answer = len(some), _slack(right), np.full((left.num_rows, len(some)), np.nan)
    known = np.zeros(answer.shape, bool)

    def nearest(near: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = codes[at]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = np.fmin.reduceat(near, starts, axis=1)
        return ~(near > np.repeat(low, np.diff(np.r_[starts, len(own)]), axis=1) + slack)

    for i, j, d in _tiles(left, right, np.argsort(codes, kind="stable"), nearest):
        if len(d):
            place = i * n + codes[j]
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            answer.flat[place[starts]] = np.fmin.reduceat(d, starts)
            known.flat[place[starts]] = True
    rows, which = np.repeat(np.arange(left.num_rows), n), np.tile(some, left.num_rows)
    dist = pa.array(answer.reshape(-1), mask=~known.reshape(-1))
    return pa.Table.from_arrays([left.column("_a").take(rows), right.column("_c").take(which), dist], names=names)


def leading(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    """Each left row with the two candidates (`_c`) that come first by least distance, then by candidate; fewer where fewer have a distance.

    The first two over all blocks are among the first two of some block: of the candidates before the second of all,
    only the first of all can come before it in its block.
    """
    codes, some = _coded(right.column("_c"))
    place = np.empty(len(some), np.int64)
    place[pc.sort_indices(right.column("_c").take(some), null_placement="at_start").to_numpy()] = np.arange(len(some))
    codes, of, slack = place[codes], np.empty(len(some), np.int64), _slack(right)
    of[place] = some

    def nearest(near: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = codes[at]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = np.fmin.reduceat(near, starts, axis=1)
        most = low + np.float32(slack)
        if len(starts) > 2:
            most[low > np.partition(low, 1, axis=1)[:, 1:2] + np.float32(slack)] = -np.inf
        return ~(near > np.repeat(most, np.diff(np.r_[starts, len(own)]), axis=1))

    rows, which, dists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, j, d in _tiles(left, right, np.argsort(codes, kind="stable"), nearest):
        if not len(d):
            continue
        c = codes[j]
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (c[1:] != c[:-1])])
        i, c, d = i[starts], c[starts], np.fmin.reduceat(d, starts)
        by = np.lexsort((c, d, i))
        i, c, d = i[by], c[by], d[by]
        first = np.r_[True, True, i[2:] != i[:-2]][: len(i)]
        rows, which, dists = [*rows, i[first]], [*which, c[first]], [*dists, d[first]]
    own = left.column("_a").take(np.concatenate(rows)), right.column("_c").take(of[np.concatenate(which)])
    return pa.Table.from_arrays([*own, pa.array(np.concatenate(dists))], names=names)


def records(left: pa.Table, right: pa.Table, names: list[str], most: float) -> pa.Table:
    """The pairs nearer than `most` that no other right row of the same `_c` and a `_from` as early beats in both blocks given.

    Columns: all of both sides but the vectors, and the distance. Further pairs may come with them.
    """
    codes, _ = _coded(right.column("_c"))
    begin = right.column("_from").to_numpy()
    slack = _slack(right)

    def nearer(near: np.ndarray, at: np.ndarray) -> np.ndarray:
        own, out = codes[at], np.empty(near.shape, bool)
        edges = [*np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = near[:, a:b]
            out[:, a:b] = ~(part > np.fmin.accumulate(part, axis=1) + slack)
        return out & ~(near > most + slack)

    found = [(i, j, d) for i, j, d in _tiles(left, right, np.lexsort((begin, codes)), nearer)]
    i, j, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
    i, j, d = (x[d < most] for x in (i, j, d))
    own = [left.column(c).take(i) for c in left.column_names if c != "_v"] + [right.column(c).take(j) for c in right.column_names if c != "_v"]
    return pa.Table.from_arrays([*own, pa.array(d)], names=names)


def dealt(left: DataFrame, right: DataFrame, keys: list[str], kernel: Callable[[pa.Table, pa.Table, list[str]], pa.Table], answers: str | None = None, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """`kernel` over each block of `left` with each of `right` within equal `keys`; its columns are both sides' but keys and `_v`, and dist.

    A side's blocks hold about `numbers` numbers, and there are enough pairs of blocks to fill the tasks. `answers` names a
    right column when a left row has a distance for each of its values; blocks are the smaller then.
    """
    spark = left.sparkSession
    size = lambda df, *more: df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("_v")), F.lit(1)).alias("w"), *more).first()
    a, b = size(left), size(right, *([F.approx_count_distinct(answers).alias("k")] if answers else []))
    rows = max(1, numbers // max(a.w, b.w, 1))
    parts_b = max(1, -(-b.n // rows))
    least_rows = max(1, min(rows, ANSWER_ROWS // max(1, min(b.k, rows)))) if answers else rows
    tasks = 2 * spark.sparkContext.defaultParallelism
    parts_a = max(1, -(-a.n // least_rows), min(-(-a.n // 256), -(-tasks // parts_b)))
    named = lambda df: df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in df.columns if c not in keys)).filter(F.expr(" AND ".join(["true", *(f"_k{i} IS NOT NULL" for i in range(len(keys)))])))
    place = lambda n, *c: F.pmod(F.xxhash64(*c, F.lit(31)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    on, width = [*(f"_k{i}" for i in range(len(keys))), "_pa", "_pb"], min(2000, max(tasks, 4 * parts_a * parts_b))  # so that few tasks get two pairs of blocks
    own = named(left).withColumn("_pa", place(parts_a, *(c for c in left.columns if c not in keys))).withColumn("_pb", every(parts_b)).repartition(width, *on)
    other = named(right).withColumn("_pb", place(parts_b, *(c for c in right.columns if c not in keys))).withColumn("_pa", every(parts_a)).repartition(width, *on)
    fields = [f for df in (left, right) for f in df.schema.fields if f.name not in keys and f.name != "_v"]
    schema = StructType([*(StructField(f.name, f.dataType) for f in fields), StructField("dist", DoubleType())])
    names = [f.name for f in schema.fields]

    def met(p: pa.Table, q: pa.Table) -> pa.Table:
        p, q = p.drop_columns(on), q.drop_columns(on)
        if not p.num_rows or not q.num_rows:
            empty = [t.column(c).slice(0, 0) for t in (p, q) for c in t.column_names if c != "_v"]
            return pa.Table.from_arrays([*empty, pa.array([], pa.float64())], names=names)
        return kernel(p, q, names)

    return own.groupBy(*on).cogroup(other.groupBy(*on)).applyInArrow(met, schema)
