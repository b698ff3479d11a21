"""Queries against blocks of vectors: the parts that both vector searches share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, integers: int | None = None) -> DataFrame:
    """vec_id, v (array<double>; array<long> of floor(integers * x) if given) of vectors without null or non-finite parts.

    Rows without id go. An id names one vector: rows that repeat it are one, the smallest.
    """
    x = F.col("embedding").cast("array<double>")
    whole = F.size(x) > 0
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(integers))).cast("long")) if integers else x
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole & finite)
    return rows.groupBy("vec_id").agg(F.min(v).alias("v"))


def first_copies(vectors: DataFrame, k: int) -> DataFrame:
    """Rows that are among the k smallest ids of their vector.

    A later copy never enters a list of k - 1 neighbours: k - 1 others of the same score and a
    smaller id go first, whichever one is the query. Each task keeps k rows of a vector before
    the shuffle, so copies do not meet in one task.
    """
    by = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    return vectors.withColumn("_copy", F.row_number().over(by)).filter(F.col("_copy") <= k).drop("_copy")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query as (query_id, rank, vec_id, score)."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column, width: int, dtype=np.float64) -> np.ndarray:
    """Rows of an array column, zeros after a shorter one's end."""
    out = np.zeros((len(column), width), dtype)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def block_of(n: int, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit(97)), F.lit(n)).cast("int")
