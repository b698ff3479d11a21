"""Number plates as text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Groups of look-alike characters, and what an exchange within one costs.
LOOK_ALIKE = ("0OQD", "1IJLT", "2Z", "5S", "8B", "6G", "BE", "VY", "KX", "MN", "CG", "UV")
LOOK_ALIKE_COST, OTHER_COST = 0.4, 1.0
LEAST_PARTIAL = 6


def normalised(text: Column) -> Column:
    """Upper case, accents of the region folded, all but A-Z and 0-9 dropped."""
    folded = F.replace(F.translate(F.upper(text), "ČĆŽŠ", "CCZS"), F.lit("Đ"), F.lit("DJ"))
    return F.regexp_replace(folded, "[^A-Z0-9]", "")


@lru_cache(maxsize=1)
def _alike() -> tuple[str, str]:
    """Characters, and for each the least of those that a chain of look-alike groups leads to."""
    least: dict[str, str] = {c: c for group in LOOK_ALIKE for c in group}
    for _ in least:
        for group in LOOK_ALIKE:
            low = min(least[c] for c in group)
            least.update(dict.fromkeys(group, low))
    moved = sorted(c for c in least if least[c] != c)
    return "".join(moved), "".join(least[c] for c in moved)


def folded(text: Column) -> Column:
    """The text with look-alikes made equal: texts of a weighted distance below n are fewer than n edits apart then."""
    return F.translate(text, *_alike())


def shortened(text: Column, most: int) -> Column:
    """All distinct texts with up to `most` characters left out; two texts that many edits apart have one in common."""
    level = F.array(text)
    out = level
    for _ in range(most):
        less = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def parts(text: Column, low: int, high: int) -> Column:
    """All distinct parts of low to high characters; the whole text where it is shorter."""
    n = F.length(text)
    starts = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.when(n < low, F.array(text)).otherwise(F.array_distinct(F.flatten(F.array(*(starts(k) for k in range(max(low, 1), high + 1))))))


@lru_cache(maxsize=1)
def _costs() -> np.ndarray:
    cost = np.full((128, 128), OTHER_COST)
    for group in LOOK_ALIKE:
        for a in group:
            for b in group:
                cost[ord(a), ord(b)] = LOOK_ALIKE_COST
    np.fill_diagonal(cost, 0)
    return cost


def weighted_distance(a: str, b: str, partial: bool) -> float:
    """Edits between two normalised plates; `partial` lets a lie anywhere within b."""
    if not a or not b or (partial and len(a) < LEAST_PARTIAL):
        return float(max(len(a), len(b)))
    swap = _costs()[np.ix_([ord(c) for c in a], [ord(c) for c in b])]
    steps = np.arange(len(b) + 1.0)
    row = np.zeros(len(b) + 1) if partial else steps.copy()
    for i in range(len(a)):
        best = np.minimum(row[1:] + 1, row[:-1] + swap[i])
        # what comes from the left costs one a step: a running minimum of value minus place
        row = np.minimum.accumulate(np.concatenate([[row[0] + 1 if not partial else i + 1.0], best]) - steps) + steps
    return float(row.min() if partial else row[-1])


def weighted_distances(pairs: list[tuple[str, str]], partial: bool) -> np.ndarray:
    """weighted_distance of each pair; pairs of the same lengths are measured together."""
    out, alike = np.empty(len(pairs)), {}
    for i, (a, b) in enumerate(pairs):
        if not a or not b or (partial and len(a) < LEAST_PARTIAL):
            out[i] = max(len(a), len(b))
        else:
            alike.setdefault((len(a), len(b)), []).append(i)
    for (m, n), own in alike.items():
        left, right = (np.frombuffer("".join(pairs[i][k] for i in own).encode("ascii"), np.uint8).reshape(len(own), -1) for k in (0, 1))
        steps = np.arange(n + 1.0)
        row = np.tile(np.zeros(n + 1) if partial else steps, (len(own), 1))
        for i in range(m):
            best = np.minimum(row[:, 1:] + 1, row[:, :-1] + _costs()[left[:, i, None], right])
            first = np.full((len(own), 1), i + 1.0) if partial else row[:, :1] + 1
            row = np.minimum.accumulate(np.concatenate([first, best], axis=1) - steps, axis=1) + steps
        out[own] = row.min(axis=1) if partial else row[:, -1]
    return out


def distance(a: Column, b: Column, partial: bool = False) -> Column:
    """weighted_distance of two normalised text columns; null if one is null. Arrow batches; each distinct pair once."""

    @F.pandas_udf(DoubleType())
    def measured(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            pairs = list(zip(left, right, strict=True))
            places = {p: None for p in pairs if p[0] is not None and p[1] is not None}
            memo = dict(zip(places, weighted_distances(list(places), partial), strict=True))
            yield pd.Series([memo.get(p) for p in pairs], dtype="float64")

    return measured(a, b)
