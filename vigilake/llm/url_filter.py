"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models of characters, one of accepted and one of rejected URLs,
mix all context lengths up to `order`: each longer context adds its own counts to a
Dirichlet prior that is the shorter context's distribution. Counts live in tables of fixed
size by hash. A URL is rejected when the difference of the models' log-likelihoods, divided
by its length, falls below a threshold calibrated on labelled URLs that neither model saw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import shuffle_partitions, stored

#: URLs counted at once, and buckets of a step of 1 in the score.
COUNTED_ROWS, STEPS = 2048, 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Markov:
    """Counts of contexts (order by hash) and of contexts with their next byte."""

    order: int
    bits: int
    strength: float
    context: np.ndarray
    following: np.ndarray

    @classmethod
    def fit(cls, urls: list[bytes], order: int = 5, bits: int = 17, strength: float = 4.0) -> Markov:
        own = cls(order, bits, strength, np.zeros((order + 1, 1 << bits), np.float32), np.zeros((order + 1, 1 << bits), np.float32))
        for k, c, f in own._cells(*_joined(urls, order))[0]:
            own.context[k] += np.bincount(c, minlength=1 << bits)
            own.following[k] += np.bincount(f, minlength=1 << bits)
        return own

    def _cells(self, text: np.ndarray, scored: np.ndarray):
        """For each order the cells of every scored byte's context and of context plus byte."""
        shift, at = np.uint64(64 - self.bits), np.flatnonzero(scored)
        out, h = [], np.zeros(len(at), np.uint64)
        for k in range(self.order + 1):
            if k:
                h = (h ^ (text[at - k].astype(np.uint64) + np.uint64(k * 257))) * MIX
            g = (h ^ (text[at].astype(np.uint64) + np.uint64(7919))) * MIX
            g ^= g >> np.uint64(29)
            out.append((k, ((h * MIX) >> shift).astype(np.int64), ((g * MIX) >> shift).astype(np.int64)))
        return out, at

    def log_likelihood(self, urls: list[bytes]) -> np.ndarray:
        text, scored = _joined(urls, self.order)
        cells, at = self._cells(text, scored)
        p = np.full(len(at), 1 / 256)
        for k, c, f in cells:
            p = (self.following[k][f] + self.strength * p) / (self.context[k][c] + self.strength)
        owner = np.repeat(np.arange(len(urls)), [len(u) + 1 for u in urls])
        return np.bincount(owner, np.log(p), len(urls))


def _joined(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All URLs, each after `order` zero bytes and before one that is scored as its end."""
    text = np.frombuffer(b"".join(b"\0" * order + u + b"\0" for u in urls), np.uint8)
    lengths = np.array([len(u) for u in urls], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + order + 1)])[:-1]
    scored = np.zeros(len(text) + 1, np.int32)
    np.add.at(scored, starts + order, 1)
    np.add.at(scored, starts + order + lengths + 1, -1)
    return text, np.cumsum(scored[:-1]) > 0


@dataclass
class RatioFilter:
    accepted: Markov
    rejected: Markov
    threshold: float

    def score(self, urls: list[bytes]) -> np.ndarray:
        if not urls:
            return np.zeros(0)
        lengths = np.array([len(u) + 1 for u in urls])
        return (self.accepted.log_likelihood(urls) - self.rejected.log_likelihood(urls)) / lengths


def fit(labelled: DataFrame, order: int = 5, bits: int = 17) -> RatioFilter | None:
    """Models of the distinct `url`s with `accepted` true and false; None when one kind is missing.

    All URLs are used: four fifths of them, by hash, are counted by the tasks into the models' tables, whose size is fixed;
    the threshold is calibrated on the others, or on the same where a kind has none left over.
    """
    known = labelled.select("url", "accepted").filter(F.col("url").isNotNull() & F.col("accepted").isNotNull()).groupBy("url").agg(F.min("accepted").alias("accepted"))
    spark = known.sparkSession
    parts = max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism)
    rows = stored(known.withColumn("held", held_url(F.col("url"))).repartition(parts, "url"))
    n = {(r.accepted, r.held): r["count"] for r in rows.groupBy("accepted", "held").count().collect()}
    if len({kind for kind, _ in n}) < 2:
        return None
    used = lambda held: F.when(F.col("accepted"), (F.col("held") == held) | F.lit((True, held) not in n)).otherwise((F.col("held") == held) | F.lit((False, held) not in n))
    counts = _counted(rows.filter(used(False)), order, bits)
    out = RatioFilter(*(Markov(order, bits, 4.0, *counts[kind]) for kind in (1, 0)), 0.0)
    scored = rows.filter(used(True)).select(ratios(out)("url").alias("score"), "accepted")
    out.threshold = best_cut(scored)
    return out


def held_url(url: Column) -> Column:
    """True for the fifth of all URLs that no model counts."""
    return F.pmod(F.xxhash64(url, F.lit(20_011)), F.lit(5)) == 0


def _counted(rows: DataFrame, order: int, bits: int) -> np.ndarray:
    """Counts by kind (1: accepted), table (contexts, contexts with their next byte), order and cell, summed over all rows of `rows`."""
    shape = (2, 2, order + 1, 1 << bits)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = np.zeros(shape, np.int64), Markov(order, bits, 0.0, np.zeros(0), np.zeros(0))
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(at, COUNTED_ROWS)
                kinds = part.column("accepted").to_numpy(zero_copy_only=False)
                for kind in (0, 1):
                    urls = [u.encode() for u in part.column("url").filter(pa.array(kinds == kind)).to_pylist()]
                    for k, *cells in sizes._cells(*_joined(urls, order))[0] if urls else ():
                        for table, c in enumerate(cells):
                            own[kind, table, k] += np.bincount(c, minlength=1 << bits)
        flat = own.reshape(-1)
        some = np.flatnonzero(flat)
        for at in range(0, len(some), 100_000):
            cell = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell])], names=["cell", "n"])

    got = rows.select("url", "accepted").mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(shape)
    out.reshape(-1)[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def best_cut(scored: DataFrame) -> float:
    """The cut of `score` at which the shares of accepted rows below and of rejected rows not below it are least in sum.

    Exact over all rows: of the cuts between two neighbouring scores that do equally well, the one in the widest gap. Scores
    are ordered within narrow buckets; only the buckets' totals come to the driver, as many as scores have steps of 1 / STEPS.
    """
    cells = stored(scored.groupBy("score").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).withColumn("bucket", F.floor(F.col("score") * STEPS)))
    totals = sorted(cells.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).collect(), key=lambda r: r.bucket)
    good, bad, last, before = 0, 0, None, []
    for r in totals:
        before.append((r.bucket, good, bad, last))
        good, bad, last = good + r.good, bad + r.bad, r.last
    met = cells.join(F.broadcast(scored.sparkSession.createDataFrame(before, "bucket long, _good long, _bad long, _last double")), "bucket")
    by = Window.partitionBy("bucket").orderBy("score")
    below = lambda c: (F.col(f"_{c}") + F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(18,0)")
    wrong = below("good") * F.lit(bad).cast("decimal(18,0)") - below("bad") * F.lit(good).cast("decimal(18,0)")
    cuts = met.select("score", wrong.alias("wrong"), F.coalesce(F.lag("score").over(by), F.col("_last")).alias("prev"))
    middle = (F.col("score") + F.col("prev")) / 2
    cut = F.when(F.col("prev").isNull(), F.col("score") - 1e-9).when(middle > F.col("prev"), middle).otherwise(F.col("score"))
    gap = F.coalesce(F.col("score") - F.col("prev"), F.lit(0.0))
    return cuts.agg(F.max_by(cut, F.struct(-F.col("wrong"), gap, -F.col("score")))).first()[0]


def ratios(model: RatioFilter) -> Callable[..., Column]:
    """The model's scores of a column of URLs; a null one counts as empty."""

    @F.pandas_udf(DoubleType())
    def ratio(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in urls:
            yield pd.Series(model.score([(u or "").encode() for u in part]), dtype="float64")

    return ratio


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for a null url or one without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, action) of the longest rule (action, host/path) that fits, else null; ties go to the smaller rule.

    A list of bounded length: it becomes part of the plan.
    """
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of `pages`.

    `labelled` (url, accepted) trains the models; without it, the URLs that the rules decide do.
    A null url counts as empty. Where the models cannot be trained, the method allows all. Rows that repeat, or
    share a page_id or url, each get their own row; a url of any length is judged whole.
    """
    host, path = host_and_path(F.col("url"))
    ruled = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = ruled.withColumn("_found", matching_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = ruled.filter(F.col("_found").isNotNull()).select("url", (F.col("_found.action") == "allow").alias("accepted"))
    model = fit(labelled)
    score, threshold = (F.lit(0.0), 0.0) if model is None else (ratios(model)("url"), model.threshold)
    return ruled.withColumn("score", score).select(
        "page_id",
        "host",
        "path",
        F.col("_found.rule").alias("rule"),
        F.coalesce(F.col("_found.action"), F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        "score",
    )


#: Fixed by the contract of the query.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judge every page's url by the rules, else by the models."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
