"""Ranked lexical search, term at a time with limited accumulators.

Two passes over the documents. The first cuts every text into terms and keeps, for the terms
that the items ask for, how often each document holds them; counts over all documents come
from it. The second takes these rows as they lie, a block at a time: a block's postings are
sorted by term, and each item reads the lists of its terms, rarest first. As long as the
terms to come could lift a new document to the k-th best partial score, unseen documents get
an accumulator; from then on only documents that have one are updated, exactly. A block gives
its k best per item, and the bests of the blocks are merged in two steps. Items go through in
batches, so that what a task knows of them is bounded however many there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stored

#: Distinct terms of a batch of items, and postings of a block, at most (an item or a document alone may have more).
BATCH_TERMS, BLOCK_POSTINGS = 200_000, 4_000_000
#: Bytes that end a term become blanks, A-Z lower case; bytes from 128 on belong to letters outside ASCII.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of letters, digits and characters outside ASCII, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(TERM_BYTES).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def item_batches(items: DataFrame, most: int = BATCH_TERMS) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, its terms with counts), as many at a time as hold `most` terms; items without terms are left out."""
    batch, size = [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        found = Counter(terms(text))
        if not found:
            continue
        if batch and size + len(found) > most:
            yield batch
            batch, size = [], 0
        batch.append((item_id, found))
        size += len(found)
    if batch:
        yield batch


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in `vocabulary`, ascending), tfs of every row that has a term."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = terms(text)
                if found:
                    held = Counter(map(number, found))
                    del held[None]
                    at = sorted(held)
                    for to, x in zip(out, (doc, len(found), at, [held[t] for t in at]), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "n", "terms", "tfs"])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, n long, terms array<int>, tfs array<int>")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


class Block:
    """Postings of some documents by term: `gains` is what one mention in an item adds, before the term's weight."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, total: int, words: int, size: int):
        self.ids = ids
        m = 75 + (25 * n * total) // max(1, words)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        tf = tfs.astype(np.int64)
        gains = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.docs, self.gains = doc[order], gains[order]
        self.upto = np.searchsorted(terms[order], np.arange(size + 1))
        held = np.flatnonzero(np.diff(self.upto))
        self.tops = np.zeros(size, np.int64)
        if len(held):
            self.tops[held] = np.maximum.reduceat(self.gains, self.upto[held])

    def search(self, item: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of the k best, best first, and how many accumulators were made; `item` has (term, factor), rarest first."""
        bounds = np.cumsum([f * self.tops[t] for t, f in item][::-1])[::-1]
        score, seen, creating = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        for (t, f), rest in zip(item, bounds, strict=True):
            docs, gains = self.docs[self.upto[t] : self.upto[t + 1]], self.gains[self.upto[t] : self.upto[t + 1]]
            if not len(docs):
                continue
            if creating and (have := np.count_nonzero(seen)) >= k:
                held = score[seen]
                creating = rest >= np.partition(held, have - k)[have - k]
            if creating:
                seen[docs] = True
            else:
                alive = seen[docs]
                docs, gains = docs[alive], gains[alive]
            score[docs] += f * gains
        at = np.flatnonzero(seen & (score > 0))
        keep = at[_best(score[at], self.ids[at], k)]
        return keep, score[keep], int(np.count_nonzero(seen))


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_postings: int = BLOCK_POSTINGS, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of `docs` for each row of `items`.

    Every row of `docs` is a document of its own, also where rows share a doc_id; one without an id ranks
    behind equal scores that have one. Rows of `items` that share an item_id or lack one are searched
    as one item of their joined terms each. Null and empty texts have no terms: such documents
    do not count, such items return nothing. Other columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    merged = items.groupBy("item_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text"))
    found = [_searched(docs, batch, k, block_postings) for batch in item_batches(merged, batch_terms)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _searched(docs: DataFrame, batch: list[tuple[int | None, Counter]], k: int, block_postings: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(found for _, found in batch))))}
    rows = stored(postings(docs, vocabulary))
    total, words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # as many as the batch has terms
    weights = {i: weight(total, df[i]) for i in df}
    plans = []
    for item_id, found in batch:
        numbers = sorted(((vocabulary[t], c) for t, c in found.items() if vocabulary[t] in df), key=lambda x: (df[x[0]], x[0]))
        plans.append((item_id, [(i, c * weights[i]) for i, c in numbers]))
    shared = spark.sparkContext.broadcast((plans, total, words, len(vocabulary)))

    def bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, total, words, size = shared.value
        held, count = [], 0

        def searched() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, lists = t.column("doc_id").combine_chunks(), t.column("terms").combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = np.where(known, ids.fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).max)
            block = Block(
                numbers, t.column("n").to_numpy(), lists.flatten().to_numpy(), t.column("tfs").combine_chunks().flatten().to_numpy(), lists.value_lengths().to_numpy(), total, words, size
            )
            out: list[list] = [[], [], []]
            for item_id, item in plans:
                at, scores, _ = block.search(item, k)
                out[0] += [item_id] * len(at)
                out[1] += [int(numbers[x]) if known[x] else None for x in at]
                out[2] += scores.tolist()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item_id", "doc_id", "score"])

        for b in batches:
            held.append(b)
            count += len(b.column("terms").flatten())
            if count >= block_postings:
                yield searched()
                held, count = [], 0
        if held:
            yield searched()

    found = rows.mapInArrow(bests, "item_id long, doc_id long, score long")

    def best(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # first over 64 shares of the blocks, so that one item's candidates do not meet in one task at once
    shares = best(found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64))), "item_id", "share")
    return best(shares.drop("rank", "share"), "item_id").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = """
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
held AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM held GROUP BY r),
totals AS (SELECT count(*) AS total, sum(n)::BIGINT AS words FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM held GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM dfs, totals),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (r), totals
  GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
