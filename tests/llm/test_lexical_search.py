from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from vigilake.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    total, words = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in found:
            m = 100 - 25 + (25 * sum(c.values()) * total) // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if s > 0:
                scores.append((-s, math.inf if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "naïve", "日本"]
    share = 1 / np.arange(1, len(words) + 1)
    return [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 40)), p=share / share.sum()))) for i in range(n)]


@pytest.mark.parametrize(("block", "batch"), [(4_000_000, 200_000), (60, 5)])
def test_equals_the_plain_ranking(spark, block, batch):
    """Ties, copies, nulls, a very long text, terms that no document holds, and a clashing extra column; blocks and batches of any size."""
    docs = corpus(400, 5) + [(1000 + i, "w1 w2, w3-W1") for i in range(30)] + [(7, "w5 w5"), (None, "w1 w2, w3-W1"), (3000, None), (3001, " ;,. "), (3002, "w9 W50 " * 5000)]
    items = [(1, "w1 W2 w3 w1"), (2, "w40 w41 w59 w1 w0"), (3, "none here"), (4, None), (5, "über ÜBER naïve 日本 w5"), (6, "w0")]
    frame = spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, score double").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in lexical_search.search(frame, asked, 20, block, batch).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute(docs, items, 20)


def test_accumulators_stop_and_results_stay():
    """Rare terms fill the list; documents that hold the common one alone get no accumulator."""
    n = 5000
    ids, length = np.arange(n), np.full(n, 10)
    rare = np.arange(50)
    lengths = np.ones(n, np.int64)
    lengths[rare] = 2
    terms = np.concatenate([[0, 1] if i < 50 else [1] for i in range(n)]).astype(np.int32)
    block = lexical_search.Block(ids, length, terms, np.ones(len(terms), np.int32), lengths, n, 10 * n, 2)
    item = [(0, lexical_search.weight(n, 50)), (1, lexical_search.weight(n, 4900))]
    at, scores, made = block.search(item, 20)
    assert made == 50 and at.tolist() == list(range(20)) and len(set(scores.tolist())) == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).collect() == []
