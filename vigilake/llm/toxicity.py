"""Toxicity by multiple-instance learning: sentence scores, trained from document labels alone.

A document is a bag of sentences. A logistic model scores each sentence from its words and
their beginnings; noisy-or combines the scores, so that one offending sentence suffices:
P(document) = 1 - prod(1 - p(sentence)). Training maximises the likelihood of the document
labels; the same sentence scores then locate what offends.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, kept, spread, stored, texts_of

#: Labelled documents of each kind that training reads at most, in expectation.
SAMPLE = 3000
#: Features that a task counts before it hands the counts on.
COUNTED = 200_000
#: Beginnings of words that count as features besides the words, and the least length of a word that has them.
STARTS = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = ".,;:!?()[]{}\"'|#*&%$-_«»“”…"
MEMO_WORDS = 200_000


def features(word: str) -> list[str]:
    w = word.strip(EDGES).lower()
    return [f"={w}", *(f"^{w[:k]}" for k in STARTS if len(w) >= k)] if w else []


@dataclass
class SentenceModel:
    weights: dict[str, float]
    bias: float
    #: Odds of the noisy-or probability that count as even; scores are shifted by them.
    odds: float = 1.0

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            weight = self.weights.get
            got = self.memo[w] = sum(weight(f, 0.0) for f in features(w))
        return got

    def document(self, text: str, located: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or score, and the sentences (start, end, score) that reach `located`."""
        if not text:
            return 0.0, []
        word, quiet = self.word, _softplus(self.bias)
        if not any(map(word, _words(text))):  # every sentence has the bias alone
            n = sum(1 for _ in SENTENCE.finditer(text))
            return self.shifted(1 - float(np.exp(-n * quiet))), []
        total, found = 0.0, []
        for m in SENTENCE.finditer(text):
            x = self.bias + sum(map(word, m.group().split()))
            total += _softplus(x)
            if (p := self.shifted(1 / (1 + float(np.exp(-x))))) >= located:
                found.append((m.start(), m.end(), p))
        return self.shifted(1 - float(np.exp(-total))), found

    def shifted(self, p: float) -> float:
        return p / (p + (1 - p) * self.odds)

    def __reduce__(self):
        return SentenceModel, (self.weights, self.bias, self.odds)


def _features_of(text: str) -> set[str]:
    return {f for w in _words(text) for f in features(w)}


def _words(text: str) -> set[str]:
    """The words of all sentences: the marks of SENTENCE part words too, and a line break does anyway."""
    return set(text.replace(".", " ").replace("!", " ").replace("?", " ").split())


def _telling(texts: list[str], least: int, bits: int = 22) -> dict[str, int]:
    """Features that so many of the texts have; a table of counts by hash spares memory for the rare ones."""
    rough, mask = np.zeros(1 << bits, np.int32), (1 << bits) - 1
    for t in texts:
        rough[list({hash(f) & mask for f in _features_of(t)})] += 1
    out: Counter[str] = Counter()
    for t in texts:
        out.update(f for f in _features_of(t) if rough[hash(f) & mask] >= least)
    return {f: n for f, n in out.items() if n >= least}


def _softplus(x: float) -> float:
    return float(np.logaddexp(0.0, x))


def train(texts: list[str], toxic: list[int], weights: list[float] | None = None, rounds: int = 300, rate: float = 0.1, decay: float = 2e-5, least: int = 4) -> SentenceModel:
    """Fit to documents and their labels; `weights` restore the shares of a sample drawn by label.

    Features are those in at least `least` toxic documents whose toxic share is well above the average.
    """
    y = np.array(toxic, float)
    share = np.ones(len(y)) if weights is None else np.array(weights, float)
    base = max(float((y * share).sum() / max(share.sum(), 1e-9)), 1e-6)
    scale = float(share[y > 0].mean()) if (y > 0).any() else 1.0
    kept = _telling([t for t, label in zip(texts, toxic, strict=True) if label], least)
    every = dict.fromkeys(kept, 0.0)
    for t, k in zip(texts, share.tolist(), strict=True):
        for f in _features_of(t).intersection(every):
            every[f] += k
    kept = sorted(f for f, n in kept.items() if n * scale / every[f] >= _least_share(base))
    index = {f: i for i, f in enumerate(kept)}
    return _learn(kept, [_bag(t, index) for t in texts], y, share, rounds, rate, decay)


def _least_share(base: float) -> float:
    return min(0.9, max(3 * base, 0.3))


def _bag(text: str, index: dict[str, int]) -> tuple[list[list[int]], int]:
    """The known features of each sentence that has some, and the number of the others."""
    found, quiet = [], 0
    for m in SENTENCE.finditer(text):
        hits = [index[f] for w in m.group().split() for f in features(w) if f in index]
        if hits:
            found.append(hits)
        else:
            quiet += 1
    return found, quiet


def _learn(kept: list[str], bags: list[tuple[list[list[int]], int]], y: np.ndarray, share: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 2e-5) -> SentenceModel:
    sent, feat, owner, quiet = array("l"), array("l"), array("l"), np.zeros(len(bags))
    for d, (found, n) in enumerate(bags):
        quiet[d] = n
        for hits in found:
            sent.extend([len(owner)] * len(hits))
            feat.extend(hits)
            owner.append(d)
    sent, feat, owner = (np.array(x, np.int64) for x in (sent, feat, owner))
    w, b = np.zeros(len(kept)), -6.0
    m, v, total = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), max(share.sum(), 1e-9)
    for i in range(1, rounds + 1):
        x = b + np.bincount(sent, w[feat], len(owner)) if len(owner) else np.zeros(0)
        mass = np.bincount(owner, np.logaddexp(0, x), len(bags)) + quiet * np.logaddexp(0, b)
        # d(-log likelihood)/d(mass): 1 for clean documents, -1 / (exp(mass) - 1) for toxic ones
        pull = share * np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(mass, 50)), 1e-6), 1.0)
        g = pull[owner] / (1 + np.exp(-x))
        grad = np.append(np.bincount(feat, g[sent], len(kept)) if len(owner) else np.zeros(len(kept)), g.sum() + (pull * quiet).sum() / (1 + np.exp(-b))) / total
        grad[:-1] += decay * w
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = w - step[:-1], float(np.clip(b - step[-1], -14, 2))
    return SentenceModel({f: float(x) for f, x in zip(kept, w, strict=True) if abs(x) > 1e-3}, b)


def even_odds(kept: list[str], bags: list[tuple[list[list[int]], int]], y: np.ndarray, share: np.ndarray, folds: int = 5) -> float:
    """Odds of the document probability at which F1 is best, each document scored by a model of the other folds; 1 without toxic ones."""
    if not (y > 0).any() or len(y) < 2 * folds:
        return 1.0
    p = np.zeros(len(y))
    for r in range(folds):
        own = np.arange(len(y)) % folds == r
        model = _learn(kept, [b for b, x in zip(bags, own, strict=True) if not x], y[~own], share[~own])
        w = np.array([model.weights.get(f, 0.0) for f in kept])
        for i in np.flatnonzero(own):
            found, quiet = bags[i]
            p[i] = 1 - np.exp(-quiet * _softplus(model.bias) - sum(_softplus(model.bias + w[hits].sum()) for hits in found))
    by = np.argsort(-p, kind="stable")
    hit, false = np.cumsum((y * share)[by]), np.cumsum(((1 - y) * share)[by])
    last = np.append(p[by][1:] != p[by][:-1], True)  # equal scores pass together
    f1 = np.where(last, 2 * hit / (hit + false + (y * share).sum()), -1.0)
    cut = float(np.clip(p[by][int(f1.argmax())], 1e-3, 1 - 1e-3))
    return cut / (1 - cut)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 4) -> SentenceModel:
    """A model of the documents with a label; several labels of a document count as toxic if one is.

    About `sample` documents of each kind at most are read; without any toxic one all scores are near 0. Their texts
    stay in the tasks: the driver gets the telling features and, of each document, its sentences with some.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen, sizes = [], {}
    for kind in (0, 1):
        rows = known.filter(F.col("_toxic") == kind)
        sizes[kind] = rows.count()
        chosen.append(bounded_sample(rows, sample, F.col("doc_id")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(texts.join(chosen[0].unionByName(chosen[1]), "doc_id").select("text", "_toxic"))
    n = {r._toxic: r.n for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: sizes[t] / max(1, n.get(t, 0)) for t in (0, 1)}
    mass = {t: share[t] * n.get(t, 0) for t in (0, 1)}
    base = max(mass[1] / max(mass[0] + mass[1], 1e-9), 1e-6)
    kept = sorted(r.feature for r in _counted(rows).filter((F.col("n1") >= least) & (F.col("n1") * share[1] / (F.col("n1") * share[1] + F.col("n0") * share[0]) >= _least_share(base))).select("feature").collect())
    index = {f: i for i, f in enumerate(kept)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, quiet = zip(*(_bag(t, index) for t in texts_of(b)), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("_toxic"), pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(quiet, pa.int64())], ["_toxic", "found", "quiet"])

    kind = rows.schema["_toxic"].dataType.simpleString()
    got = sorted((r._toxic, r.quiet, r.found) for r in rows.mapInArrow(bags, f"_toxic {kind}, found array<array<int>>, quiet bigint").collect())
    found, y, shares = [(found, quiet) for _, quiet, found in got], np.array([t for t, *_ in got], float), np.array([share[t] for t, *_ in got], float)
    model = _learn(kept, found, y, shares)
    model.odds = even_odds(kept, found, y, shares)
    return model


def _counted(rows: DataFrame) -> DataFrame:
    """feature, n0, n1: the clean and the toxic texts that have it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()

        def flushed() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)], ["feature", "n0", "n1"])
            for c in seen:
                c.clear()
            return out

        for b in batches:
            for t, label in zip(texts_of(b), b.column("_toxic").to_pylist(), strict=True):
                seen[1 if label else 0].update(_features_of(t))
                if len(seen[0]) + len(seen[1]) >= COUNTED:
                    yield flushed()
        yield flushed()

    return rows.mapInArrow(counted, "feature string, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def score(docs: DataFrame, model: SentenceModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of every row of `docs`, score, and offending: the sentences (start, end, score), characters from 0.

    A null or empty text scores 0. Repeated rows give a row each. A column asked for by the name of an output is an error.
    """
    names = list(columns)
    if clash := {"score", "offending"}.intersection(names):
        raise ValueError(f"{sorted(clash)} are names of outputs; rename them first")
    rows = spread(docs.select(*names, "text"))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, found = [], []
            for t in texts_of(b):
                p, own = model.document(t)
                scores.append(min(1.0, max(0.0, p)))
                found.append([{"start": a, "end": z, "score": q} for a, z, q in own])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(scores, pa.float64()), pa.array(found, spans)], [*names, "score", "offending"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.mapInArrow(scored, f"{schema}, score double, offending array<struct<start:int,end:int,score:double>>")


def training_rows(doc_id: Column) -> Column:
    return ~held_out(doc_id, 5, 0)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score every document; labels are learned from four folds of five."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(training_rows(F.col("doc_id")))
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
        "offending",
    )


def keep_clean(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows of `docs` that score below `most`; labels of four folds of five teach. A null text stays."""
    model = fit(docs, labels.filter(training_rows(F.col("doc_id"))))

    def keep(texts: list[str | None]) -> list[bool]:
        return [model.document(t or "")[0] < most for t in texts]

    return kept(docs, keep)
