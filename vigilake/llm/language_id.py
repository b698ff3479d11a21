"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time; both directions label every byte
position, and a document's probabilities are the mean over its positions. Texts are read
in windows of bytes, each from a zero state, so memory is bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below_share, held_out, kept, spread, texts_of

WINDOW = 256
#: Labelled documents that training reads at most, in expectation, and windows that it takes from each.
SAMPLE_DOCS, WINDOWS_EACH, TRAIN_WINDOW = 6000, 2, 96


@dataclass
class Network:
    """Per direction: embed (256 x 2H, biases included) and recur (2H x H) of the update gate z and the candidate n.

    A unit without reset gate: n = tanh(.), h = z * h + (1 - z) * n. Both gates are kept as
    logistic functions of the negated input: z itself, and n = 1 - 2 * s(doubled input).
    The output layer is out (C x 2H) and bias.
    """

    labels: list[str]
    embed: list[np.ndarray]
    recur: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def random(cls, labels: list[str], hidden: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        return cls(
            labels,
            [draw(256, 2 * hidden, scale=0.3) for _ in range(2)],
            [draw(2 * hidden, hidden, scale=hidden**-0.5) for _ in range(2)],
            draw(len(labels), 2 * hidden, scale=0.3),
            np.zeros(len(labels), np.float32),
        )

    def states(self, codes: np.ndarray, way: int, keep: bool = False):
        """Yields (t, h) for byte codes (T x W), h (H x W) being reused; with `keep`, also what training needs."""
        steps, width = codes.shape
        embed, recur = self.embed[way], self.recur[way]
        hidden = recur.shape[1]
        h = np.zeros((hidden, width), np.float32)
        rows = np.empty((width, 2 * hidden), np.float32)
        gates = np.empty((2 * hidden, width), np.float32)
        z, n = gates[:hidden], gates[hidden:]
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(embed, codes[t], axis=0, out=rows, mode="clip")
            np.matmul(recur, h, out=gates)
            np.add(gates, rows.T, out=gates)
            with np.errstate(over="ignore"):  # an infinite sum is a closed gate
                np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            n *= -2
            n += 1
            before = (h.copy(), z.copy(), n.copy()) if keep else None
            np.subtract(h, n, out=h)
            h *= z
            h += n
            yield (t, h, before) if keep else (t, h)

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Label probabilities (T x C x W) of every position."""
        hidden = self.recur[0].shape[1]
        logits = np.empty((codes.shape[0], len(self.labels), codes.shape[1]), np.float32)
        for t, h in self.states(codes, 0):
            np.matmul(self.out[:, :hidden], h, out=logits[t])
        add = np.empty(logits.shape[1:], np.float32)
        for t, h in self.states(codes, 1):
            p = logits[t]
            np.matmul(self.out[:, hidden:], h, out=add)
            add += self.bias[:, None]
            p += add
            np.exp(p, out=p)
            p /= p.sum(axis=0)
        return logits

    def pooled(self, texts: list[bytes], width: int = 1024) -> np.ndarray:
        """Mean position probabilities of each text; zeros for an empty one."""
        owner, pieces = [], []
        for i, x in enumerate(texts):
            for a in range(0, len(x), WINDOW):
                owner.append(i)
                pieces.append(x[a : a + WINDOW])
        total = np.zeros((len(texts), len(self.labels)))
        order = sorted(range(len(pieces)), key=lambda j: len(pieces[j]))
        for a in range(0, len(order), width):
            part = order[a : a + width]
            lengths = np.array([len(pieces[j]) for j in part])
            steps = int(lengths[-1])
            flat = np.frombuffer(b"".join(pieces[j].ljust(steps, b" ") for j in part), np.uint8)
            p = self.positions(flat.reshape(len(part), steps).T.astype(np.intp, order="C"))
            if lengths[0] < steps:
                p *= (np.arange(steps)[:, None] < lengths)[:, None, :]
            np.add.at(total, [owner[j] for j in part], p.sum(axis=0).T)
        return total / np.maximum([[len(x)] for x in texts], 1)

    def step(self, codes: np.ndarray, target: np.ndarray, grads: dict) -> float:
        """Gradients of the mean cross-entropy over all positions, by backpropagation through time."""
        steps, width = codes.shape
        hidden = self.recur[0].shape[1]
        both = np.empty((steps, 2 * hidden, width), np.float32)
        kept: list[list] = [[], []]
        for way in (0, 1):
            for t, h, before in self.states(codes, way, keep=True):
                both[t, way * hidden : (way + 1) * hidden] = h
                kept[way].append((t, *before))
        logits = np.matmul(self.out, both) + self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        loss = -float(np.log(p[:, target, np.arange(width)] + 1e-9).mean())
        p[:, target, np.arange(width)] -= 1
        p /= steps * width
        grads["out"] = np.einsum("tcw,thw->ch", p, both, optimize=True)
        grads["bias"] = p.sum(axis=(0, 2))
        upper = np.matmul(self.out.T, p)
        for way in (0, 1):
            recur, part = self.recur[way], upper[:, way * hidden : (way + 1) * hidden]
            g_recur, inner_all = np.zeros_like(recur), np.empty((steps, width, 2 * hidden), np.float32)
            down = np.zeros((hidden, width), np.float32)
            for t, h, z, n in reversed(kept[way]):
                down += part[t]
                # of the inputs x: z = s(-x), so z' = -z (1 - z); n = 1 - 2 s(-x), so n' = (1 - n^2) / 2
                inner = np.concatenate([down * (n - h) * z * (1 - z), down * (1 - z) * (1 - n * n) / 2])
                g_recur += inner @ h.T
                inner_all[t] = inner.T
                down = down * z + recur.T @ inner
            flat, g_embed = codes.ravel(), np.empty_like(self.embed[way])
            for j in range(2 * hidden):
                g_embed[:, j] = np.bincount(flat, inner_all[:, :, j].ravel(), 256)
            grads[f"embed{way}"], grads[f"recur{way}"] = g_embed, g_recur
        return loss

    def parameters(self) -> dict[str, np.ndarray]:
        return {"out": self.out, "bias": self.bias} | {f"{n}{w}": getattr(self, n)[w] for n in ("embed", "recur") for w in (0, 1)}


def train(windows: list[tuple[bytes, str]], hidden: int = 8, epochs: int = 4, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network for byte windows of equal length with their labels; None without any."""
    if not windows:
        return None
    labels = sorted({x[1] for x in windows})
    net = Network.random(labels, hidden, seed)
    if len(labels) == 1:
        return net
    length = max(len(x[0]) for x in windows)
    codes = np.frombuffer(b"".join(x[0].ljust(length, b" ") for x in windows), np.uint8).reshape(len(windows), length).T
    target = np.array([labels.index(x[1]) for x in windows])
    rng = np.random.default_rng(seed)
    # each label as often as the largest, up to its own windows eight times
    counts = np.bincount(target, minlength=len(labels))
    pick = np.concatenate([np.resize(rng.permutation(np.flatnonzero(target == c)), min(counts.max(), 8 * counts[c])) for c in range(len(labels))])
    first = {k: np.zeros_like(v) for k, v in net.parameters().items()}
    second = {k: np.zeros_like(v) for k, v in net.parameters().items()}
    rounds, i = max(1, -(-len(pick) // batch)), 0
    for epoch in range(max(epochs, -(-150 // rounds))):
        pick = rng.permutation(pick)
        for a in range(0, len(pick), batch):
            part, grads = pick[a : a + batch], {}
            net.step(codes[:, part].astype(np.intp), target[part], grads)
            i += 1
            scale = rate * (0.2 if epoch >= epochs - 1 else 1.0)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, v in net.parameters().items():
                g = grads[k] / max(1.0, norm)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                v -= scale * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-6)
    return net


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, **options) -> Network | None:
    """A network from `text` and non-null `lang`; windows lie at places that a text's length chooses.

    About `sample_docs` different texts are read at most, in equal shares of the labels where they have so many. None
    without a usable row; a label of which the sample has nothing is an error.
    """
    rows = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    counts = {r.lang: r.texts for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()}
    if not counts:
        return None
    chosen = reduce(Column.__or__, ((F.col("lang") == lang) & below_share(sample_docs / len(counts) / n, "text") for lang, n in sorted(counts.items())))
    rows = rows.filter(chosen)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, langs = [], []
            for text, lang in zip(texts_of(b), b.column("lang").to_pylist(), strict=True):
                x = text.encode()
                rng = np.random.default_rng(len(x))
                room = max(1, len(x) - TRAIN_WINDOW)
                for _ in range(WINDOWS_EACH if len(x) > TRAIN_WINDOW else 1):
                    a = int(rng.integers(room))
                    got.append(x[a : a + TRAIN_WINDOW])
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(langs, pa.string())], ["bytes", "lang"])

    found = sorted((bytes(r.bytes), r.lang) for r in rows.mapInArrow(windows, "bytes binary, lang string").distinct().collect())
    if missed := counts.keys() - {lang for _, lang in found}:
        raise ValueError(f"no sampled text of {sorted(missed)}; raise sample_docs")
    return train(found, **options)


def identify(docs: DataFrame, net: Network | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of every row of `docs`, lang_pred and score.

    A text that is null or has no letter, or any text where no label was learned: und, score 0.
    Repeated rows give a row each. A column asked for by the name of an output is an error.
    """
    names = list(columns)
    if clash := {"lang_pred", "score"}.intersection(names):
        raise ValueError(f"{sorted(clash)} are names of outputs; rename them first")
    usable = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    rows = spread(docs.select(*names, usable.alias("text")))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = _predict(net, [t.encode() for t in texts_of(b)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.mapInArrow(predicted, f"{schema}, lang_pred string, score double")


def _predict(net: Network | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    full = [i for i, t in enumerate(texts) if t] if net is not None else []
    for a, z in _portions([len(texts[i]) for i in full]):
        part = full[a:z]
        for i, row in zip(part, net.pooled([texts[i] for i in part]), strict=True):
            best = int(row.argmax())
            langs[i], scores[i] = net.labels[best], float(min(1.0, max(0.0, row[best])))
    return langs, scores


def _portions(sizes: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents of two folds of three."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.filter(~held_out(F.col("doc_id"), 3, 1)))
    return identify(docs, net).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows of `docs` whose text is, with a probability of `least`, in a language that their own labels teach.

    A null text and one without a letter go; where no label is learned, nothing else does.
    """
    net = fit(docs.filter(~held_out(F.col("doc_id"), 3, 1)))

    def keep(texts: list[str | None]) -> list[bool]:
        letters = [t if t and any(map(str.isalpha, t)) else "" for t in texts]
        if net is None:
            return [bool(t) for t in letters]
        return [lang != "und" and p >= least for lang, p in zip(*_predict(net, [t.encode() for t in letters]), strict=True)]

    return kept(docs, keep)
