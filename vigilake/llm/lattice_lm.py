"""Language-model scores by the lattice of all segmentations into pieces of a fixed vocabulary.

The pieces are an existing vocabulary's. Their weights start from its scores and are
re-estimated on the corpus: the expected number of uses of each piece over all segmentations
of every training word, weighted by the word's count. A text's probability is the product
over its words of the sum over all segmentations, computed in log space by the forward
recursion. Pieces never cross white space, so a distinct word is computed once.

Words of a part of the documents are counted together; each word meets the corpus counts by
a join, its scores travel back to the parts as numbers, and the texts are summed there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, shuffle_partitions, spread, stored, texts_of, vocabulary

MIX = np.uint64(0x9E3779B97F4A7C15)
SIEVE_BITS = 20
#: Cells of a lattice that are in memory at once.
CELLS = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


@dataclass
class Pieces:
    """A vocabulary laid out for lookups of many substrings at once."""

    keys: np.ndarray  # sorted hashes of the pieces' characters
    index: np.ndarray  # the piece of each key
    sieve: np.ndarray
    longest: int
    bytes_at: np.ndarray  # the piece of each fallback byte, -1 without
    start_logp: np.ndarray

    @classmethod
    def of(cls, names: list[str], scores: list[float], byte_names: dict[str, int]) -> Pieces:
        """Scores that are minus the rank, as those of a merge vocabulary, become the logarithms of a Zipf law."""
        plain = [i for i, n in enumerate(names) if n and n not in byte_names]
        hashes = np.array([int(_hash_name(names[i])) for i in plain], np.uint64)
        order = np.argsort(hashes)
        keys, index = hashes[order], np.array(plain, np.int64)[order]
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        at = np.full(256, -1, np.int64)
        for n, b in byte_names.items():
            at[b] = names.index(n)
        rank = -np.minimum(np.array(scores, float), 0)
        p = 1 / (rank + 10)
        return cls(keys, index, sieve, max(len(names[i]) for i in plain), at, np.log(p / p.sum()))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for none."""
        out = np.full(h.shape, -1, np.int64)
        hit = np.nonzero(self.sieve[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        own = h[hit]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out[hit] = np.where(self.keys[at] == own, self.index[at], -1)
        return out


def _hash_name(name: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in name:
        h = _extend(h, np.array([ord(c)], np.uint64))
    return h[0]


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = (h ^ (c + np.uint64(0x51ED27))) * MIX
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = ["" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i) for i in range(n)]
    return Pieces.of(names, [model.get_score(i) for i in range(n)], {names[i]: int(names[i][3:5], 16) for i in range(n) if model.is_byte(i)})


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe


def _marked(word: bytes) -> str:
    return "▁" + word.decode("utf-8", "replace")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Lattice:
    """All segmentations of words; `logp` weights the pieces."""

    def __init__(self, pieces: Pieces, logp: np.ndarray):
        self.pieces, self.logp = pieces, logp

    def _cells(self, codes: np.ndarray):
        """piece and score of the cells (length - 1, start, word); codes: words x characters."""
        n, size = codes.shape
        longest = min(self.pieces.longest, size)
        piece = np.full((longest, size, n), -1, np.int64)
        h = np.zeros((size, n), np.uint64)
        by_char = codes.T.astype(np.uint64)
        for k in range(longest):
            h = _extend(h[: size - k], by_char[k:])
            piece[k, : size - k] = self.pieces.find(h)
        score = np.where(piece >= 0, self.logp[piece], -np.inf)
        strange: list[tuple[list[int], np.ndarray]] = []
        for c in np.unique(codes.T[piece[0] < 0]):
            parts = [int(self.pieces.bytes_at[b]) for b in chr(c).encode("utf-8", "surrogatepass")]
            where = codes.T == c
            score[0][where] = sum(self.logp[p] if p >= 0 else self.logp.min() for p in parts)
            strange.append((parts, where))
        return piece, score, strange

    def _forward(self, score: np.ndarray) -> np.ndarray:
        longest, size, n = score.shape
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            m = min(longest, j)
            alpha[j] = _logsum(np.stack([alpha[j - k - 1] + score[k, j - k - 1] for k in range(m)]))
        return alpha

    def _long(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Place and character codes of the words whose cells would not fit; `_chunks` leaves them out."""
        for i, w in enumerate(words):
            if len(w) * self.pieces.longest >= CELLS // 2 and len(text := _marked(w)) * self.pieces.longest > CELLS:
                yield i, _codes(text)

    def _chunks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and character codes of words of equal length, after the mark that begins a word."""
        texts = [_marked(w) for w in words]
        lengths = np.array([len(t) for t in texts], np.int64)
        for size in np.unique(lengths[lengths * self.pieces.longest <= CELLS]):
            at = np.flatnonzero(lengths == size)
            width = max(1, CELLS // int(size * min(size, self.pieces.longest)))
            for a in range(0, len(at), width):
                part = at[a : a + width]
                codes = _codes("".join(texts[i] for i in part))
                yield part, codes.reshape(len(part), size)

    def _windows(self, codes: np.ndarray) -> range:
        """Where the windows of one very long word begin."""
        return range(0, len(codes), max(self.pieces.longest, CELLS // self.pieces.longest))

    def _window(self, codes: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray, list]:
        """piece, score (length - 1, start) and strange of the starts in the window from `a` on."""
        z = min(len(codes), a + self._windows(codes).step)
        piece, score, strange = self._cells(codes[None, a : min(len(codes), z + self.pieces.longest - 1)])
        return piece[:, : z - a, 0], score[:, : z - a, 0], [(parts, where[: z - a, 0]) for parts, where in strange]

    def _long_forward(self, codes: np.ndarray) -> np.ndarray:
        alpha = np.full(len(codes) + 1, -np.inf)
        alpha[0] = 0
        for a in self._windows(codes):
            _, score, _ = self._window(codes, a)
            for i in range(score.shape[1]):
                to = alpha[a + i + 1 : a + i + 1 + len(score)]
                np.logaddexp(to, alpha[a + i] + score[: len(to), i], out=to)
        return alpha

    def _long_expected(self, codes: np.ndarray, count: float) -> np.ndarray:
        size, out = len(codes), np.zeros(len(self.logp))
        alpha, beta = self._long_forward(codes), np.full(len(codes) + 1, -np.inf)
        beta[size] = 0
        for a in reversed(self._windows(codes)):
            piece, score, strange = self._window(codes, a)
            for i in range(score.shape[1] - 1, -1, -1):
                own = beta[a + i + 1 : a + i + 1 + len(score)]
                beta[a + i] = np.logaddexp.reduce(score[: len(own), i] + own)
            for k in range(len(score)):
                n = min(score.shape[1], size - a - k)
                p = np.exp(alpha[a : a + n] + score[k, :n] + beta[a + k + 1 : a + k + 1 + n] - alpha[-1]) * count
                own = piece[k, :n]
                out += np.bincount(own[own >= 0], p[own >= 0], len(out))
                if k == 0:
                    for parts, where in strange:
                        for b in parts:
                            if b >= 0:
                                out[b] += p[where[:n]].sum()
        return out

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's probability, summed over all segmentations."""
        out = np.zeros(len(words))
        for i, codes in self._long(words):
            out[i] = self._long_forward(codes)[-1]
        for at, codes in self._chunks(words):
            out[at] = self._forward(self._cells(codes)[1])[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in these words."""
        out = np.zeros(len(self.logp))
        for i, codes in self._long(words):
            out += self._long_expected(codes, counts[i])
        for at, codes in self._chunks(words):
            piece, score, strange = self._cells(codes)
            longest, size, n = score.shape
            alpha = self._forward(score)
            beta = np.full((size + 1, n), -np.inf)
            beta[size] = 0
            for i in range(size - 1, -1, -1):
                m = min(longest, size - i)
                beta[i] = _logsum(np.stack([score[k, i] + beta[i + k + 1] for k in range(m)]))
            weight = counts[at]
            for k in range(longest):
                p = np.exp(alpha[: size - k] + score[k, : size - k] + beta[k + 1 :] - alpha[-1]) * weight
                own = piece[k, : size - k]
                out += np.bincount(own[own >= 0], p[own >= 0], len(out))
                if k == 0:
                    for parts, where in strange:
                        for b in parts:
                            if b >= 0:
                                out[b] += p[where].sum()
        return out


@dataclass
class Model:
    """Corpus counts and piece weights: the table of words with their counts, totals and logp."""

    counts: DataFrame  # word binary, c long: words of training documents
    tokens: int
    types: int
    ends: int
    logp: np.ndarray
    path: str


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """word (binary), c: how often each word occurs. Tasks count a bounded number of words at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return got

        for b in batches:
            for t in texts_of(b):
                held.update(words_of(t))
                if len(held) >= most:
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def fit(docs: DataFrame, path: str | None = None, rounds: int = 2, smoothing: float = 0.1) -> Model:
    """Counts and weights of all rows of `docs`; a null text is empty, an empty corpus keeps the vocabulary's scores."""
    path = path or vocabulary("piece_bpe_32k.model")
    counts = stored(word_counts(docs))
    ends = docs.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    logp = pieces_of(path).start_logp
    for _ in range(rounds if total.n else 0):
        now = logp

        def gathered(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(pieces_of(path), now), np.zeros(len(now))
            for b in batches:
                sums += lattice.expected(b.column("word").to_pylist(), b.column("c").to_numpy())
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], ["piece", "uses"])

        uses = np.full(len(now), smoothing)
        for r in spread(counts).mapInArrow(gathered, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # at most the vocabulary
            uses[r.piece] += r.uses
        logp = np.log(uses / uses.sum())
    return Model(counts, int(total.n) + ends, int(total.v) + (ends > 0), ends, logp, path)


def score(docs: DataFrame, model: Model, part_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row of `docs`.

    base_score smooths the words' counts by one; score is the lattice model's. Both count one end a text;
    a null or empty text is its end alone. Repeated rows give a row each.
    """
    size = docs.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    parts = max(1, -(-size // part_bytes), min(shuffle_partitions(docs.sparkSession), -(-size // 1_000_000)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    path, logp, ends, tokens, types = model.path, model.logp, model.ends, model.tokens, model.types

    def distinct(frame: pd.DataFrame) -> pd.DataFrame:
        words = sorted(set().union(*map(words_of, frame.text)))
        return pd.DataFrame({"part": frame.part.iloc[0] if len(frame) else 0, "place": np.arange(len(words), dtype=np.int32), "word": words})

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by word, so that a batch computes each of its words once."""
        lattice = Lattice(pieces_of(path), logp)
        for b in batches:
            words = b.column("word").to_pylist()
            order = {w: i for i, w in enumerate(dict.fromkeys(words))}
            p = lattice.log_probability(list(order))
            own = p[[order[w] for w in words]] if words else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("place"), b.column("c"), pa.array(own)], ["part", "place", "c", "logp"])

    end_share = ends / tokens if tokens else 0.5
    goes_on = np.log10(max(1 - end_share, 1e-12))
    stops, every = np.log10(max(end_share, 1e-12)), np.log10(tokens + types + 1)

    def summed(frame: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        split = [words_of(t) for t in frame.text]
        c, lattice = np.zeros(len(values), np.int64), np.zeros(len(values))
        c[values.place.to_numpy()] = values.c
        lattice[values.place.to_numpy()] = values.logp / np.log(10)
        place = {w: i for i, w in enumerate(sorted(set().union(*split)))} if split else {}
        sizes = [len(s) for s in split]
        at = np.fromiter((place[w] for s in split for w in s), np.int64, sum(sizes))
        owner = np.repeat(np.arange(len(split)), sizes)
        over = lambda v: np.bincount(owner, v[at], len(split))
        n = np.array(sizes, np.int64)
        return pd.DataFrame(
            {
                "doc_id": frame.doc_id,
                "n_tokens": n + 1,
                "n_known": over((c > 0).astype(float)).astype(np.int64) + (ends > 0),
                "train_tokens": tokens,
                "base_score": over(np.log10(c + 1.0)) + np.log10(ends + 1.0) - (n + 1) * every,
                "score": over(lattice) + n * goes_on + stops,
            }
        )

    words = rows.groupBy("part").applyInPandas(distinct, "part int, place int, word binary")
    met = words.join(model.counts, "word", "left").select("part", "place", "word", F.coalesce("c", F.lit(0)).alias("c"))
    values = met.mapInArrow(weighed, "part int, place int, c long, logp double")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("part").cogroup(values.groupBy("part")).applyInPandas(summed, schema)


def op7_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """Score all documents by a model of six folds of seven."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out(F.col("doc_id"), 7, 2)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
