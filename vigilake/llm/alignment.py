"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection.

Each text is encoded by both tokenizers. The byte offsets where tokens end are two ascending
lists; every end of the shorter one is looked up in the longer by doubling steps away from a
guess until the end lies between two of them, and by binary search there. Ends found in both
cut the tokens into groups. The ranks found for a token's two ends give, by their difference,
the range of tokens of the other side whose bytes it overlaps.

A task writes for each document its digests and its distinct linked id pairs. How many documents
hold a pair is one aggregation over these; as there may be many pairs, they are looked up in
slices by A id, each small enough to broadcast, and the sums of the slices add up.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored, texts_of, vocabulary

#: Words kept in a worker's memory of segmentations; it starts anew when full.
MEMO_WORDS = 400_000
#: Bytes of text that are encoded and aligned at once; a longer text goes alone.
PART_BYTES = 2 << 20
#: White space beside a space, or at a text's end: what it joins depends on both sides.
ODD_SPACE = re.compile(r"\s | \s|^\s|\s\Z")
#: Pairs of a slice that is broadcast, about; some 40 bytes each in an executor.
SLICE_PAIRS = 4_000_000
SPACE = "▁"
ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level BPE file of the tokenizers library; special tokens' strings are plain text.

    Where ids are in the order of merges, they are the ranks by which the same tokens are merged
    faster; otherwise the library itself encodes.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, chars = {t["content"] for t in spec["added_tokens"]}, byte_chars()
        self.bytes = [b""] * (1 + max(spec["model"]["vocab"].values()))
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = token.encode() if token in special else bytes(chars[c] for c in token)
        ranks = {b: i for i, b in enumerate(self.bytes) if b and b.decode(errors="replace") not in special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"] and not spec["model"].get("ignore_merges")
        self.by_word = plain and merged == sorted(merged) and len(ranks) == len(merged) + 256
        if self.by_word:
            self.encode = tiktoken.Encoding("a-" + hashlib.md5(path.encode()).hexdigest(), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            slow = Tokenizer.from_file(path)
            slow.encode_special_tokens = True
            self.encode = lambda text: slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a sentencepiece BPE model; None for a text whose pieces do not spell it.

    No piece of the vocabulary has a space after another character, so no merge crosses into the next
    word: `by_word`.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names)
        self.by_word = not crossing and self.model.encode("a\tb c") == self.model.encode("a\tb") + self.model.encode("c")

    def __call__(self, texts: list[str]) -> list[list[int] | None]:
        known = self.bytes.__getitem__
        return [ids if b"".join(map(known, ids)) == b" " + t.encode() else None for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]


class Both:
    """Ids of texts by both tokenizers, as packed 32-bit numbers.

    Both start anew at a single space between characters that are none, so the words of a text without
    other neighbours of spaces come from memory; new ones of a batch are encoded together.
    """

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        return [None if ids is None else (array("I", self.a.encode(" " + t)).tobytes(), array("I", ids).tobytes()) for t, ids in zip(texts, self.b(texts), strict=True)]

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """(ids of A, ids of B) of each text; None for those without tokens."""
        split = [t.split(" ") if t and self.b.by_word and self.a.by_word and not ODD_SPACE.search(t) else None for t in texts]
        words = set().union(*(s for s in split if s))
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        self.memo.update(zip(new, self._encoded(new), strict=True))
        known = self.memo.__getitem__
        out: list[tuple[bytes, bytes] | None] = []
        for t, s in zip(texts, split, strict=True):
            found = [known(w) for w in s] if s else self._encoded([t]) if t else [None]
            out.append(None if None in found else (b"".join([x for x, _ in found]), b"".join([x for _, x in found])))
        return out


@lru_cache(maxsize=2)
def _tokenizers(a: str, b: str):
    both = Both(a, b)
    names = np.array([f"{i}{c}".encode() for side, ends in ((both.a, ",|"), (both.b, ",;")) for c in ends for i in range(len(side.bytes))], dtype=object)
    return both, *(np.array([len(x) for x in side.bytes]) for side in (both.a, both.b)), names


def gallop(short: np.ndarray, long: np.ndarray, stride: int = 16) -> np.ndarray:
    """Of each value of `short`, how many values of `long` are smaller; both ascend strictly.

    Values move in step. Every `stride`-th one goes first; the others start from where they would lie if
    `long` were even between two of those. Each steps 1, 2, 4 ... towards its place until that lies
    between two steps, then halves what is between.
    """
    n, m = len(long), len(short)
    if not n or not m:
        return np.zeros(m, np.int64)
    if m > 4 * stride:
        anchors = np.arange(0, m, stride)
        at = np.interp(short, short[anchors], gallop(short[anchors], long, stride)).astype(np.int64)
    else:
        at = (short - short[0]) * n // (1 + int(max(long[-1], short[-1]) - short[0]))
    at = np.clip(at, 0, n - 1)
    right = long[at] < short
    lanes, v, base, sign, step = np.arange(m), short, at, np.where(right, 1, -1), 1
    near, low, high = at, np.empty(m, np.int64), np.empty(m, np.int64)
    while len(lanes):
        probe = base + sign * step
        inside = (probe >= 0) & (probe < n)
        go_on = inside & ((long[np.clip(probe, 0, n - 1)] < v) == (sign > 0))
        stop = ~go_on
        forward = sign[stop] > 0
        place_low = np.where(forward, near[stop] + 1, np.where(inside[stop], probe[stop] + 1, 0))
        place_high = np.where(forward, np.where(inside[stop], probe[stop], n), near[stop])
        low[lanes[stop]], high[lanes[stop]] = place_low, place_high
        lanes, v, base, sign, near = lanes[go_on], v[go_on], base[go_on], sign[go_on], probe[go_on]
        step *= 2
    lanes = np.flatnonzero(low < high)
    while len(lanes):
        lo, hi = low[lanes], high[lanes]
        mid = (lo + hi) // 2
        smaller = long[mid] < short[lanes]
        low[lanes], high[lanes] = np.where(smaller, mid + 1, lo), np.where(smaller, hi, mid)
        lanes = lanes[low[lanes] < high[lanes]]
    return low


def links(short_ends: np.ndarray, long_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, shared): of each token of the shorter list the first overlapping token of the longer and their number, and whether its end is common."""
    rank = gallop(short_ends, long_ends)
    shared = long_ends[rank] == short_ends
    first = np.zeros(len(rank), np.int64)
    first[1:] = rank[:-1] + shared[:-1]  # a token that ends with the one before belongs to it alone
    return first, rank - first + 1, shared


def aligned(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends of groups in a, in b, linked a tokens, linked b tokens) as indices, for ids that spell the same bytes."""
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    a_short = len(a) <= len(b)
    first, count, shared = links(ends_a, ends_b) if a_short else links(ends_b, ends_a)
    own = np.repeat(np.arange(len(first)), count)
    other = np.arange(len(own)) - np.repeat(np.cumsum(count) - count - first, count)
    cut_own = np.flatnonzero(shared)
    cut_other = (first + count - 1)[cut_own]
    return (cut_own, cut_other, own, other) if a_short else (cut_other, cut_own, other, own)


def group_codes(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Places, in the names of _tokenizers, that spell `a1,a2|b1;a3|b2,b3;`: each group's ids of both sides, in order."""
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    code_a, code_b = a.copy(), b + 2 * n_a
    code_a[cut_a] += n_a
    code_b[cut_b] += n_b
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(cut_b + 1 - size_b, size_a)] = code_a
    out[np.arange(len(b)) + np.repeat(cut_a + 1, size_b)] = code_b
    return out


def documents(packed: list[tuple[bytes, bytes]], len_a: np.ndarray, len_b: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, pairs, times) of each document, all aligned at once as one stream: they end together in both lists."""
    a, b = (np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in zip(*packed, strict=True))
    upto_a, upto_b = (np.cumsum([0] + [len(x) // 4 for x in side]) for side in zip(*packed, strict=True))
    cut_a, cut_b, at_a, at_b = aligned(a, b, len_a, len_b)
    codes = group_codes(a, b, cut_a, cut_b, len(len_a), len(len_b))
    groups, ends = np.searchsorted(cut_a, upto_a), np.searchsorted(at_a, upto_a)
    doc = np.repeat(np.arange(len(packed)), np.diff(ends))
    keys, times = np.unique((doc * len(len_a) + a[at_a]) * len(len_b) + b[at_b], return_counts=True)
    doc, pair = np.divmod(keys, len(len_a) * len(len_b))
    first, second = np.divmod(pair, len(len_b))
    pairs, upto = (first << 32) | second, np.searchsorted(doc, np.arange(len(packed) + 1))
    for i in range(len(packed)):
        spelt = b"".join(names[codes[upto_a[i] + upto_b[i] : upto_a[i + 1] + upto_b[i + 1]]].tolist())[:-1]
        own = slice(upto[i], upto[i + 1])
        yield (int(upto_a[i + 1] - upto_a[i]), int(upto_b[i + 1] - upto_b[i]), int(groups[i + 1] - groups[i]), int(ends[i + 1] - ends[i]), spelt, pairs[own], times[own].astype(np.int32))


def parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in stretches of at most `most` bytes of text; a longer text is one of its own."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        spent = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, spent + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def linked(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every row of `docs`.

    `pairs` has the distinct linked id pairs, A id * 2^32 + B id, ascending; `times` how many links each has.
    """
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, len_a, len_b, names = _tokenizers(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in parts(batch, PART_BYTES):
                ids = both(texts_of(part))
                held = [i for i, packed in enumerate(ids) if packed is not None]
                done = dict(zip(held, documents([ids[i] for i in held], len_a, len_b, names), strict=True)) if held else {}
                out: list[list] = [[] for _ in range(9)]
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    n_a, n_b, n_groups, n_links, spelt, pairs, times = done.get(i, (0, 0, 0, 0, None, [], []))
                    one = (row, doc, n_a, n_b, n_groups, n_links, "" if spelt is None else hashlib.sha256(spelt).hexdigest(), pairs, times)
                    row += 1
                    for to, x in zip(out, one, strict=True):
                        to.append(x)
                kinds = (pa.int64(),) * 6 + (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], [c.split()[0] for c in ROW.split(", ")])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, ROW)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`.

    n_best counts links whose pair is held by as many documents as any pair of its A id; count_sum adds the
    pairs' document counts over links. Null and empty texts, and those that the pieces of B do not spell
    (a text with the mark for a space), have zeros and an empty digest. Each row is a document of its own,
    also where rows repeat or share or lack a doc_id. Other columns of `docs` are left out.
    """
    rows = stored(linked(docs, path_a, path_b))
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))  # no more rows than A has ids
    counts = counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    slices = 1 + counts.count() // slice_pairs
    spread_out = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))

    def of(df: DataFrame, i: int) -> DataFrame:
        return df if slices == 1 else df.filter(F.pmod(F.xxhash64("pair"), F.lit(slices)) == i)

    sums = None
    for i in range(slices):
        met = of(spread_out, i).join(F.broadcast(of(counts, i)), "pair")
        part = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        sums = part if sums is None else sums.unionByName(part)
    if slices > 1:
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (
        rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        .join(sums, "row", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    )


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
