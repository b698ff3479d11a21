"""Cost-balanced packing of documents into token sequences of bounded length.

Each task tokenises its documents and packs them a buffer of tokens at a time, so memory
is bounded, nothing is shuffled for the packing and no task waits for another. Within a
buffer, pieces that fill a sequence are set apart; the rest is assigned in descending
order of attention cost (linear plus quadratic in a piece's length) to the sequence of
lowest cost that still has room. What fits nowhere whole is cut over the rooms left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, texts_of, vocabulary

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Words kept in a worker's memory of segmentations; it starts anew when full.
MEMO_WORDS = 300_000
#: A word with another character goes through the tokenizer itself.
PLAIN = r"[^!-~¡-ňŊ-ſ]"
#: In a text with one of these, lower case or white space depend on more than the word.
WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ")
MARK = "\x01"


class WordTokenizer:
    """Ids of a word-level BPE vocabulary file, as packed unsigned 16- or 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of
    its words in order. Words seen before come from memory; new ones are merged all at once
    by a rank table in which a mark stands for the end of a word.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = {c: bytes([b]) for b, c in _byte_chars().items()}
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return b"".join(chars[c] for c in (token.removesuffix(suffix) if end else token)) + MARK.encode() * end

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + MARK.encode(): 256 + b for b in range(256)}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw(left + right), len(ranks))
        self.ids = np.zeros(len(ranks), "<u4")
        self.ends = np.zeros(len(ranks), bool)
        for token, i in model["vocab"].items():
            if (r := ranks.get(raw(token) if all(c in chars for c in token.removesuffix(suffix)) else b"")) is not None:
                self.ids[r] = i
                self.ends[r] = token.endswith(suffix)
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.odd = regex.compile(PLAIN)
        self.memo: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        counts, marked = [], []
        odd = self.odd.search("".join(words)) and {w for w in words if self.odd.search(w)}
        if odd:
            self.memo.update((w, self._slow(w)) for w in odd)
            words = [w for w in words if w not in odd]
        for w in words:
            if w.isalpha():
                counts.append(1)
                marked.append(w)
            else:
                parts = self.parts.findall(w)
                counts.append(len(parts))
                marked += parts
        if not marked:
            self.memo.update(dict.fromkeys(words, b""))
            return
        ranks = np.array(self.fast.encode_ordinary(MARK.join(marked) + MARK), np.int64)
        ends = np.flatnonzero(self.ends[ranks])
        upto = (np.concatenate([[0], ends + 1])[np.cumsum([0, *counts])] * 4).tolist()
        packed = self.ids[ranks].tobytes()
        self.memo.update(zip(words, [packed[a:b] for a, b in zip(upto, upto[1:])], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if any(c in t for c in WHOLE) else t.lower().split() for t in texts]
        words = set().union(*(s for s in split if s))
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo.clear()
        if new := [w for w in words if w not in self.memo]:
            self._learn(new)
        known = self.memo.__getitem__
        return [self._slow(t) if s is None else b"".join(map(known, s)) for t, s in zip(texts, split, strict=True)]

    def _slow(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def portions(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about so many characters together."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def capacities(tokens: int, size: int) -> list[int]:
    """Lengths of sequences that hold `tokens` with nothing to pad: full ones, then descending powers of two."""
    full, rest = divmod(tokens, size)
    return [size] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for the documents of one buffer."""
    out, rest, n = [], [], 0
    for d, length in enumerate(lengths):
        at = 0
        while length - at >= size:
            out.append((d, at, size, n, 0))
            at, n = at + size, n + 1
        if length > at:
            rest.append((length - at, d, at))
    cost = lambda k: linear * k + quadratic * k * k
    room = capacities(sum(r[0] for r in rest), size)
    used = [0] * len(room)
    heap = [(0.0, -c, s) for s, c in enumerate(room)]  # lowest cost first, then the larger
    heapq.heapify(heap)
    over = []
    for length, d, at in sorted(rest, key=lambda r: (-r[0], r[1])):
        aside = []
        while heap:
            c, _, s = heapq.heappop(heap)
            if room[s] - used[s] >= length:
                out.append((d, at, length, n + s, used[s]))
                used[s] += length
                if used[s] < room[s]:
                    heapq.heappush(heap, (c + cost(length), used[s] - room[s], s))
                break
            aside.append((c, used[s] - room[s], s))
            if len(aside) >= 64:  # the cheapest are all too full; longer search moves the balance little
                aside += heap
                heap = []
                fit = [x for x in aside if -x[1] >= length]
                if fit:
                    best = min(fit)
                    aside.remove(best)
                    heap.append(best)
        else:
            over.append((length, d, at))
        for x in aside:
            heapq.heappush(heap, x)
    for length, d, at in over:
        while length:
            c, _, s = heapq.heappop(heap)
            take = min(length, room[s] - used[s])
            out.append((d, at, take, n + s, used[s]))
            used[s] += take
            length, at = length - take, at + take
            if used[s] < room[s]:
                heapq.heappush(heap, (c + cost(take), used[s] - room[s], s))
    return out


def pack(docs: DataFrame, path: str | None = None, size: int = 4096, end_id: int = 2, buffer_tokens: int = 2_000_000, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> DataFrame:
    """Pieces of every document: SCHEMA, ids as little-endian unsigned 32-bit numbers.

    Every document, also an empty one or a null text, ends with `end_id`; a document without
    doc_id is packed as any other. Repeated rows are packed each. `size` is a power of two.
    sequence_id is the task's number times 2**32 plus a count.
    """
    path = path or vocabulary("word_bpe_49k.json")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, tokenize, end = TaskContext.get().partitionId() << 32, word_tokenizer(path), np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        tokens = sequences = 0

        def flush():
            nonlocal tokens, sequences
            lengths = [len(ids) // 4 for _, ids in held]
            placed = assign(lengths, size, linear, quadratic)
            rows = [[], [], [], [], [], [], []]
            for d, at, length, s, offset in placed:
                for col, v in zip(rows, (held[d][0], at, length, held[d][1][4 * at : 4 * (at + length)], lengths[d], base + sequences + s, offset), strict=True):
                    col.append(v)
            sequences += 1 + max((p[3] for p in placed), default=-1)
            held.clear()
            tokens = 0
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            docs_in, texts = b.column("doc_id").to_pylist(), texts_of(b)
            for first, last in portions(texts):
                for doc, ids in zip(docs_in[first:last], tokenize(texts[first:last]), strict=True):
                    held.append((doc, ids + end))
                    tokens += len(ids) // 4 + 1
                    if tokens >= buffer_tokens:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select("doc_id", "text")
    dealt = spread(rows)
    if dealt is not rows:  # rows that were dealt anew come in any order
        dealt = dealt.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(packed, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    from pyspark.sql import functions as F

    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


