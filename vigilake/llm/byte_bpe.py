"""Byte-level BPE encoding and decoding by overlapping chunks.

Short texts are encoded where they lie. A long text is cut into overlapping chunks that
are dealt over the cluster and pre-tokenised in parallel. Two neighbours are stitched at
the first position of their overlap that is a pre-token boundary for both: the pattern
looks at nothing before a position, so from a common boundary on both agree. A boundary
after white space does not count: what a run of white space gives to the next pre-token
depends on what follows, which a piece that ends there would not see. The pieces between
stitches are encoded where their chunk lies, and only ids meet; chunks that do not
resynchronise (a pre-token longer than the overlap) are joined to one piece before.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, spread, texts_of, vocabulary

#: Characters before a chunk's end whose boundaries the missing rest could still move: a contraction has three.
MARGIN = 4


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks-" + hashlib.md5(path.encode()).hexdigest(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def _pattern(pattern: str | None) -> str:
    import public_tokenizers

    return pattern or public_tokenizers.PATTERN


def _width(path: str, pattern: str) -> str:
    """Of ids on their way; two bytes where the vocabulary allows it."""
    return "<u2" if _encoding(path, pattern).n_vocab <= 1 << 16 else "<u4"


def _packed(encoding, text: str) -> bytes:
    return np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk_chars: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit ids) for every row of `docs`.

    A null or empty text has no ids. Repeated rows and repeated or null doc_ids each give their own row.
    Other columns of `docs` are left out.
    """
    if not 0 < overlap <= chunk_chars or overlap <= 2 * MARGIN:
        raise ValueError("overlap must lie between twice the margin and the chunk's length")
    path, pattern = path or vocabulary("byte_bpe_50k.tiktoken"), _pattern(pattern)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > chunk_chars + overlap

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_packed(encoding, t) for t in texts_of(b)], pa.binary())], ["doc_id", "ids"])

    short = spread(rows.filter(~is_long)).mapInArrow(whole, "doc_id long, ids binary")
    return short.unionByName(_encode_long(rows.filter(is_long), path, pattern, chunk_chars, overlap))


def _encode_long(rows: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                starts = range(0, max(1, len(text) - overlap), size)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([text[s : s + size + overlap] for s in starts], pa.string())],
                    ["row", "doc_id", "idx", "n", "text"],
                )

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """head: the chunk's boundaries among its first `overlap` characters; tail: among those that the next chunk shares."""
        match = _compiled(pattern)
        for b in batches:
            heads, tails = [], []
            for idx, n, text in zip(b.column("idx").to_pylist(), b.column("n").to_pylist(), texts_of(b), strict=True):
                ends = [0, *(e for m in match.finditer(text) if not text[(e := m.end()) - 1].isspace())]
                base = idx * size
                heads.append([base + e for e in ends if e <= overlap])
                tails.append([] if idx == n - 1 else [base + e for e in ends if size <= e <= len(text) - MARGIN])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row", "idx", "n")] + [pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["row", "idx", "n", "head", "tail"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encode pieces whose chunks follow one another; most have one."""
        encoding, kind, held = _encoding(path, pattern), _width(path, pattern), []
        for b in batches:
            out: list[list] = [[], [], [], []]
            for row, doc, idx, n, text, begin, end in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "idx", "n", "text", "begin", "end")), strict=True):
                base = idx * size
                last = end is not None or idx == n - 1
                held.append(text[max(0, (begin or 0) - base) : size if not last else None if end is None else end - base])
                if last:
                    for to, x in zip(out, (row, doc, idx, np.array(encoding.encode_ordinary("".join(held)), dtype=kind).tobytes()), strict=True):
                        to.append(x)
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["row", "doc_id", "idx", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _width(path, pattern)
        for text in runs(batches, ["row"]):
            ids = np.frombuffer(b"".join(text.column("ids").to_pylist()), kind).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([text.column("doc_id")[0].as_py()], pa.int64()), pa.array([ids], pa.binary())], ["doc_id", "ids"])

    dealt = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(chunks, "row long not null, doc_id long, idx int not null, n int, text string").repartition("row", "idx")
    order = Window.partitionBy("row").orderBy("idx")
    synced = (
        dealt.mapInArrow(boundaries, "row long not null, idx int not null, n int, head array<long>, tail array<long>")
        .withColumn("end", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
        .withColumn("begin", F.lag("end").over(order))
        .withColumn("piece", F.count("begin").over(order))
        .select("row", "idx", "begin", "end", "piece", ((F.col("begin").isNotNull() | (F.col("idx") == 0)) & (F.col("end").isNotNull() | (F.col("idx") == F.col("n") - 1))).alias("alone"))
    )
    schema = "row long, doc_id long, idx int, ids binary"
    alone = dealt.join(synced.filter("alone"), ["row", "idx"]).mapInArrow(pieces, schema)
    several = dealt.join(synced.filter("not alone"), ["row", "idx"]).repartition("row", "piece").sortWithinPartitions("row", "idx").mapInArrow(pieces, schema)
    return alone.unionByName(several).repartition("row").sortWithinPartitions("row", "idx").mapInArrow(joined, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`encoded` with a column `bytes`: the concatenated bytes of its `ids`; null ids give no bytes."""
    path, pattern = path or vocabulary("byte_bpe_50k.tiktoken"), _pattern(pattern)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for b in batches:
            out = [encoding.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(joined, "doc_id long, ids binary, bytes binary")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and of decoded bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs)).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
