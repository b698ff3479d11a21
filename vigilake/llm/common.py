"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that `kept` judges at once.
KEPT_ROWS = 1024


def vocabulary(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes another path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt evenly over the cluster where it has too few partitions to keep the cores busy with per-row work.

    Many partitions stay as they are, so a large table is not shuffled. Round robin has no key, hence no hot key.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names. Only a session on one machine may go without: it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            place = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(place)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with files that every executor can read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the checkpoint folder; smaller than a checkpoint."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def held_out(doc_id, folds: int, fold: int):
    """True for rows whose crc32(id as text) falls into one fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def below_share(share: float, *key) -> Column:
    """True for a share of all 64-bit hashes of `key`; a share as small as 1e-15 still means that share."""
    limit = min(int(share * 2.0**64), 2**64 - 1) - 2**63
    return F.xxhash64(*key, F.lit(20_011)) <= F.lit(limit)


def bounded_sample(df: DataFrame, n: int, *key, total: int | None = None) -> DataFrame:
    """About n rows at most, chosen by a hash of `key`, which rows do not share; all rows where there are fewer.

    Used for fitting only. The choice depends on values alone, so a re-run task makes the same one. `total` is the
    number of rows where it is known.
    """
    total = df.count() if total is None else total
    return df if total <= n else df.filter(below_share(n / total, *key))


def kept(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """Rows of `docs`, all columns as they are, whose text `keep` accepts."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, KEPT_ROWS):  # the texts of a whole batch are many as Python strings
                part = b.slice(a, KEPT_ROWS)
                yield part.filter(pa.array(keep(part.column("text").to_pylist()), pa.bool_()))

    return spread(docs).mapInArrow(filtered, docs.schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that share `keys`; for input sorted within partitions."""
    import numpy as np

    open_key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist() + [batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != open_key:
                yield pa.Table.from_batches(held)
                held = []
            open_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


