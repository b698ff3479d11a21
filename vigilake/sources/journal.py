"""A change log over a folder: a streaming source with positions, and a follower that keeps a copy in step.

The journal is a folder of immutable segments, each with the entries of consecutive positions. A reader
starts at the earliest or next entry or at a position, resumes where its checkpoint says, and sees
every entry once. Positions whose segments are gone by then are reported as a gap. The follower reads
only the keys that entries name, and compares whole tables after a gap and in the beginning.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .tables import changes

SCHEMA = "position long, channel string, key string, payload string, kind string"
DIGITS = 19


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def segments(folder: str) -> list[tuple[int, int, str]]:
    """(first position, last position, path) of the folder's segments in order; other files are left out."""
    from pyarrow import fs

    system, path = _filesystem(folder)
    out = []
    for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        first, _, last = f.base_name.removesuffix(".jsonl").partition("-")
        if f.base_name.endswith(".jsonl") and first.isdigit() and last.isdigit():
            out.append((int(first), int(last), f.path))
    return sorted(out)


def append(folder: str, entries: Sequence[tuple[str, str, str | None]]) -> int:
    """Write (channel, key, payload) entries as one segment and return the position after them; for one writer at a time."""
    known = segments(folder)
    first = known[-1][1] + 1 if known else 0
    if not entries:
        return first
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    rows = [{"position": first + i, "channel": c, "key": k, "payload": p} for i, (c, k, p) in enumerate(entries)]
    last = first + len(rows) - 1
    hidden = f"{path}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    system.move(hidden, f"{path}/{first:0{DIGITS}}-{last:0{DIGITS}}.jsonl")
    return last + 1


@dataclass
class Stretch(InputPartition):
    """Entries of one segment, or without one a gap: positions from `first` to before `end`."""

    first: int
    end: int
    path: str | None


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str, begin: str):
        self.folder, self.begin = folder, begin

    def initialOffset(self) -> dict:
        if self.begin == "latest":
            return self.latestOffset()
        if self.begin == "earliest":
            known = segments(self.folder)
            return {"next": known[0][0] if known else 0}
        return {"next": int(self.begin)}

    def latestOffset(self) -> dict:
        known = segments(self.folder)
        return {"next": known[-1][1] + 1 if known else 0}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out, at = [], start["next"]
        for first, last, path in segments(self.folder):
            if last < at or first >= end["next"]:
                continue
            if first > at:
                out.append(Stretch(at, first, None))
            at = max(at, first)
            stop = min(last + 1, end["next"])
            out.append(Stretch(at, stop, path))
            at = stop
        if at < end["next"]:
            out.append(Stretch(at, end["next"], None))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.path is None:
            yield (partition.first, None, None, str(partition.end), "gap")
            return
        system, _ = _filesystem(self.folder)
        with system.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                r = json.loads(line)
                if partition.first <= r["position"] < partition.end:
                    yield (r["position"], r["channel"], r["key"], r["payload"], "change")

    def commit(self, end: dict) -> None:
        """Nothing: the checkpoint of the query keeps the position; segments end by their own retention."""


class Journal(DataSource):
    """spark.readStream.format("journal").option("path", folder).option("begin", "earliest" | "latest" | a position)."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("begin", "earliest"))


def entries(spark: SparkSession, folder: str, begin: str = "earliest", channel: str | None = None) -> DataFrame:
    """The journal as a stream of SCHEMA rows: changes, of one channel if given, and gaps with the position that ends them."""
    spark.dataSource.register(Journal)
    rows = spark.readStream.format("journal").option("path", folder).option("begin", begin).load()
    return rows if channel is None else rows.filter((F.col("kind") == "gap") | (F.col("channel") == channel))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def follower(source: Callable[[SparkSession], DataFrame], key: str, folder: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch over `entries`: keeps `folder`/copy in step with `source` and files what changed.

    `folder`/feed/batch=n has the changes of each batch (insert, update, delete), `folder`/copy the source's rows by
    bucket of their key. A batch that names keys reads those rows alone and rewrites their buckets; the first one and
    one with a gap compare everything. A batch that is run again applies the changes that it filed, if it did,
    so nothing is lost or filed twice. Key values are compared as strings; null keys take no part.
    """
    copy, feed = f"{folder}/copy", f"{folder}/feed"

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = source(spark).filter(F.col(key).isNotNull())
        before = spark.read.schema(bucketed(now).schema).parquet(copy) if _exists(spark, f"{copy}/_SUCCESS") else None
        filed = f"{feed}/batch={number}"
        if not _exists(spark, f"{filed}/_SUCCESS"):
            named = batch.filter("kind = 'change'").select(F.col("key").alias("_named")).filter("_named IS NOT NULL").distinct()
            known = spark.createDataFrame([], bucketed(now).schema) if before is None else before
            if before is not None and batch.filter("kind = 'gap'").isEmpty():
                touched = bucketed(named.select(F.col("_named").alias(key))).select("_bucket").distinct()
                known = known.join(F.broadcast(touched), "_bucket", "left_semi")  # at most `buckets` rows; prunes the partitions
                known, now = (df.join(named, F.col(key).cast("string") == F.col("_named"), "left_semi") for df in (known, now))
            changes(known.drop("_bucket").select(now.columns), now, [key]).write.mode("overwrite").parquet(filed)
        changed = bucketed(spark.read.parquet(filed))
        if changed.isEmpty() and before is not None:
            return
        rows = changed.filter("change <> 'delete'").drop("change")
        if before is not None:
            touched = changed.select("_bucket").distinct()
            kept = before.join(F.broadcast(touched), "_bucket", "left_semi").join(changed.select(key), key, "left_anti")
            rows = kept.unionByName(rows.select(kept.columns))
            # a bucket that loses its last row has to be written too, else its old file stays
            held = f"{folder}/next"
            rows.write.mode("overwrite").parquet(held)
            rows = spark.read.parquet(held)
            for r in touched.join(rows.select("_bucket").distinct(), "_bucket", "left_anti").collect():  # at most `buckets`
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{copy}/_bucket={r._bucket}")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if before is None else "dynamic").partitionBy("_bucket").parquet(copy)

    return write
