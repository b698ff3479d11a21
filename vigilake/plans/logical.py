"""The logical tables over a star schema with an event stream, as DataFrames and as SQL.

A lake that holds the engine's own tables uses `sources.tables` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as T

MIN = T.MINUTE


class Lake:
    """Logical tables of a folder; each call is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.raw("events").select("event_id", F.col("user_id").alias("camera_id"), F.col("user_id").alias("track_id"), F.col("event_type").alias("kind"), T.micros(F.col("ts")).alias("at_us"), "value", F.col("props").alias("payload"))

    def cameras(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("camera_id"), F.col("c_name").alias("slug"), F.col("c_mktsegment").alias("segment"))

    def tracks(self) -> DataFrame:
        k = F.col("o_orderkey")
        one_of = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
        start = T.micros(F.col("o_orderdate")) + (k % 1440) * MIN
        named: Column = k % 3 == 0
        return self.raw("orders").select(
            k.alias("track_id"),
            (F.col("o_custkey") % 20).alias("camera_id"),
            one_of([0, 2, 7, 15, 1], 5).alias("class_id"),
            one_of(["person", "car", "truck", "cat", "bicycle"], 5).alias("class_name"),
            one_of(["person", "vehicle", "vehicle", "pet", "bicycle"], 5).alias("reid_group"),
            start.alias("started_us"),
            (start + (k * 37 % 600 + 1) * MIN).alias("ended_us"),
            (k % 97 + 1).alias("n_observations"),
            F.when(named, F.concat(F.lit("id-"), (F.col("o_custkey") % 30).cast("string"))).alias("global_id"),
            F.when(named, F.concat(F.lit("name-"), (F.col("o_custkey") % 30).cast("string"))).alias("identity_name"),
            (k % 7 == 0).alias("face_verified"),
            F.when(k % 4 == 0, F.concat(F.lit("ZG"), (k % 9000).cast("string"))).alias("plate_text"),
            F.when(k % 6 > 3, k % 6 == 5).alias("ever_active"),
            (k % 2 == 0).alias("came_to_rest"),
            F.when(k % 11 == 0, "static").alias("suppressed_reason"),
            F.concat(F.lit("p/"), k.cast("string")).alias("thumbnail"),
            F.lit(None).cast("long").alias("retain_until_us"),
        )

    def recordings(self) -> DataFrame:
        k = F.col("o_orderkey")
        start = T.micros(F.col("o_orderdate")) + (k % 288) * 5 * MIN
        return self.raw("orders").select(
            k.alias("recording_id"),
            (F.col("o_custkey") % 20).alias("camera_id"),
            start.alias("started_us"),
            F.when(k % 50 != 0, start + (k % 7 + 1) * MIN).alias("ended_us"),
            F.floor("o_totalprice").cast("long").alias("size_bytes"),
            F.when(k % 5 != 0, F.col("o_orderstatus")).alias("codec"),
            F.when(k % 9 == 0, start + 86_400_000_000).alias("retain_until_us"),
        )

    def samples(self) -> DataFrame:
        k = F.col("l_orderkey")
        return self.raw("lineitem").select(
            (k * 8 + F.col("l_linenumber")).alias("sample_id"),
            k.alias("track_id"),
            (k % 20).alias("camera_id"),
            (T.micros(F.col("l_shipdate")) + (F.col("l_partkey") % 86_400) * T.SECOND).alias("at_us"),
            (F.col("l_discount") * 10).alias("confidence"),
            F.col("l_quantity").alias("size_pct"),
            (F.col("l_suppkey") % 5).cast("int").alias("class_id"),
            (F.col("l_extendedprice") % 640).alias("x"),
            (F.col("l_extendedprice") % 360).alias("y"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
        )

    def vectors(self) -> DataFrame:
        """vec_id even: a reference of identity `label`; odd: a probe."""
        return self.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


SQL = """
ev AS (SELECT event_id, user_id AS camera_id, user_id AS track_id, event_type AS kind, epoch_us(ts) AS at_us, value, props AS payload FROM events),
cam AS (SELECT c_custkey AS camera_id, c_name AS slug, c_mktsegment AS segment FROM customer),
tr AS (
  SELECT o_orderkey AS track_id, o_custkey % 20 AS camera_id,
    CAST([0, 2, 7, 15, 1][o_orderkey % 5 + 1] AS INTEGER) AS class_id,
    ['person', 'car', 'truck', 'cat', 'bicycle'][o_orderkey % 5 + 1] AS class_name,
    ['person', 'vehicle', 'vehicle', 'pet', 'bicycle'][o_orderkey % 5 + 1] AS reid_group,
    epoch_us(o_orderdate) + (o_orderkey % 1440) * 60000000 AS started_us,
    epoch_us(o_orderdate) + (o_orderkey % 1440) * 60000000 + (o_orderkey * 37 % 600 + 1) * 60000000 AS ended_us,
    o_orderkey % 97 + 1 AS n_observations,
    CASE WHEN o_orderkey % 3 = 0 THEN 'id-' || (o_custkey % 30) END AS global_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'name-' || (o_custkey % 30) END AS identity_name,
    o_orderkey % 7 = 0 AS face_verified,
    CASE WHEN o_orderkey % 4 = 0 THEN 'ZG' || (o_orderkey % 9000) END AS plate_text,
    CASE WHEN o_orderkey % 6 > 3 THEN o_orderkey % 6 = 5 END AS ever_active,
    o_orderkey % 2 = 0 AS came_to_rest,
    CASE WHEN o_orderkey % 11 = 0 THEN 'static' END AS suppressed_reason,
    'p/' || o_orderkey AS thumbnail
  FROM orders),
rec AS (
  SELECT o_orderkey AS recording_id, o_custkey % 20 AS camera_id,
    epoch_us(o_orderdate) + (o_orderkey % 288) * 300000000 AS started_us,
    CASE WHEN o_orderkey % 50 <> 0 THEN epoch_us(o_orderdate) + (o_orderkey % 288) * 300000000 + (o_orderkey % 7 + 1) * 60000000 END AS ended_us,
    CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS codec,
    CASE WHEN o_orderkey % 9 = 0 THEN epoch_us(o_orderdate) + (o_orderkey % 288) * 300000000 + 86400000000 END AS retain_until_us
  FROM orders),
sa AS (
  SELECT l_orderkey * 8 + l_linenumber AS sample_id, l_orderkey AS track_id, l_orderkey % 20 AS camera_id,
    epoch_us(l_shipdate) + (l_partkey % 86400) * 1000000 AS at_us, l_discount * 10 AS confidence, l_quantity AS size_pct,
    CAST(l_suppkey % 5 AS INTEGER) AS class_id, l_extendedprice % 640 AS x, l_extendedprice % 360 AS y,
    l_returnflag AS flag, l_linestatus AS status, l_partkey, l_suppkey, l_linenumber
  FROM lineitem),
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)
"""


def sql(body: str) -> str:
    """A query over the logical tables; the body begins with further tables or with SELECT."""
    body = body.strip()
    head = "SELECT" if body.upper().startswith("SELECT") else ","
    return f"WITH {SQL.strip()}\n{'' if head == 'SELECT' else ', '}{body}"
