"""What is kept and for how long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times as T


def tier_days(named: Column, face: Column, tiers: tuple[int, int, int] = (90, 60, 30)) -> Column:
    """Days for the named, for those with a face, and for the rest."""
    return F.when(named, tiers[0]).when(face, tiers[1]).otherwise(tiers[2])


def retained(tracks: DataFrame, named_ids: DataFrame) -> DataFrame:
    """`tracks` with retain_until_us by tier; a later date already set is never shortened."""
    got = tracks.join(named_ids.select("global_id", F.lit(True).alias("_named")).distinct(), "global_id", "left")
    days = tier_days(F.coalesce("_named", F.lit(False)), F.coalesce("face_verified", F.lit(False)))
    return got.withColumn("retain_until_us", F.greatest("retain_until_us", F.col("ended_us") + days * F.lit(T.DAY))).select(tracks.columns)


def expired(tracks: DataFrame, now_us: int) -> DataFrame:
    return tracks.filter(F.col("retain_until_us").isNotNull() & (F.col("retain_until_us") <= now_us))


def kept(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`table` without the rows of deleted keys."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def plate_reads_kept(reads: DataFrame, cited: DataFrame, now_us: int, days: int) -> DataFrame:
    """Young reads, and old ones that an episode still cites."""
    young = F.col("read_us") > now_us - days * T.DAY
    held = cited.select(F.col("plate_read_id").alias("read_id"), F.lit(True).alias("_cited")).filter(F.col("read_id").isNotNull()).distinct()
    return reads.join(held, "read_id", "left").filter(young | F.col("_cited")).drop("_cited")


def orphans(events: DataFrame, tracks: DataFrame, now_us: int, age_us: int = T.DAY) -> DataFrame:
    """Events of a track that is gone, once a day old."""
    old = events.filter(F.col("track_id").isNotNull() & (F.col("at_us") < now_us - age_us))
    return old.join(tracks.select("track_id"), "track_id", "left_anti")


def unreferenced(deleted: DataFrame, *still: DataFrame) -> DataFrame:
    """Paths of deleted rows that no other row names."""
    out = deleted.select("path").filter(F.col("path").isNotNull()).distinct()
    for s in still:
        out = out.join(s.select("path").distinct(), "path", "left_anti")
    return out


def media_gone(rows: DataFrame, unlinked: DataFrame, key: str) -> DataFrame:
    """Rows to delete: those whose files are known to be unlinked."""
    return rows.join(unlinked.select(key).distinct(), key, "left_semi")


def young(table: DataFrame, at: str, now_us: int, days: int) -> DataFrame:
    return table.filter(F.col(at) > now_us - days * T.DAY)


def purged(tables: dict[str, DataFrame], observed: set[str]) -> dict[str, DataFrame]:
    """Observed tables emptied, configuration kept."""
    return {name: df.limit(0) if name in observed else df for name, df in tables.items()}
