"""A state machine over ordered rows as a scan: each row is a map from state to state, and maps compose.

A key's rows are cut into buckets of time, and these into wide ones. Going up, the maps of a bucket
are composed to one map; going down, each bucket learns the state in which it begins. No task sees
more than one bucket of rows at a time, so a busy key takes as many tasks as it has buckets, and
no step leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the lowest level, and how many such pieces a bucket may have. A bucket's number times this must stay an exact double.
PIECE_ROWS, PIECES = 128, 1 << 20


def _then(state: Column, move: Column) -> Column:
    return F.element_at(move, state + 1)


def _composed(items: Column, states: int) -> Column:
    """One map that does what the maps of `items` (field move) do one after another."""
    return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate(items, s, lambda now, x: _then(now, x["move"])))


def _passed(items: Column, begin: Column) -> Column:
    """The state before and after each of `items`: one state more than there are items."""
    none = F.array(begin)
    return F.aggregate(items, none, lambda done, x: F.concat(done, F.array(_then(F.element_at(done, -1), x["move"]))))


def scanned(rows: DataFrame, keys: list[str], at: str, tie: str, move: Column, states: int, begin: int, width_us: int, name: str = "state", fan: int = 512) -> DataFrame:
    """`rows` with `name`: the state after each row, keys' rows taken in order of (at, tie), beginning with `begin`.

    `move` is an array of `states` ints: where the row leads from each state. width_us is the bucket of the first
    level; however many rows it holds, they are scanned in pieces of PIECE_ROWS, since a list grows by copying. `fan` buckets
    make one of the second level, and a key's buckets of the second level pass through one task. Null keys are a key of their own; a row without time or with a null in `move` is an error of the caller.
    """
    marked = rows.withColumn("_bucket", F.floor(F.col(at) / width_us)).withColumn("_move", move.cast("array<int>"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(at, tie)) - 1
    marked = marked.withColumn("_place", place).withColumn("_bucket", F.col("_bucket") * PIECES + F.floor(F.col("_place") / PIECE_ROWS)).drop("_place")
    order = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col("_move").alias("move"))
    piece = marked.groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list(order)).alias("_items"))
    piece = piece.select(*keys, "_bucket", _composed(F.col("_items"), states).alias("move"))
    above = lambda df, n: _lists(df, keys, n).select(*keys, F.col("_above").alias("_bucket"), _composed(F.col("_items"), states).alias("move"))
    level = above(piece, PIECES)
    wide = above(level, fan)
    starts = _starts(level, _starts(wide, None, keys, begin, None), keys, begin, fan)
    starts = _starts(piece, starts, keys, begin, PIECES)
    item = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col("_move").alias("move"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    held = marked.groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list(item), lambda a, b: _order(a, b)).alias("_items"))
    met = _with_start(held, starts, [*keys, "_bucket"])
    after = F.slice(_passed(F.col("_items"), F.col("_start")), 2, F.size("_items"))
    out = met.select(F.explode(F.arrays_zip(F.col("_items.row").alias("row"), after.alias("state"))).alias("_x"))
    return out.select(*(F.col(f"_x.row.`{c}`").alias(c) for c in rows.columns), F.col("_x.state").alias(name))


def _order(a: Column, b: Column) -> Column:
    before = (a["at"] < b["at"]) | ((a["at"] == b["at"]) & (a["tie"] < b["tie"]))
    after = (a["at"] > b["at"]) | ((a["at"] == b["at"]) & (a["tie"] > b["tie"]))
    return F.when(before, -1).when(after, 1).otherwise(0)


def _with_start(df: DataFrame, starts: DataFrame, on: list[str]) -> DataFrame:
    own = starts.select(*(F.col(c).alias(f"_s_{i}") for i, c in enumerate(on)), F.col("state").alias("_start"))
    fits = [df[c].eqNullSafe(own[f"_s_{i}"]) for i, c in enumerate(on)]
    return df.join(own, fits).drop(*(f"_s_{i}" for i in range(len(on))))


def _lists(level: DataFrame, keys: list[str], fan: int | None) -> DataFrame:
    """keys, _above, _items: the buckets of `level` in order, by `fan` of them, or all of a key."""
    above = F.floor(F.col("_bucket") / fan) if fan else F.lit(0).cast("long")
    return level.groupBy(*keys, above.alias("_above")).agg(F.array_sort(F.collect_list(F.struct("_bucket", "move"))).alias("_items"))


def _starts(level: DataFrame, above: DataFrame | None, keys: list[str], begin: int, fan: int | None) -> DataFrame:
    """keys, _bucket, state: the state in which each bucket of `level` begins."""
    lists = _lists(level, keys, fan)
    lists = lists.withColumn("_start", F.lit(begin)) if above is None else _with_start(lists, above.withColumnRenamed("_bucket", "_above"), [*keys, "_above"])
    before = F.slice(_passed(F.col("_items"), F.col("_start")), 1, F.size("_items"))
    out = lists.select(*keys, F.explode(F.arrays_zip(F.col("_items._bucket").alias("b"), before.alias("s"))).alias("_x"))
    return out.select(*keys, F.col("_x.b").alias("_bucket"), F.col("_x.s").alias("state"))
