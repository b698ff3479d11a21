"""Ordered folds with state by key: one definition for tables and for streams.

A fold sees the rows of its key in order of (time, tie) and returns output rows; `expire(now)` gives
what falls due by time alone. Over a table each stretch between long pauses is folded where it
lies. Over a stream rows wait until the watermark has passed them and then go through in order, so
the output does not depend on how the stream was cut, as long as no row comes later than the
watermark allows (such rows are dropped). The fold keeps its state in a dictionary of named entries;
only entries that changed are written back to the state store.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import islands


class Fold(ABC):
    """State of one key. `entries` maps names to values that JSON can hold."""

    def __init__(self, entries: dict[str, Any] | None = None):
        self.entries: dict[str, Any] = entries if entries is not None else {}

    @abstractmethod
    def take(self, row: dict[str, Any]) -> list[tuple]:
        """Output of one row; rows come in order of time."""

    def expire(self, now: int) -> list[tuple]:
        """Output of what fell due before or at `now`, in order; called before a row of a later time."""
        return []

    def due(self) -> int | None:
        """The time of the next thing that falls due."""
        return None


def _names(schema: str) -> list[str]:
    return [c.split()[0].strip("`") for c in schema.split(", ")]


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype(object)


def _plain(frame: pd.DataFrame) -> list[dict[str, Any]]:
    frame = frame.astype(object)
    return frame.where(frame.notna(), None).to_dict("records")


def folded(rows: DataFrame, keys: list[str], at: str, tie: str, make: Callable[[dict[str, Any], dict[str, Any]], Fold], schema: str, gap_us: int, last: int = 2**62) -> DataFrame:
    """`schema` rows of a fold over a table: keys first, then what `make(key, entries)` returns for each row.

    No state outlives a pause of more than gap_us: stretches between pauses are dealt over the tasks, so a
    busy key takes many tasks. After a stretch everything due until `last` follows. A stretch is read batch
    by batch; only its state is held.
    """
    names = _names(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, key = None, ()
        for frame in frames:
            out: list[tuple] = []
            for row in _plain(frame):
                if row.pop("_opens"):
                    if fold is not None:
                        out += [(*key, *x) for x in fold.expire(last)]
                    key = tuple(row[k] for k in keys)
                    fold = make(dict(zip(keys, key, strict=True)), {})
                out += [(*key, *x) for x in fold.expire(row[at] - 1)]
                out += [(*key, *x) for x in fold.take(row)]
            yield _frame(out, names)
        if fold is not None:
            yield _frame([(*key, *x) for x in fold.expire(last)], names)

    return islands.in_order(rows, keys, at, tie, gap_us).mapInPandas(run, schema)


class _Processor(StatefulProcessor):
    def __init__(self, keys: list[str], at: str, tie: str, make, names: list[str]):
        self.keys, self.at, self.tie, self.make, self.names = keys, at, tie, make, names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.entries = handle.getMapState("entries", "name string", "value string")

    def _timer(self, ms: int) -> None:
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            got = _plain(frame.drop(columns=["_event_time"], errors="ignore"))
            self.waiting.appendList([(json.dumps(r, default=str),) for r in got])
            latest = max([r[self.at] for r in got] + ([] if latest is None else [latest]))
        if latest is not None:
            self._timer(-(-latest // 1000))
        yield _frame([], self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kept = {n: v for (n,), (v,) in self.entries.iterator()} if self.entries.exists() else {}
        own = tuple(k.item() if hasattr(k, "item") else k for k in key)
        fold = self.make(dict(zip(self.keys, own, strict=True)), {n: json.loads(v) for n, v in kept.items()})
        waiting = sorted((json.loads(x) for (x,) in self.waiting.get()), key=lambda r: (r[self.at], r[self.tie])) if self.waiting.exists() else []
        ready, out = [r for r in waiting if r[self.at] <= now], []
        for row in ready:
            out += fold.expire(row[self.at] - 1)
            out += fold.take(row)
        out += fold.expire(now)
        if ready:
            if rest := [(json.dumps(r),) for r in waiting[len(ready) :]]:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        changed = {n: json.dumps(v) for n, v in fold.entries.items()}
        for n in kept.keys() - changed.keys():
            self.entries.removeKey((n,))
        for n, v in changed.items():
            if kept.get(n) != v:
                self.entries.updateValue((n,), (v,))
        if (due := fold.due()) is not None:
            self._timer(max(-(-due // 1000), now // 1000 + 1))
        yield _frame([(*own, *x) for x in out], self.names)

    def close(self) -> None:
        pass


def streamed(rows: DataFrame, keys: list[str], at: str, tie: str, make: Callable[[dict[str, Any], dict[str, Any]], Fold], schema: str, late: str = "10 seconds") -> DataFrame:
    """The same over a stream, in append mode. `at` counts microseconds; rows more than `late` behind the newest are dropped.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    event_time: Column = F.timestamp_micros(at)
    timed = rows.withColumn("_event_time", event_time).withWatermark("_event_time", late)
    return timed.groupBy(*keys).transformWithStateInPandas(_Processor(keys, at, tie, make, _names(schema)), schema, "append", "EventTime")


#: The state store that `streamed` needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
