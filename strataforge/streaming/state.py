"""Keyed state with event time: a memory of turns that expires, and alerts with repeats by the clock.

Rows of a key are taken in the order of their time within a micro-batch. State is kept by Spark's
RocksDB store and is small for each key whatever the stream's length; timers remove it when its time is over.
Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HOUR = 3_600_000_000  # microseconds, the unit of all times here
ROWS = 1 << 16  # rows of an output table


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _whole(column: pd.Series) -> list[int]:
    """Whole numbers; a column of which some are null comes as floats."""
    return column.fillna(-1).astype("int64").tolist()


def _due(at: int) -> int:
    """The first millisecond after a time in microseconds, the unit of timers."""
    return at // 1000 + 1


def _packed(turns: pd.DataFrame) -> tuple[bytes]:
    """Turns (key, id, at) as one value of a list state, which keeps and sends each value on its own."""
    batch = pa.RecordBatch.from_arrays([pa.array(turns["key"], pa.string(), from_pandas=True), pa.array(_whole(turns["id"]), pa.int64()), pa.array(_whole(turns["at"]), pa.int64())], ["key", "id", "at"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(state) -> pd.DataFrame:
    parts = [pa.ipc.open_stream(bytes(value[0])).read_pandas() for value in state.get()]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"key": pd.Series(dtype=object), "id": pd.Series(dtype="int64"), "at": pd.Series(dtype="int64")})


class TurnMemory(StatefulProcessor):
    """For each turn: the ``most`` last turns of its key within ``hours`` before it, oldest first, itself among them.

    A turn waits until the watermark has passed it, so turns that come out of order find
    the same history as in order. Keys are kept in BUCKETS groups, so that what Spark does for a group (calls, timers, tables) is done for many keys at once.
    Waiting turns are in one list, remembered ones (``most`` a key at most) in another;
    a timer waits for the earliest waiting turn, and one at the hour after a key's ``hours`` without a turn forgets it.
    """

    OUTPUT = "key string, id long, at long, history array<long>"
    BUCKETS = 1024
    _TURNS = "turns binary"

    def __init__(self, most: int = 6, hours: float = 24):
        self.most, self.reach = most, int(hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self._TURNS)
        self.remembered = handle.getListState("remembered", self._TURNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendValue(_packed(part))
            first = min(_whole(part["at"]) + ([] if first is None else [first]))
        self.handle.registerTimer(_due(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, memory = _unpacked(self.waiting), _unpacked(self.remembered)
        ready = _due(waiting["at"]) <= now  # all at once: other timers find nothing to do
        turns = pd.concat([memory, waiting[ready]], ignore_index=True)
        group, _ = pd.factorize(turns["key"], use_na_sentinel=False)
        ids, at = turns["id"].to_numpy(), turns["at"].to_numpy()
        new = np.arange(len(turns)) >= len(memory)
        order = np.lexsort((ids, at, new, group))
        group, ids, at, new = group[order], ids[order], at[order], new[order]
        place = np.arange(len(ids))
        size = np.ones(len(ids), np.int64)
        for d in range(1, self.most):  # a key's turns are neighbours in the order of their times
            before = np.maximum(place - d, 0)
            size += (place >= d) & (group[before] == group) & (at[before] >= at - self.reach)
        last = np.searchsorted(group, group, side="right")
        kept = (last - place <= self.most) & (_due(at + self.reach) > now)
        for state, rows in ((self.waiting, waiting[~ready]), (self.remembered, turns.iloc[order[kept]])):
            if len(rows):
                state.put([_packed(rows)])
            else:
                state.clear()
        if not ready.all():
            self.handle.registerTimer(_due(int(waiting["at"][~ready].min())))
        if kept.any():
            ends = _due(at[kept & (last - place == 1)] + self.reach)
            self.handle.registerTimer(-(-int(ends.min()) * 1000 // HOUR) * HOUR // 1000)
        said = np.flatnonzero(new)
        names = turns["key"].to_numpy()[order]
        for i in range(0, len(said), ROWS):
            own = said[i : i + ROWS]
            histories = [ids[p - n + 1 : p + 1] for p, n in zip(own.tolist(), size[own].tolist())]
            yield pd.DataFrame({"key": names[own], "id": ids[own], "at": at[own], "history": histories})

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """warn at the ``after``-th failure in a row, repeat each ``again`` hours as long as it lasts, recovered at the first success.

    Repeats come by event time, whether rows come or not: a timer waits for the next one. One row of state a key.
    """

    OUTPUT = "key string, at long, kind string, failures long"

    def __init__(self, after: int = 3, again: float = 6):
        self.after, self.again = after, int(again * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures long, next long")  # next: when to repeat, 0 without a warning

    def _load(self) -> tuple[int, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0)

    def _save(self, failures: int, following: int, before: int) -> None:
        if before != following:
            if before:
                self.handle.deleteTimer(_due(before))
            if following:
                self.handle.registerTimer(_due(following))
        if failures or following:
            self.state.update((failures, following))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, following = self._load()
        before, out = following, []
        batch = _in_order(rows, ["at", "id"])
        for at, ok in zip(_whole(batch["at"]), batch["ok"].tolist()):
            if ok is None:  # an end row only moves the watermark
                continue
            while following and following <= at:
                out.append((key[0], following, "repeat", failures))
                following += self.again
            if ok:
                if following:
                    out.append((key[0], at, "recovered", failures))
                failures, following = 0, 0
                continue
            failures += 1
            if failures == self.after:
                out.append((key[0], at, "warn", failures))
                following = at + self.again
        self._save(failures, following, before)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "kind", "failures"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, following = self._load()
        before, out, now = following, [], timerValues.getCurrentWatermarkInMs() * 1000
        while following and following <= now:
            out.append((key[0], following, "repeat", failures))
            following += self.again
        self._save(failures, following, before)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "kind", "failures"])

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, key: str, processor: StatefulProcessor, late: str) -> DataFrame:
    """A stream of (key, id, ts, ...) through a processor; ``at`` is the row's time in microseconds."""
    timed = rows.withColumn("key", F.col(key).cast("string")).withColumn("at", F.unix_micros("ts"))
    buckets = getattr(processor, "BUCKETS", None)
    if buckets:
        timed = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return timed.withWatermark("ts", late).groupBy("bucket" if buckets else "key").transformWithStateInPandas(processor, outputStructType=processor.OUTPUT, outputMode="append", timeMode="eventTime")


def with_end(rows: DataFrame, end: DataFrame) -> DataFrame:
    """A stream of all that is there, and one row of an ``end`` stream with a later time and no key: it moves the watermark past what is there."""
    return rows.unionByName(end, allowMissingColumns=True)
