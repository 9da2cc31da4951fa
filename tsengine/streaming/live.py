"""Readings as they arrive: differences and event labels in order of time, with state by sensor, and late rows as new versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tsengine.operators import ordered

#: What the processor tells: `row` of a reading whose place is settled, `late` of one that came after its place, and `last`, once for a
#: sensor with rows, of the last row told before them (null: none).
TOLD = "sensor string, kind string, t long, value double"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Readings that may wait in a task beside those that are held back.
WAITING = 1 << 16


class _Settled(StatefulProcessor):
    """Holds a sensor's readings back until `delay` microseconds of later ones have come, then tells them, in no order.

    State of a sensor: the readings held back, the last one told, the newest time seen. A task keeps at most twice the readings
    held back and WAITING more, as arrays, whatever the rows of a micro-batch. A timer of `idle` milliseconds after the last
    input tells what is still held back.
    """

    def __init__(self, delay: int, idle: int | None):
        self.delay, self.idle = delay, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, value double")
        self.last = handle.getValueState("last", "t long, value double")
        self.newest = handle.getValueState("newest", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self._last()
        newest = self.newest.get()[0] if self.newest.exists() else None
        t, v = self._held()
        told, most = None, 2 * len(t) + WAITING
        waiting, size = [(t, v)], len(t)
        for batch in rows:
            t, v = batch["t"].to_numpy(np.int64), batch["value"].to_numpy(np.float64)
            newest = int(t.max()) if newest is None else max(newest, int(t.max()))
            if last is not None:
                late = (t < last[0]) | ((t == last[0]) & (v < last[1]))
                if late.any():
                    yield self._frame(key[0], "late", t[late], v[late])
                t, v = t[~late], v[~late]
            waiting.append((t, v))
            size += len(t)
            if size > most:
                ready, rest = self._split(waiting, newest)
                waiting, size, most = [rest], len(rest[0]), 2 * len(rest[0]) + WAITING
                if len(ready[0]):
                    told = self._later(told, *ready)
                    yield self._frame(key[0], "row", *ready)
        ready, rest = self._split(waiting, newest)
        if len(ready[0]):
            told = self._later(told, *ready)
            yield self._frame(key[0], "row", *ready)
        if told is not None:
            yield self._before(key[0], last)
            self.last.update(told)
        self.newest.update((newest,))
        self._hold(*rest)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if len(rest[0]):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t, v = self._held()
        if len(t):
            last = self._last()
            yield self._frame(key[0], "row", t, v)
            yield self._before(key[0], last)
            self.last.update(self._later(last, t, v))
            self._hold(t[:0], v[:0])

    def _last(self) -> tuple | None:
        return tuple(self.last.get()) if self.last.exists() else None

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        held = np.array([tuple(x) for x in self.held.get()] if self.held.exists() else [], np.dtype([("t", np.int64), ("v", np.float64)]))
        return held["t"], held["v"]

    def _hold(self, t: np.ndarray, v: np.ndarray) -> None:
        if len(t):
            self.held.put(list(zip(t.tolist(), v.tolist())))
        elif self.held.exists():
            self.held.clear()

    def _split(self, waiting: list, newest: int):
        t, v = (np.concatenate(x) for x in zip(*waiting))
        ready = t <= newest - self.delay
        return (t[ready], v[ready]), (t[~ready], v[~ready])

    @staticmethod
    def _later(told: tuple | None, t: np.ndarray, v: np.ndarray) -> tuple:
        greatest = int(t.max()), float(v[t == t.max()].max())
        return greatest if told is None else max(told, greatest)

    def _before(self, sensor: str, last: tuple | None) -> pd.DataFrame:
        t, v = last or (None, None)
        return self._frame(sensor, "last", pd.array([t], "Int64"), pd.array([v], "Float64"))

    @staticmethod
    def _frame(sensor: str, kind: str, t, v) -> pd.DataFrame:
        return pd.DataFrame({"sensor": pd.Series([sensor] * len(t), dtype=object), "kind": kind, "t": t, "value": v})

    def close(self) -> None:
        pass


def live_differences(stream: DataFrame, delay: int, threshold: float, idle_ms: int | None = None) -> DataFrame:
    """(sensor, kind, t, value, threshold) of a stream of readings (sensor, t in microseconds, value), for `write_live`.

    A micro-batch's rows of kind `row` follow each other, and those of the micro-batches before, in each sensor's order of time and
    value; `write_live` gives them diff and gap to the row before, and event 1 where the value changes by `threshold` or more. Readings
    wait until one `delay` microseconds later has come, or until none has come for `idle_ms` of the clock. A reading that belongs
    before one already told is of kind `late` and changes no state; `write_live` puts it aside as a new version, and `corrected` brings
    both together.

    A sensor's state is its waiting readings and its last one; state lives in the state store of the checkpoint, so a lost
    executor costs a replay of the micro-batch. The rows of a micro-batch pass through the task of their sensor unordered; Spark orders
    them afterwards, in chunks of time. Null or NaN times and values must be left out before (`model.readings`).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    keyed = stream.select("sensor", "t", "value").groupBy("sensor")
    told = keyed.transformWithStateInPandas(_Settled(delay, idle_ms), TOLD, "Append", "None" if idle_ms is None else "ProcessingTime")
    return told.withColumn("threshold", F.lit(float(threshold)))


def _with_differences(batch: DataFrame) -> DataFrame:
    """(sensor, t, value, diff, gap, event) of the rows of a micro-batch, after the last ones told before."""
    # a sensor that is told twice in a micro-batch was last told before at the earlier of two
    last = batch.filter("kind = 'last'").groupBy("sensor").agg(F.count_if(F.col("t").isNull()).alias("_none"), F.min(F.struct("t", "value", "threshold")).alias("_p"))
    last = last.filter("_none = 0").select("sensor", "_p.*", F.lit(False).alias("_new"))
    rows = batch.filter("kind = 'row'").select("sensor", "t", "value", "threshold", F.lit(True).alias("_new")).union(last)
    # a sensor without name is one as well: null keys don't meet in a join
    named = rows.withColumns({"_named": F.col("sensor").isNotNull(), "sensor": F.coalesce("sensor", F.lit(""))})
    before = ordered.with_previous(named, ["sensor", "_named"], ["t", "value"], ["t", "value", "_new"]).filter("_new")
    diff = F.col("value") - F.col("prev_value")
    event = F.coalesce(F.abs(diff) >= F.col("threshold"), F.lit(False)).cast("int")
    return before.select(F.when(F.col("_named"), F.col("sensor")).alias("sensor"), "t", "value", diff.alias("diff"), (F.col("t") - F.col("prev_t")).alias("gap"), event.alias("event"))


def write_live(told: DataFrame, rows: str, late: str, checkpoint: str, **trigger):
    """Starts a query that writes rows with their differences (sensor, t, value, diff, gap, event) to the folder `rows` and late
    readings to `late` as a versioned stream (uuid, time_ns, value, version, deleted), version one more than the micro-batch. A
    micro-batch that is run again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        _with_differences(batch).write.mode("overwrite").parquet(f"{rows}/batch={number}")
        after = batch.filter("kind = 'late'").select(F.col("sensor").alias("uuid"), (F.col("t") * 1000).alias("time_ns"), "value", F.lit(number + 1).cast("long").alias("version"), F.lit(False).alias("deleted"))
        after.write.mode("overwrite").parquet(f"{late}/batch={number}")
        batch.unpersist()

    return told.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(sensor, t, value) of the readings that a stopped query still holds back, from its state store."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").option("flattenCollectionTypes", True).load()
    return state.select(F.col("key.sensor").alias("sensor"), "list_element.t", "list_element.value")


def corrected(rows: DataFrame, more: DataFrame, threshold: float) -> DataFrame:
    """(sensor, t, value, diff, gap, event): told rows with late or waiting readings (sensor, t, value) in their places.

    Only the new rows and each one's successor are computed anew; the others keep what the stream told. Rows are ordered in chunks
    of time (`ordered.with_previous`).
    """
    columns = ["sensor", "t", "value", "diff", "gap", "event"]
    both = rows.select(*columns, F.lit(False).alias("new")).unionByName(more.select("sensor", "t", "value", F.lit(True).alias("new")), allowMissingColumns=True)
    placed = ordered.with_previous(both, ["sensor"], ["t", "value", "new"], ["t", "value", "new"])
    anew = F.col("new") | F.coalesce("prev_new", F.lit(False))
    diff, gap = F.when(anew, F.col("value") - F.col("prev_value")).otherwise(F.col("diff")), F.when(anew, F.col("t") - F.col("prev_t")).otherwise(F.col("gap"))
    event = F.when(anew, F.coalesce(F.abs(diff) >= threshold, F.lit(False)).cast("int")).otherwise(F.col("event"))
    return placed.select("sensor", "t", "value", diff.alias("diff"), gap.alias("gap"), event.alias("event"))


def differences(readings: DataFrame, threshold: float) -> DataFrame:
    """The same columns of a whole table of readings, as a batch."""
    before = ordered.with_previous(readings, ["sensor"], ["t", "value"], ["t", "value"])
    diff = F.col("value") - F.col("prev_value")
    return before.select("sensor", "t", "value", diff.alias("diff"), (F.col("t") - F.col("prev_t")).alias("gap"), F.coalesce(F.abs(diff) >= threshold, F.lit(False)).cast("int").alias("event"))
