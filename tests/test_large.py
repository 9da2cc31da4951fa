"""What only larger tables show: numbers beyond 32 bits, and rows that one task would hold."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsengine.model import DAY, HOUR, MINUTE
from tsengine.operators import align, clean, features, ordered
from tsengine.streaming import live

READINGS = "sensor string, t long, value double"


def test_many_readings_of_a_minute(spark):
    rows = [("hot", 5 * MINUTE, float(i)) for i in range(100)] + [("one", 5 * MINUTE, 1.0)]
    got = {(r["sensor"], r["value"]): r["t"] for r in align.within_minutes(spark.createDataFrame(rows, READINGS)).collect()}
    assert got == {("hot", float(i)): 5 * MINUTE + i * MINUTE // 100 for i in range(100)} | {("one", 1.0): 5 * MINUTE + MINUTE // 2}


@pytest.fixture
def busy(spark):
    """Readings of a sensor with many in a few hours and one in a month, and of one with few."""
    r = random.Random(2)
    rows = [("hot", r.randrange(4 * HOUR), float(r.randint(0, 99))) for _ in range(3000)] + [("hot", 29 * DAY, 1.0)] + [("calm", k * DAY + 7, float(k)) for k in range(40)]
    return spark.createDataFrame(rows, READINGS)


def test_chunks_follow_the_rows(busy, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 100)
    width = ordered.chunk_width(busy, ["sensor"], "t", 30 * DAY)
    largest = busy.groupBy("sensor", F.floor(F.col("t") / F.lit(width))).count().agg(F.max("count")).first()[0]
    assert 30 < largest <= 200
    monkeypatch.undo()
    assert ordered.chunk_width(busy.limit(0), ["sensor"], "t", 30 * DAY) == 30 * DAY


def test_chunks_leave_results_alone(spark, busy, monkeypatch):
    def results():
        even = clean.regularise(busy)
        asked = busy.select("sensor", (F.col("t") + 5).alias("t"))
        slots = features.difference_features(busy, align.slot_grid(spark, 0, 4 * HOUR, HOUR), 0, 4 * HOUR, HOUR, 2)
        tables = [even, ordered.neighbours(busy, asked), ordered.with_totals(busy, ["sensor"], "value", ["t", "value"]), ordered.first_difference(busy), slots]
        return [sorted(map(tuple, x.collect()), key=repr) for x in tables]

    whole = results()
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 100)
    assert results() == whole and all(len(x) > 3 for x in whole)


class _State:
    """A state variable as the processor sees it, in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class _Handle:
    def getListState(self, name, schema):
        return _State()

    getValueState = getListState


def test_a_large_micro_batch_passes_through(monkeypatch):
    monkeypatch.setattr(live, "WAITING", 100)
    p = live._Settled(50, None)
    p.init(_Handle())
    t = np.random.default_rng(1).permutation(100) + 100 * np.arange(60)[:, None]
    batches = [pd.DataFrame({"t": x, "value": x / 2.0}) for x in t]
    out = list(p.handleInputRows(("a",), iter(batches), None))
    assert max(map(len, out)) <= 400  # not all 6,000 rows at once
    rows = pd.concat([x for x in out if x["kind"].iloc[0] == "row"])
    assert sorted(rows["t"]) == [x for x in range(6000) if x <= 5999 - 50] and len(p.held.get()) == 50
    assert p.last.get() == (5949, 5949 / 2)
    again = list(p.handleInputRows(("a",), iter([pd.DataFrame({"t": [5949, 5949, 3], "value": [5949 / 2, 0.0, 1.0]})]), None))
    assert [(x["kind"].iloc[0], list(x["t"])) for x in again] == [("late", [5949, 3]), ("row", [5949]), ("last", [5949])]


def test_trimmed_values_are_dealt(spark):
    r = random.Random(5)
    values = {"wide": [r.gauss(1e6, 3.0) for _ in range(4000)], "few": [float(k % 3) for k in range(50)], "short": [1.0] * 9}
    df = spark.createDataFrame([(s, i, v) for s, x in values.items() for i, v in enumerate(x)], READINGS)
    bounds = clean.trim_bounds(df, ["sensor"], "value", 5, 2)
    got = {x["sensor"]: (x["low"], x["high"]) for x in bounds.collect()}
    assert got.pop("short") == (None, None)
    for s, (low, high) in got.items():
        x = sorted(values[s])
        x = x[math.floor(len(x) * 0.025) : math.floor(len(x) - len(x) * 0.025)]
        assert (low, high) == pytest.approx((x[0] - 2 * np.std(x), x[-1] + 2 * np.std(x)), rel=1e-9)
    # no window over all values of a sensor
    plan = bounds._jdf.queryExecution().optimizedPlan().toString()
    assert all("_v#" not in line or "_range#" in line for line in plan.splitlines() if "Window [" in line)
