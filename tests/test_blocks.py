"""Rolling statistics and grids in blocks of rows: the same as over whole sensors, whatever the size of a block."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.operators import clean, ordered


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [("hot", i, float(r.randint(0, 3))) for i in range(200)] + [("a", 3 * i, float(i % 2)) for i in range(9)] + [("b", 5, 1.0), ("c", 1, 0.0), ("c", 2, 1.0)]


@pytest.mark.parametrize("size", [7, 50_000])
@pytest.mark.parametrize("width", [1, 4, 5])
def test_rolling(spark, rows, size, width, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", size)
    df = spark.createDataFrame(rows, "sensor string, t long, value double").withColumn("other", F.lit(1))
    by = {}
    for s, t, v in sorted(rows):
        by.setdefault(s, []).append((t, v))
    k = (width if width % 2 else width + 1) // 2
    mean, mode, past = {}, {}, {}
    for s, x in by.items():
        v = [b for _, b in x]
        for i, (t, _) in enumerate(x):
            j = min(max(i, min(k, len(v) - 1)), max(len(v) - 1 - k, 0)) if not (i < k) else min(k, len(v) - 1)
            w = v[max(0, j - k) : j + k + 1]
            mean[s, t] = sum(w) / len(w)
            mode[s, t] = min(set(w), key=lambda y: (-w.count(y), y))
            past[s, t] = statistics.mean(v[:width]) if i < width else statistics.mean(v[i - width : i])
    found = lambda out, c: {(r["sensor"], r["t"]): r[c] for r in out.select("sensor", "t", "other", c).collect()}
    assert found(ordered.rolling_binary_mean(df, ["sensor"], ["t"], width), "rolling_mean") == pytest.approx(mean)
    assert found(ordered.rolling_mode(df, ["sensor"], ["t"], width), "rolling_mode") == mode
    assert found(ordered.moving_average_before(df, ["sensor"], ["t"], width), "avg_before") == pytest.approx(past)


def test_places(spark, rows):
    df = spark.createDataFrame([*rows, *rows[:5]], "sensor string, t long, value double").repartition(3)
    by = {}
    for r in ordered.with_place(df, ["sensor"], ["t"]).collect():
        by.setdefault(r["sensor"], []).append((r["_place"], r["t"], r["_n"]))
    for x in by.values():
        x.sort()
        assert [p for p, _, _ in x] == list(range(1, len(x) + 1)) and {n for *_, n in x} == {len(x)}
        assert [t for _, t, _ in x] == sorted(t for _, t, _ in x)
    assert ordered.with_place(df.limit(0), ["sensor"], ["t"]).isEmpty()


@pytest.mark.parametrize("block", [3, 4096])
def test_stepped(spark, block):
    spans = spark.createDataFrame([("a", 0, 10, 1), ("b", -7, 20, 4), ("c", 5, 5, 9), ("d", 5, 4, 1)], "sensor string, a long, b long, s long")
    got = {}
    for r in clean.stepped(spans, F.col("a"), F.col("b"), F.col("s"), block).collect():
        got.setdefault(r["sensor"], []).append(r["t"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(11)), "b": list(range(-7, 21, 4)), "c": [5]}


def test_kalman_of_many_chunks(spark):
    r = np.random.default_rng(1)
    v = np.cumsum(r.normal(size=3000))
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 1, 2.0)], "sensor string, t long, value double")
    whole = {(x["sensor"], x["t"]): x["smoothed"] for x in clean.kalman(df, 0.1, 1.0, rows=10**6).collect()}
    parts = {(x["sensor"], x["t"]): x["smoothed"] for x in clean.kalman(df, 0.1, 1.0, rows=20).collect()}
    assert len(whole) == 3001 and parts == pytest.approx(whole)
