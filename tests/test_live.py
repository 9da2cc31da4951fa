"""Stateful streams: readings that arrive out of order give the rows of the batch query."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tsengine.streaming import live, versions

SCHEMA = "sensor string, t long, value double"


def key(r):
    return tuple((v is not None, v) for v in r)


def table(df):
    return sorted((tuple(r[c] for c in ("sensor", "t", "value", "diff", "gap", "event")) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def arrived():
    """Readings of a hot and three small sensors in order of arrival: most a little late, some very late; equal times and repeats."""
    r = random.Random(4)
    rows = [("hot", 10 * i + r.choice([0, 0, 5]), float(r.randint(0, 9))) for i in range(300)] + [(f"s{k}", 7 * i, float(i % 5)) for k in range(3) for i in range(30)]
    rows += [("hot", 500, 3.0), ("hot", 500, 1.0), ("hot", 500, 3.0), ("once", 1, 1.0)]
    return sorted(rows, key=lambda x: x[1] + r.random() * 60 + (700 if r.random() < 0.03 else 0))


@pytest.mark.parametrize("files", [1, 6])
def test_replay_equals_batch(spark, tmp_path, arrived, files):
    source, rows, late, state = (f"{tmp_path}/{x}" for x in ("in", "rows", "late", "state"))
    for k in range(files):
        part = arrived[len(arrived) * k // files : len(arrived) * (k + 1) // files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = live.write_live(live.live_differences(stream, 50, 4.0), rows, late, state)
    assert query.awaitTermination(200) and query.exception() is None
    told, after = spark.read.parquet(rows), spark.read.parquet(late)
    want = table(live.differences(spark.createDataFrame(arrived, SCHEMA), 4.0))
    held = live.waiting(spark, state)
    assert told.count() + after.count() + held.count() == len(arrived) and held.count() > 3
    assert (after.count() > 0) == (files > 1)
    if files == 1:  # all came at once: what was told is final
        assert set(table(told)) <= set(want)
    more = after.select(F.col("uuid").alias("sensor"), (F.col("time_ns") / 1000).cast("long").alias("t"), "value").union(held)
    assert table(live.corrected(told, more, 4.0)) == want
    # late rows are versions of the stream: the ranges to compute again follow from them
    if files > 1:
        ranges = versions.changed_ranges(after, 0, 10**6, 0)
        assert {r["uuid"] for r in ranges.collect()} == {r["uuid"] for r in after.select("uuid").distinct().collect()}


def test_idle_sensor_is_told(spark, tmp_path):
    source, rows, late, state = (f"{tmp_path}/{x}" for x in ("in", "rows", "late", "state"))
    spark.createDataFrame([("a", 1, 1.0), ("a", 3, 9.0), ("a", 2, 1.5)], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = live.write_live(live.live_differences(stream, 10**9, 4.0, idle_ms=200), rows, late, state, processingTime="300 milliseconds")
    told = []
    for _ in range(120):
        time.sleep(0.5)
        try:
            told = table(spark.read.schema("sensor string, t long, value double, diff double, gap long, event int").parquet(rows))
        except Exception:  # nothing written yet
            continue
        if told:
            break
    query.stop()
    assert told == [("a", 1, 1.0, None, None, 0), ("a", 2, 1.5, 0.5, 1, 0), ("a", 3, 9.0, 7.5, 1, 1)]
