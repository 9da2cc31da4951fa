"""Output stores: slices replaced by run, several inputs and outputs, runs that are cut off."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tsengine.streaming import schedule, store

STREAM = "uuid string, time_ns long, value double, version long, deleted boolean"
SLICE = 1 << store.POWER


def add(spark, path, *rows):
    spark.createDataFrame([(u, t, v, n, v is None) for u, t, v, n in rows], STREAM).write.mode("append").parquet(path)


def total(scale: float = 1.0):
    """Two outputs: the sum of both inputs by time, and the first input scaled."""

    def compute(rows, ranges):
        both = rows["left"].union(rows["right"]).groupBy("time_ns").agg(F.sum("value").alias("value"))
        return {"sum": both.select(F.lit("sum").alias("uuid"), "time_ns", "value"), "scaled": rows["left"].withColumn("value", F.col("value") * scale)}

    return compute


def broken():
    def compute(rows, ranges):
        raise ValueError("no")

    return compute


def rows_of(spark, folder):
    return sorted(tuple(r) for r in store.latest(spark, folder).collect())


def written(folder):
    return sorted("/".join(p.split("/")[-2:]) for p in glob.glob(f"{folder}/data/run=*/slice=*"))


@pytest.fixture
def config(spark, tmp_path):
    p = {k: f"{tmp_path}/{k}" for k in ("left", "right", "sum", "scaled")}
    add(spark, p["left"], ("a", 5, 1.0, 1), ("a", SLICE + 5, 2.0, 1), ("a", 3 * SLICE, 3.0, 1))
    add(spark, p["right"], ("b", 5, 10.0, 1), ("b", 3 * SLICE, 30.0, 1))
    section = {"deps": {k: p[k] for k in ("left", "right")}, "outputs": {k: p[k] for k in ("sum", "scaled")}, "params": {"scale": 2.0}, "paramver": "1", "mintime": "1970-01-01", "maxtime": "2030-01-01T00:00:00"}
    return {"global": {"enabled": "true", "algorithm": f"{__name__}.total"}, "both": section}, p


def test_several_inputs_and_outputs(spark, config):
    c, p = config
    assert schedule.run(spark, c) == schedule.DONE
    assert rows_of(spark, p["sum"]) == [("sum", 5, 11.0), ("sum", SLICE + 5, 2.0), ("sum", 3 * SLICE, 33.0)]
    assert rows_of(spark, p["scaled"]) == [("a", 5, 2.0), ("a", SLICE + 5, 4.0), ("a", 3 * SLICE, 6.0)]
    assert schedule.run(spark, c) == schedule.NO_CHANGE
    add(spark, p["right"], ("b", SLICE + 5, 20.0, 2))  # only the second slice changes
    assert schedule.run(spark, c) == schedule.DONE
    assert rows_of(spark, p["sum"]) == [("sum", 5, 11.0), ("sum", SLICE + 5, 22.0), ("sum", 3 * SLICE, 33.0)]
    assert written(p["sum"]) == ["run=0/slice=0", "run=0/slice=1", "run=0/slice=3", "run=1/slice=1"]
    add(spark, p["left"], ("a", SLICE + 5, None, 3))
    add(spark, p["right"], ("b", SLICE + 5, None, 3))
    assert schedule.run(spark, c) == schedule.DONE  # a slice that loses all its rows
    assert rows_of(spark, p["sum"]) == [("sum", 5, 11.0), ("sum", 3 * SLICE, 33.0)]
    assert "run=0/slice=1" not in written(p["sum"])  # replaced twice
    c["both"]["params"] = {"scale": 3.0}
    assert schedule.run(spark, c) == schedule.DONE
    assert rows_of(spark, p["scaled"]) == [("a", 5, 3.0), ("a", 3 * SLICE, 9.0)]
    assert schedule.run(spark, {**c, "both": {**c["both"], "deps": {}}}) == schedule.BAD_CONFIG
    assert schedule.run(spark, {**c, "global": {"enabled": "true", "algorithm": f"{__name__}.broken"}, "both": {**c["both"], "params": {}}}) == schedule.FAILED


def test_a_run_that_is_cut_off(spark, config, monkeypatch):
    c, p = config
    assert schedule.run(spark, c) == schedule.DONE
    before = rows_of(spark, p["sum"]), rows_of(spark, p["scaled"])
    add(spark, p["left"], ("a", 5, 100.0, 2))
    real = store.replace

    def second_output_fails(spark, folder, *rest, **named):
        if os.path.basename(folder) == "scaled":
            raise OSError("lost")
        return real(spark, folder, *rest, **named)

    monkeypatch.setattr(store, "replace", second_output_fails)
    assert schedule.run(spark, c) == schedule.FAILED
    assert rows_of(spark, p["scaled"]) == before[1]
    monkeypatch.setattr(store, "replace", real)
    # data without a control row doesn't count either
    spark.createDataFrame([("x", 5, 1.0, 0)], "uuid string, time_ns long, value double, slice long").write.partitionBy("slice").parquet(f"{p['scaled']}/data/run=1")
    assert rows_of(spark, p["scaled"]) == before[1]
    assert schedule.run(spark, c) == schedule.DONE
    assert rows_of(spark, p["sum"])[0] == ("sum", 5, 110.0) and rows_of(spark, p["scaled"])[0] == ("a", 5, 200.0)
    assert schedule.run(spark, c) == schedule.NO_CHANGE
