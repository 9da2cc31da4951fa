"""The tree of statistical windows against windows and ranges counted from the rows, before and after changes."""

import random

import pytest
from pyspark.sql import functions as F

from tsengine.operators import features
from tsengine.streaming import pyramid, versions

BASE, TOP = 4, 9


@pytest.fixture(scope="module")
def streams(spark):
    r = random.Random(1)
    rows = [(u, t, float(r.randint(0, 50)), 1, False) for u, n in (("hot", 400), ("cold", 30)) for t in r.sample(range(-300, 1500), n)]
    known = [x[:2] for x in rows]
    more = [(*r.choice(known), 99.0, 2, False) for _ in range(5)] + [(*r.choice(known), None, 2, True) for _ in range(8)] + [("hot", 5000, 1.0, 2, False), ("new", 7, 2.0, 2, False)]
    more = list({x[:2]: x for x in more}.values())
    lonely = [("gone", 640, 1.0, 1, False), ("gone", 640, None, 2, True)]
    return spark.createDataFrame(rows + more + lonely, "uuid string, time_ns long, value double, version long, deleted boolean")


def close(df, *keys):
    return {tuple(r[k] for k in keys): (r["count"], r["min"], round(r["mean"], 9), r["max"]) for r in df.collect()}


def test_windows_of_stores(streams):
    first = pyramid.build(streams, 1, BASE, TOP)
    more = pyramid.updated(first, streams, 1, 2, BASE, TOP)
    assert more.count() < first.count() / 2
    for store, version in ((first, 1), (first.unionByName(more), 2), (pyramid.build(streams, 2, BASE, TOP), 2)):
        rows = versions.snapshot(streams, version)
        for power in (BASE, BASE + 1, 7, TOP):
            for start, end in ((-300, 1500), (-5, 333), (100, 100), (17, 5200)):
                assert close(pyramid.windows(store, start, end, power), "uuid", "time") == close(features.statistical_windows(rows, start, end, power), "uuid", "time")
    whole, step = pyramid.current(pyramid.build(streams, 2, BASE, TOP)), pyramid.current(first.unionByName(more))
    assert sorted(map(tuple, whole.select(pyramid.NODE).collect())) == sorted(map(tuple, step.select(pyramid.NODE).collect()))


def test_ranges(spark, streams):
    r = random.Random(2)
    asked = [(k, u, *sorted(r.sample(range(-320, 1600), 2))) for k, u in enumerate(["hot", "cold", "none"] * 40)]
    asked += [(200, "hot", 10, 10), (201, "hot", 33, 34), (202, "hot", 16, 32), (203, "hot", -1000, 6000), (204, "hot", 31, 33), (205, "hot", 40, 30)]
    ranges = spark.createDataFrame(asked, "range int, uuid string, start_ns long, end_ns long")
    store, rows = pyramid.build(streams, 1, BASE, TOP), versions.snapshot(streams, 1)
    got = close(pyramid.range_statistics(store, rows, ranges, BASE, TOP), "range", "uuid")
    known = [tuple(x) for x in rows.collect()]
    want = {}
    for k, u, a, b in asked:
        v = [x for n, t, x in known if n == u and a <= t < b]
        if v:
            want[k, u] = (len(v), min(v), round(sum(v) / len(v), 9), max(v))
    assert got == want
    read = {x["range"]: x["n"] for x in pyramid.edge_rows(rows, ranges, BASE).groupBy("range").agg(F.count("*").alias("n")).collect()}
    inside = lambda u, lo, hi: sum(n == u and lo <= t < hi for n, t, _ in known)
    for k, u, a, b in asked:  # no more than the rows of the two leaves at the ends
        ends = inside(u, a, min(b, (a // 16 + 1) * 16)) + inside(u, max(a, b // 16 * 16), b)
        assert read.get(k, 0) <= max(ends, 0)
    assert 202 not in read and read.get(203, 0) == 0
    nodes = {x["range"]: x["n"] for x in pyramid.whole_nodes(ranges.filter("range < 200"), BASE, TOP).groupBy("range").agg(F.count("*").alias("n")).collect()}
    assert max(nodes.values()) <= 2 * (TOP - BASE) + (1920 >> TOP) + 1


def test_nothing(spark):
    empty = spark.createDataFrame([], "uuid string, time_ns long, value double, version long, deleted boolean")
    store = pyramid.build(empty, 1, BASE, TOP)
    assert store.isEmpty() and pyramid.updated(store, empty, 1, 2, BASE, TOP).isEmpty()
