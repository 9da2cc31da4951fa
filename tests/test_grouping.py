"""Clustering by rounds over tables, against clustering of one matrix in memory and brute force."""

import itertools

import local_clustering as local
import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.operators import clusters, grouping


def table(spark, d):
    names = [f"s{i:04d}" for i in range(len(d))]
    pairs = [(names[i], names[j], float(d[i, j])) for i in range(len(d)) for j in range(len(d)) if i != j]
    return names, spark.createDataFrame(pairs, "a string, b string, d double"), spark.createDataFrame([(n,) for n in names], "sensor string")


def places(n, seed, ties=True):
    r = np.random.default_rng(seed)
    p = np.concatenate([r.normal(c, 0.5, size=(-(-n // 3), 3)) for c in (0, 3, 6)])[:n]
    p = np.round(p, 1) if ties else p
    p[3] = p[2]  # two alike
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    return p, d / d.max() * 1.9


def exemplars(df):
    return {r["sensor"]: r["exemplar"] for r in df.collect()}


@pytest.mark.parametrize("n, seed", [(12, 1), (60, 2)])
def test_affinity_equals_local(spark, n, seed, monkeypatch):
    monkeypatch.setattr(grouping, "PAIRS_PER_TASK", 500)
    _, d = places(n, seed)
    names, pairs, sensors = table(spark, d)
    want = local.affinity_exemplars(d.copy())
    got = grouping.affinity(pairs.select("a", "b", (2 - F.col("d")).alias("s")), sensors)
    assert exemplars(got) == {names[i]: names[e] for i, e in enumerate(want)} and len(set(want)) > 1
    assert {r["sensor"] for r in got.filter("is_exemplar").collect()} == {names[e] for e in want}


def test_affinity_of_300(spark):
    _, d = places(300, 3)
    names, pairs, sensors = table(spark, d)
    want = local.affinity_exemplars(d.copy())
    assert exemplars(clusters.cluster(pairs.filter("a < b"), sensors)) == {names[i]: names[e] for i, e in enumerate(want)}


def test_affinity_of_sparse_pairs(spark):
    # groups of ten that know only each other, and points that know nobody
    r = np.random.default_rng(4)
    rows, groups = [], 400
    for g in range(groups):
        x = r.normal(0, 0.1, 10)
        rows += [(f"g{g:03d}-{i}", f"g{g:03d}-{j}", float(abs(x[i] - x[j]))) for i, j in itertools.combinations(range(10), 2)]
    d = spark.createDataFrame(rows, "a string, b string, d double")
    sensors = d.select(F.col("a").alias("sensor")).union(d.select("b")).union(spark.createDataFrame([("alone",), ("lonely",)], "sensor string"))
    found = exemplars(clusters.cluster(d, sensors, sparse=True))
    assert len(found) == 10 * groups + 2 and found["alone"] == "alone"
    assert all(e.split("-")[0] == s.split("-")[0] and found[e] == e for s, e in found.items())
    assert len(set(found.values())) < 4 * groups


def test_few_points(spark):
    none = spark.createDataFrame([], "a string, b string, d double")
    for names in ([], ["a"], ["a", "b"]):
        sensors = spark.createDataFrame([(x,) for x in names], "sensor string")
        for method in ("affinity", "pack"):
            found = exemplars(clusters.cluster(none, sensors, method))
            assert set(found) == set(names) and set(found.values()) <= set(names)
        assert grouping.affinity(none.withColumnRenamed("d", "s"), sensors).filter("not is_exemplar").isEmpty()
        assert grouping.kmeans(none.select(F.col("a").alias("sensor"), F.col("b").alias("slot"), F.col("d").alias("value")), 3).isEmpty()
        assert grouping.ward(none.withColumnRenamed("d", "c"), sensors).isEmpty()


@pytest.mark.parametrize("low, high", [(0.2, 0.9), (0.1, 0.3), (0.45, 1.3), (5.0, 6.0), (0.0, 0.0)])
def test_packs_equal_local(spark, low, high, monkeypatch):
    monkeypatch.setattr(grouping, "PAIRS_PER_TASK", 300)
    _, d = places(36, 5)
    names, pairs, sensors = table(spark, d)
    want = local.pack_exemplars(d, low, high)
    assert exemplars(grouping.packs(pairs, sensors, low, high)) == {names[i]: names[e] for i, e in enumerate(want)}


def partition(label):
    groups = {}
    for k, v in label.items():
        groups.setdefault(v, set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_ward_equals_brute_force(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(14, 4)), 2)
    names, pairs, sensors = table(spark, ((x[:, None] - x[None]) ** 2).sum(2) / 2)
    merges = grouping.ward(pairs.filter("a < b").withColumnRenamed("d", "c"), sensors)
    error = lambda rows: ((x[rows] - x[rows].mean(0)) ** 2).sum()
    groups, heights = [[i] for i in range(14)], []
    wanted = {}
    while len(groups) > 1:
        cost = lambda g: error(g[0] + g[1]) - error(g[0]) - error(g[1])
        a, b = min(itertools.combinations(groups, 2), key=cost)
        heights.append(cost((a, b)))
        groups = [g for g in groups if g not in (a, b)] + [a + b]
        wanted[len(groups)] = {frozenset(names[i] for i in g) for g in groups}
    told = sorted(tuple(m) for m in merges.select("step", "height", "size").collect())
    assert [h for _, h, _ in told] == pytest.approx(heights) and told[-1][2] == 14
    label = grouping.ward_groups(merges, sensors, list(range(1, 15))).collect()
    for k in range(1, 14):
        got = partition({y["sensor"]: y["label"] for y in label if y["k"] == k})
        assert got == wanted[k] == {frozenset(np.array(names)[local.ward_labels(x, 1)[k] == v]) for v in np.unique(local.ward_labels(x, 1)[k])}
    assert partition({y["sensor"]: y["label"] for y in label if y["k"] == 14}) == {frozenset([n]) for n in names}


def test_ward_with_ties(spark):
    x = np.array([[0.0], [1], [2], [3], [10], [11], [10], [30]])
    names, pairs, sensors = table(spark, ((x[:, None] - x[None]) ** 2).sum(2) / 2)
    merges = grouping.ward(pairs.filter("a < b").withColumnRenamed("d", "c"), sensors)
    assert [m["height"] for m in merges.orderBy("step").collect()][0] == 0 and merges.count() == 7
    label = {y["sensor"]: y["label"] for y in grouping.ward_groups(merges, sensors, [3]).collect()}
    assert partition(label) == {frozenset(names[:4]), frozenset(names[4:7]), frozenset(names[7:])}


def test_kmeans_equals_local(spark):
    p, _ = places(30, 6, ties=False)
    names = [f"s{i:04d}" for i in range(30)]
    f = spark.createDataFrame([(n, j, float(v)) for n, row in zip(names, p) for j, v in enumerate(row)], "sensor string, slot int, value double")
    got = grouping.kmeans(f, 5).collect()
    for k in range(2, 6):
        assert [y["label"] for y in sorted((y for y in got if y["k"] == k), key=lambda y: y["sensor"])] == local.kmeans_labels(p, k).tolist()
    equal = spark.createDataFrame([(n, j, 1.0) for n in names[:4] for j in range(2)], "sensor string, slot int, value double")
    assert {y["label"] for y in grouping.kmeans(equal, 3).collect()} == {0}


def test_order_statistics(spark):
    r = np.random.default_rng(7)
    for v in (r.normal(size=5000), np.append(np.repeat(2.0, 999), 1e12), np.array([3.0]), np.exp(r.normal(0, 20, 3000))):
        df = spark.createDataFrame([(float(x),) for x in v], "v double")
        ranks = [0, len(v) // 3, len(v) // 2, len(v) - 1]
        for wide in (4096, 16):
            assert grouping.order_statistics(df, "v", ranks, wide) == np.sort(v)[ranks].tolist()


def test_quality_from_own_exemplars(spark):
    """`cluster_quality` and `compare_clusterings` of given clusters against SQL over the same rows."""
    import duckdb

    _, d = places(15, 8)
    names, pairs, sensors = table(spark, d)
    dist = pairs.filter("a < b")
    r = np.random.default_rng(9)
    rows = []
    for method, k in (("x", 3), ("y", 5)):
        label = r.integers(0, k, 15)
        first = {v: int(np.flatnonzero(label == v)[0]) for v in set(label.tolist())}
        rows += [(method, k, names[i], names[first[int(v)]], first[int(v)] == i) for i, v in enumerate(label)]
    found = spark.createDataFrame(rows, "method string, k int, sensor string, exemplar string, is_exemplar boolean")
    con = duckdb.connect()
    con.register("d", dist.toPandas())
    con.register("f", found.toPandas())
    want = con.execute("""SELECT x.method, x.k, min(d) FILTER (x.exemplar = y.exemplar), avg(d) FILTER (x.exemplar = y.exemplar), max(d) FILTER (x.exemplar = y.exemplar), min(d) FILTER (x.exemplar <> y.exemplar),
      avg(d) FILTER (x.exemplar = y.exemplar) / nullif(min(d) FILTER (x.exemplar <> y.exemplar), 0), count(*) FILTER (x.exemplar = y.exemplar AND d > 1.0), count(*) FILTER (x.is_exemplar AND y.is_exemplar AND d < 0.5)
      FROM d JOIN f x ON x.sensor = d.a JOIN f y ON y.sensor = d.b AND y.method = x.method AND y.k = x.k GROUP BY ALL ORDER BY 1""").fetchall()
    columns = ("method", "k", "intra_min", "intra_avg", "intra_max", "inter_min", "validity", "intra_violations", "inter_violations")
    got = sorted(tuple(x[c] for c in columns) for x in clusters.compare_clusterings(dist, found, 0.5, 1.0).collect())
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:])
    one = clusters.cluster_quality(dist, found.filter("method = 'x'")).first()
    assert tuple(one[c] for c in columns[2:7]) == pytest.approx(want[0][2:7]) and one["n_clusters"] == len({x[3] for x in rows if x[0] == "x"})
    wrong = clusters.constraint_violations(dist, found.filter("method = 'x'"), 0.5, 1.0).first()
    assert tuple(wrong) == want[0][7:]
