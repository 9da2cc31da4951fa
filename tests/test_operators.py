"""Small cases worked out by hand, and comparisons with plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.functions import scalar
from tsengine.model import DAY, INT_TYPE, MINUTE, SECOND
from tsengine.operators import align, clean, clusters, features, likelihood, networks, ordered, states, weather
from tsengine.sources import files
from tsengine.streaming import schedule, versions


def series(spark, values, sensor="a", step=1):
    return spark.createDataFrame([(sensor, i * step, None if v is None else float(v)) for i, v in enumerate(values)], "sensor string, t long, value double")


def slots(spark, values):
    return spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], "sensor string, slot long, value double")


def column(df, order, name):
    return [r[name] for r in df.orderBy(order).collect()]


WIDE = [(1, 1, 0), (1, 1, 0), (0, 1, 0), (1, 1, 1), (0, 1, 0), (1, 0, 0), (0, 0, 0), (0, 1, 0)]


def test_probabilities(spark):
    w = spark.createDataFrame(WIDE, "c0 int, c1 int, c2 int")
    assert likelihood.joint_probability(w, {"c0": [0, 1], "c1": [0]}).first()[0] == 0.25
    assert likelihood.conditional_probability(w, {"c0": [1]}, {"c1": [1]}).first()[0] == 0.5
    assert likelihood.conditional_probability(w, {"c0": [1]}, {"c1": [7]}).first()[0] == 0
    assert dict(likelihood.effect_probability(w, "c0", {"c1": [1]}).collect()) == {0: 0.5, 1: 0.5}
    assert dict(likelihood.cause_likelihood(w, ["c0"], "c1", [1]).collect()) == {0: 0.75, 1: 0.75}
    both = {tuple(r)[:2]: r[2] for r in likelihood.cause_likelihood(w, ["c0", "c2"], "c1", [1]).collect()}
    assert both[0, 1] == 0 and both[1, 1] == 1
    assert likelihood.joint_probability(w.limit(0), {"c0": [1]}).first()[0] is None


@pytest.mark.parametrize("n, levels, kind", [(1001, 9, 0), (500, 5, 1), (505, 5, 0)])
def test_types(spark, n, levels, kind):
    assert clean.infer_types(series(spark, [i % levels for i in range(n)])).first()["num_type"] == kind


def test_type_of_nothing(spark):
    assert clean.infer_types(series(spark, [None, None])).first()["num_type"] is None


def test_trim_positions(spark):
    b = clean.trim_bounds(series(spark, range(1000)), ["sensor"], "value", 1, 0).first()
    assert (b["low"], b["high"]) == (5, 994)
    assert clean.trim_bounds(series(spark, range(10)), ["sensor"], "value", 1, 1).first()["low"] is None


def test_outliers_like_numpy(spark):
    r = np.random.default_rng(3)
    v = np.round(np.concatenate([r.normal(0, 1, 400), [40, -50]]), 2)
    marked = clean.mark_outliers(series(spark, v), percent=1, sigmas=20).filter("outlier")
    rest = np.sort(v)[int(len(v) * 0.5 / 100) : int(len(v) - len(v) * 0.5 / 100)]
    want = [x for x in v if x > rest.max() + 20 * rest.std() or x < rest.min() - 20 * rest.std()]
    assert sorted(x["value"] for x in marked.collect()) == sorted(want) and want


def test_gaps(spark):
    fill = lambda v, gap, near=False: column(clean.fill_gaps(slots(spark, v), gap, nearest=near), "slot", "filled")
    n = None
    assert fill([n, n, 3, n, 5, n, n], 4) == [n, 3, 3, 4, 5, 5, n]
    assert fill([1, n, n, n, 5], 2) == [1, n, n, n, 5]
    assert fill([1, n, n, n, 5], 3) == [1, 2, 3, 4, 5]
    assert fill([1, n, n, n, 5], 3, True) == [1, 1, 1, 5, 5]
    assert fill([n, n, n], 3) == [n, n, n]


def test_columns_equal_the_single_steps(spark):
    r = np.random.default_rng(8)
    rows = [(n, i, None if r.random() < 0.1 else float(v)) for n in ("a", "b", "c") for i, v in enumerate(np.round(r.normal(0, 1, 60), 2))]
    rows = [(n, i, 500.0 if (n, i) == ("b", 30) else v) for n, i, v in rows] + [("d", i, 1.0 if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "sensor string, slot long, value double")
    no = F.lit(False)
    got = clean.clean_columns(df, 3, no, no)
    marked = clean.mark_outliers(df).withColumn("value", F.when(~F.col("outlier"), F.col("value"))).drop("outlier")
    filled = clean.fill_gaps(marked, 3)
    kept = filled.join(clean.too_many_missing(filled).filter("not excluded"), "sensor", "left_semi").select("sensor", "slot", F.col("filled").alias("value"))
    want = clean.normalise(kept).select("sensor", "slot", F.col("normalised").alias("value"))
    assert {(x["sensor"], x["slot"]): x["value"] and round(x["value"], 9) for x in got.collect()} == {(x["sensor"], x["slot"]): x["value"] and round(x["value"], 9) for x in want.filter("sensor <> 'd'").collect()}
    assert got.filter("sensor = 'd'").count() == 0


def test_nearest_and_linear(spark):
    points = spark.createDataFrame([("a", 0, 1.0), ("a", 100, 2.0), ("a", 200, 3.0)], "sensor string, t long, value double")
    asked = spark.createDataFrame([("a", t) for t in (50, 51, 150, 990)], "sensor string, t long")
    assert column(ordered.nearest_interpolation(points, asked), "t", "value") == [1, 2, 2, 3]
    points = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0), ("a", 20, 30.0)], "sensor string, t long, value double")
    asked = spark.createDataFrame([("a", t) for t in (-10, 5, 15, 30)], "sensor string, t long")
    assert column(ordered.linear_interpolation(points, asked), "t", "value") == [-10, 5, 20, 50]


@pytest.mark.parametrize("q, noise", [(0.1, 1.0), (0.0, 2.0)])
def test_kalman_in_chunks(spark, q, noise):
    r = np.random.default_rng(8)
    rows = [(s, int(t), float(v)) for s, n in (("a", 900), ("b", 1)) for t, v in zip(r.integers(0, 3000, n), r.normal(0, 5, n))]
    df = spark.createDataFrame(rows, "sensor string, t long, value double")
    out = clean.kalman(df, q, noise, rows=40)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = [(x["sensor"], x["t"], x["value"], x["smoothed"]) for x in out.collect()]
    want = []
    for s in "ab":
        x, p = None, 1.0
        for t, v in sorted((t, v) for z, t, v in rows if z == s):
            if x is None:
                x = v
            else:
                p += q
                k = p / (p + noise)
                x, p = x + k * (v - x), (1 - k) * p
            want.append((s, t, v, x))
    assert len(got) == len(want)
    for a, b in zip(sorted(got), want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-9)


def test_chunked_previous_equals_plain(spark):
    r = np.random.default_rng(5)
    rows = [(s, int(t), float(i)) for i, (s, t) in enumerate(zip(r.choice(["a", "b"], 400), r.integers(0, 100_000, 400)))]
    df = spark.createDataFrame(rows, "sensor string, t long, value double")
    got = {(x["sensor"], x["t"], x["value"]): x["prev_value"] for x in ordered.with_previous(df, ["sensor"], ["value"], ["t", "value"], chunk=7000).collect()}
    for s in "ab":
        mine = sorted((t, v) for x, t, v in rows if x == s)
        for before, now in zip([(None, None), *mine], mine):
            assert got[s, now[0], now[1]] == before[1]


def test_neighbours_over_chunks(spark):
    points = spark.createDataFrame([("a", 5, 1.0), ("a", 1005, 2.0)], "sensor string, t long, value double")
    asked = spark.createDataFrame([("a", 500), ("a", 0), ("a", 5000), ("b", 1)], "sensor string, t long")
    got = {(x["sensor"], x["t"]): (x["before_value"], x["after_value"]) for x in ordered.neighbours(points, asked, chunk=100).collect()}
    assert got == {("a", 500): (1, 2), ("a", 0): (None, 1), ("a", 5000): (2, None), ("b", 1): (None, None)}


def test_kalman(spark):
    assert column(clean.kalman(series(spark, [1, 2]), 0, 1), "t", "smoothed") == [1, 1.5]
    y = [3.0, 1.0, 4.0, 1.0, 5.0]
    x, p, want = y[0], 1.0, [y[0]]
    for v in y[1:]:
        p += 0.2
        k = p / (p + 0.7)
        x, p = x + k * (v - x), (1 - k) * p
        want.append(x)
    assert column(clean.kalman(series(spark, y), 0.2, 0.7), "t", "smoothed") == pytest.approx(want)


def test_moving_average(spark):
    assert column(ordered.moving_average_before(series(spark, [1, 2, 3, 4]), ["sensor"], ["t"], 2), "t", "avg_before") == [1.5, 1.5, 1.5, 2.5]


def test_slot_difference(spark):
    s = series(spark, [1, 3, 2, 6]).withColumn("slot", F.lit(0))
    assert features.slot_difference(s).first()["value"] == 3


def test_mode_takes_smallest(spark):
    s = series(spark, [2, 2, 1, 1, 3]).withColumn("slot", F.lit(0))
    types = spark.createDataFrame([("a", INT_TYPE)], "sensor string, num_type int")
    assert features.slot_feature(s, types).first()["value"] == 1


def test_rolling_binary(spark):
    got = column(ordered.rolling_binary_mean(series(spark, [0, 1, 1, 0, 0]), ["sensor"], ["t"], 3), "t", "rolling_mean")
    assert got == pytest.approx([2 / 3, 2 / 3, 2 / 3, 1 / 3, 1 / 3])


def test_sensitivity_distances(spark):
    rows = [("x", "f1", 0)] * 2 + [("x", "f2", 0), ("x", "f2", 1)]
    df = spark.createDataFrame(rows, "name string, level string, state int")
    get = lambda d: likelihood.sensitivity(df, "level", d).first()["sensitivity"]
    assert get("h") == pytest.approx(0.2705980, abs=1e-6)
    assert get("b") == pytest.approx(0.1732868, abs=1e-6)
    assert get("v") == pytest.approx(0.25)


def test_knee_and_states(spark):
    assert states.knee([0, 10, 20, 24, 26, 28]) == 4
    f = slots(spark, [1, 1.1, 0.9, 5, 5.1, 4.9, 9, 9.1, 8.9])
    assert set(column(states.peak_states(f), "slot", "state")) <= {-1, 0, 1}
    assert set(column(states.peak_states(slots(spark, [2, 2, 2])), "slot", "state")) == {-1}


def test_exact_kmeans_is_best():
    r = np.random.default_rng(2)
    v = np.sort(np.unique(np.round(r.normal(0, 3, 9), 2)))
    w = r.integers(1, 4, len(v)).astype(float)

    def cost(starts):
        return sum((w[a:b] * (v[a:b] - np.average(v[a:b], weights=w[a:b])) ** 2).sum() for a, b in zip(starts, [*starts[1:], len(v)]))

    for k, cuts in enumerate(states.best_cuts(v, w, 4), 1):
        best = min(cost([0, *c]) for c in itertools.combinations(range(1, len(v)), k - 1))
        assert cost(list(cuts)) == pytest.approx(best)


def test_states_beside_a_far_outlier(spark, monkeypatch):
    r = np.random.default_rng(6)
    values = np.unique(np.concatenate([np.round(r.uniform(a, a + 1, 900), 4) for a in (0, 500)] + [[1e6]]))
    label, centres = states.discover(values, np.ones(len(values)), 6)
    assert len(centres) >= 3 and label[values < 10].max() < label[(values > 10) & (values < 1000)].min() and (label == label[-1]).sum() == 1
    df = slots(spark, values.tolist())
    for most in (states.MOST_LEVELS, 1024):  # as they are, and in levels
        monkeypatch.setattr(states, "MOST_LEVELS", most)
        got = {x["value"]: x["label"] for x in states.value_states(df, ["sensor"]).collect()}
        assert [got[v] for v in values.tolist()] == label.tolist()


def test_irregular_events_are_smoothed(spark):
    r = np.random.default_rng(9)
    t = np.cumsum(r.integers(1, 9, 3000)) * 1_000_000_000  # over several chunks of thirty days
    v = np.cumsum(np.where(r.random(3000) < 0.05, 100.0, 0.0) + np.round(r.random(3000), 2))
    v[1] = v[0] + 100  # the first row takes the second's label
    rows = [("many", int(a), float(b)) for a, b in zip(t, v)] + [("few", i, float(i % 30 == 7)) for i in range(900)] + [("once", i, float(i * i % 400)) for i in range(4)]
    df = spark.createDataFrame(rows, "sensor string, t long, value double")
    got = {}
    for x in states.irregular_events(df).collect():
        got.setdefault(x["sensor"], []).append((x["t"], x["event"]))
    raw = {}
    for x in states.raw_events(df).collect():
        raw.setdefault(x["sensor"], []).append((x["t"], x["event"]))
    assert sorted(got["few"]) == sorted(raw["few"]) == [(i, float(i % 30 == 7)) for i in range(900)]
    assert sorted(got["once"]) == sorted(raw["once"])
    label = np.array([e for _, e in sorted(raw["many"])], float)
    change = np.abs(np.diff(v))
    assert label.tolist() == (np.r_[change[0], change] > 50).astype(float).tolist()
    gap = np.diff(t[label == 1])
    width = int((gap.min() + (gap.mean() - gap.min()) * math.log(2)) / ((t[-1] - t[0]) / len(t)))
    width += width % 2 == 0
    body = np.convolve(label, np.ones(width), "valid") / width
    want = np.r_[np.full(width // 2, body[0]), body, np.full(width // 2, body[-1])]
    assert width > 3 and np.allclose([e for _, e in sorted(got["many"])], want)


def ranges(spark, rows):
    return spark.createDataFrame([("u", a, b) for a, b in rows], "uuid string, start_ns long, end_ns long")


def test_ranges(spark):
    m = lambda rows, **k: sorted((r["start_ns"], r["end_ns"]) for r in versions.merge_ranges(ranges(spark, rows), **k).collect())
    assert m([(0, 10), (5, 20)]) == [(0, 20)]
    assert m([(1, 2)]) == [(1, 2)] and m([(3, 3)]) == []
    assert m([(0, 1), (5, 6)], gap=4) == [(0, 6)]
    cut = versions.slices(ranges(spark, [(2**37 - 10, 2**37 + 5)])).collect()
    assert sorted((r["start_ns"], r["end_ns"]) for r in cut) == [(2**37 - 10, 2**37), (2**37, 2**37 + 5)]
    assert versions.clamp(ranges(spark, [(0, 10), (20, 30)]), 5, 20).collect()[0][1:] == (5, 10)


def test_replace_twice_is_once(spark):
    old = spark.createDataFrame([("u", t, float(t)) for t in range(10)], "uuid string, time_ns long, value double")
    new = spark.createDataFrame([("u", 3, 30.0)], old.schema)
    once = versions.replace_ranges(old, ranges(spark, [(2, 6)]), new)
    twice = versions.replace_ranges(once, ranges(spark, [(2, 6)]), new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == 7


def test_tombstones_give_the_replaced_view(spark):
    base = spark.createDataFrame([("u", t, float(t), 1, False) for t in range(6)], "uuid string, time_ns long, value double, version long, deleted boolean")
    new = spark.createDataFrame([("u", 2, 20.0)], "uuid string, time_ns long, value double")
    bounds = ranges(spark, [(1, 4)])
    more = versions.erase_then_insert(bounds, versions.snapshot(base, 1), new, 2)
    seen = versions.snapshot(base.union(more), 2)
    assert sorted(map(tuple, seen.collect())) == [("u", 0, 0.0), ("u", 2, 20.0), ("u", 4, 4.0), ("u", 5, 5.0)]
    assert versions.snapshot(base.union(more), 1).count() == 6


def test_density(spark):
    r = series(spark, [1, 1, 1], step=MINUTE)
    assert features.sampling_density(r, 0, 20 * MINUTE, 20 * MINUTE, 5 * MINUTE).first()["density"] == 0.75


def test_statistical_windows(spark):
    df = spark.createDataFrame([("u", t, float(v)) for t, v in [(0, 1), (3, 2), (4, 3), (7, 5)]], "uuid string, time_ns long, value double")
    got = sorted(tuple(r)[1:] for r in features.statistical_windows(df, 0, 8, 2).collect())
    assert got == [(0, 2, 1, 1.5, 2), (4, 2, 3, 4, 5)]


def test_bic_of_one_node(spark):
    s = networks.FamilyScores(spark.createDataFrame([(0,), (0,), (0,), (1,)], "x int"), ["x"])
    assert s.scores([("x", ())])[0] == pytest.approx(-2.942488, abs=1e-5)
    s.close()


def test_network_finds_a_chain(spark):
    r = np.random.default_rng(0)
    a = r.integers(0, 2, 600)
    b = np.where(r.random(600) < 0.9, a, 1 - a)
    c = np.where(r.random(600) < 0.9, b, 1 - b)
    w = spark.createDataFrame([tuple(map(int, x)) for x in zip(a, b, c)], "a int, b int, c int")
    edges, score = networks.hill_climb(w, ["a", "b", "c"])
    assert {frozenset(e) for e in edges} == {frozenset("ab"), frozenset("bc")}
    table = networks.edges_table(spark, "m", edges)
    assert networks.is_acyclic(table) and not networks.is_acyclic(networks.edges_table(spark, "m", [("a", "b"), ("b", "a")]))
    assert sum(r["degree"] for r in networks.degrees(table, spark.createDataFrame([("a",), ("b",), ("c",)], "node string")).collect()) == 4
    assert networks.explain_effect(w, "b", ["a", "c"]) == ["a", "c"]


def test_exponential_quantile(spark):
    g = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "sensor string, gap double")
    assert states.exponential_quantile(g, ["sensor"], 0.5).first()["quantile"] == pytest.approx(1 + math.log(2))


def test_names(spark):
    df = spark.createDataFrame([("GW2.CG-A/B 1",), ("1x",), ("0a1b2c3d-0000-1111-2222-333344445555",)], "n string")
    assert [r[0] for r in df.select(scalar.clean_name("n")).collect()] == ["GW2_CG_A_B_1", "a_1x", "0a1b2c3d_0000_1111_2222_333344445555"]
    back = df.filter("n like '0a%'").select(scalar.uuid_text(scalar.uuid_bytes("n"))).first()[0]
    assert back == "0a1b2c3d-0000-1111-2222-333344445555"


def test_times(spark):
    df = spark.createDataFrame([("1970-01-02 00:00:01.5",)], "s string")
    assert df.select(scalar.parse_time("s")).first()[0] == DAY + SECOND + 5
    assert df.select(scalar.parse_nanoseconds("s")).first()[0] == (DAY + SECOND) * 1000 + 500_000_000


def test_symbols(spark):
    df = spark.createDataFrame([(1, "Rain"), (2, ""), (3, "Fog"), (4, "Rain"), (5, None)], "i int, e string")
    assert dict(weather.symbol_codes(df, "e", "i").collect()) == {"Rain": 1, "": 0, "Fog": 2}


def test_clusters(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(2, 40))
    names = [f"s{i}" for i in range(6)]
    x = {n: base[i % 2] + r.normal(0, 0.05, 40) for i, n in enumerate(names)}
    f = spark.createDataFrame([(n, i, float(v)) for n, c in x.items() for i, v in enumerate(c)], "sensor string, slot long, value double")
    f = clean.normalise(f).select("sensor", "slot", F.col("normalised").alias("value"))
    d = clusters.distances(f)
    for method in ("affinity", "pack"):
        found = {r["sensor"]: r["exemplar"] for r in clusters.cluster(d, f, method).collect()}
        groups = {frozenset(k for k, v in found.items() if v == e) for e in found.values()}
        assert groups == {frozenset(names[::2]), frozenset(names[1::2])}, method


def test_assignment_bounds(spark):
    r = spark.createDataFrame([("a", 15 * MINUTE - SECOND, 1.0), ("a", 15 * MINUTE, 2.0), ("a", 30 * MINUTE, 3.0)], "sensor string, t long, value double")
    assert sorted(x["slot"] for x in align.assign_slots(r, 0, 30 * MINUTE, 15 * MINUTE).collect()) == [0, 1]


def test_empty_tables(spark):
    none = series(spark, [1]).limit(0)
    grid = align.slot_grid(spark, 0, 10, 1)
    assert clean.regularise(none).count() == 0
    assert clean.fill_gaps(align.with_all_slots(none.withColumn("slot", F.lit(0).cast("long")).drop("t"), grid), 1).count() == 0
    assert ordered.first_difference(none).count() == 0
    assert states.peak_states(none.withColumnRenamed("t", "slot")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("2024-01-01 00:00:00,1.5\nbroken\n2024-01-01 00:00:20,2.5\n")
    got = files.read_sensor_csv(spark, str(tmp_path / "s1.csv"))
    assert sorted((r["sensor"], r["value"]) for r in got.collect()) == [("s1", 1.5), ("s1", 2.5)]
    (tmp_path / "r.json").write_text('[{"uuid": "u", "Readings": [[1000, 2.0], [2000, null]]}]\n')
    assert [tuple(r) for r in files.read_readings_json(spark, str(tmp_path / "r.json")).collect()] == [("u", SECOND, 2.0)]
    (tmp_path / "q.txt").write_text("m 10 1.0 x\nm 10 3.0 x\nbad\n")
    assert [tuple(r) for r in files.read_query_text(spark, str(tmp_path / "q.txt")).collect()] == [("m", 10 * SECOND, 2.0)]
    (tmp_path / "w.csv").write_text("TemperatureC,Events,DateUTC\n1.5,N/A,2024-01-01 00:00:00\n")
    w = files.read_weather_csv(spark, str(tmp_path / "w.csv")).first()
    assert (w["TemperatureC"], w["Events"]) == ("1.5", None)
    (tmp_path / "m.json").write_text('{"uuid": "u1", "Path": "/a", "Metadata": {"Location": {"Building": "B"}}}')
    m = files.read_metadata(spark, str(tmp_path / "m.json")).first()
    assert (m["uuid"], m["building"], m["floor"]) == ("u1", "B", "-")
    files.write_readings(series(spark, [1, 2]), str(tmp_path / "out"))
    assert files.read_readings(spark, str(tmp_path / "out"), 0, 1).count() == 1
    files.write_sequence_file(series(spark, [1, 2], step=SECOND), str(tmp_path / "seq"))
    assert files.read_sequence_file(spark, str(tmp_path / "seq"), "a").count() == 2


def test_other_parameters_compute_anew(spark):
    s = spark.createDataFrame([("a", 0, 1.0, 1, False), ("a", 10, 2.0, 2, False)], "uuid string, time_ns long, value double, version long, deleted boolean")
    times = lambda k: lambda rows, ranges: rows.select("uuid", "time_ns", (F.col("value") * k).alias("value"))
    old, control, anew = versions.refresh(versions.Distillate("d", times(2), params={"k": 2}), s, s.limit(0).select("uuid", "time_ns", "value"), None, 1)
    assert anew
    _, control, anew = versions.refresh(versions.Distillate("d", times(2), params={"k": 2}), s, old, control, 2)
    assert not anew
    new, _, anew = versions.refresh(versions.Distillate("d", times(3), params={"k": 3}), s, old, control, 2)
    assert anew and sorted(r["value"] for r in new.collect()) == [3.0, 6.0]


def test_read_ids(spark, tmp_path):
    (tmp_path / "ids.csv").write_text(" a1 ,x\n\n , y\nb2\n")
    assert sorted(r["id"] for r in files.read_ids(spark, str(tmp_path / "ids.csv")).collect()) == ["a1", "b2"]


def test_mixture_of_normal_laws():
    r = np.random.default_rng(4)
    v = np.sort(np.concatenate([r.normal(0, 1, 400), r.normal(20, 3, 200)]))
    w = r.integers(1, 4, len(v)).astype(float)
    one, label, means = states.mixture(v, w, np.array([0]), np.zeros(len(v)))
    m = np.average(v, weights=w)
    var = np.average((v - m) ** 2, weights=w) + 1e-3
    assert not label.any() and means[0] == pytest.approx(m)
    assert one == pytest.approx(float((w * (-0.5 * np.log(2 * np.pi * var) - (v - m) ** 2 / (2 * var))).sum()))
    two, label, means = states.mixture(v, w, states.best_cuts(v, w, 2)[1], np.zeros(len(v)))
    assert two > one and means == pytest.approx([np.average(v[v < 8], weights=w[v < 8]), np.average(v[v >= 8], weights=w[v >= 8])], abs=0.2)
    assert (label == (v >= 8)).mean() > 0.99
    whole = states.mixture(np.repeat(v, w.astype(int)), np.ones(int(w.sum())), np.array([0, int(w[v < 8].sum())]), np.zeros(int(w.sum())))
    assert whole[0] == pytest.approx(two, rel=1e-6)  # a weight counts as that many rows


def test_mixture_states(spark):
    r = np.random.default_rng(5)
    v = np.round(np.concatenate([r.normal(0, 1, 200), r.normal(50, 1, 200), r.normal(100, 1, 200)]), 3)
    df = slots(spark, v.tolist())
    found = {x["value"]: (x["label"], x["n_states"]) for x in states.value_states(df, ["sensor"], method="mixture").collect()}
    assert set(found) == set(v.tolist())
    low, middle, high = (max(l for x, (l, _) in found.items() if a < x < b) for a, b in ((-9, 9), (41, 59), (91, 109)))
    assert low < middle < high == next(iter(found.values()))[1] - 1


def test_compared_clusterings(spark):
    place = {"a": 0.0, "b": 0.1, "c": 1.2, "d": 1.3, "e": 1.25}
    d = spark.createDataFrame([(x, y, abs(place[x] - place[y])) for x, y in itertools.combinations(sorted(place), 2)], "a string, b string, d double")
    names = spark.createDataFrame([(x,) for x in place], "sensor string")
    found = clusters.clusterings(d, names)
    got = {(r["method"], r["k"]): r for r in clusters.compare_clusterings(d, found, clusters.distance_bounds(0.9), clusters.distance_bounds(0.1)).collect()}
    for method in ("pack", "ward", "kmeans"):
        r = got[(method, 2)]
        assert (round(r["intra_max"], 6), round(r["inter_min"], 6), r["intra_violations"], r["inter_violations"]) == (0.1, 1.1, 0, 0)
        assert r["validity"] == pytest.approx((0.1 + 0.1 + 0.05 + 0.05) / 4 / 1.1)
    assert found.filter("method in ('ward', 'kmeans') and k = 2 and exemplar in ('c', 'd')").count() == 0  # e is their medoid


def test_site_names(spark):
    df = spark.createDataFrame([("BXkey00001x0123_KW", 1), ("BXkey00001xKW", 2), ("nothing", 3), (None, 4)], "code string, n int")
    names = spark.createDataFrame([("key00001", "Hall")], "key string, name string")
    kinds = {r["n"]: r["site_name"] for r in align.site_names(df, "code", names, 2, 8, ("KVA", "KW")).collect()}
    assert kinds[1] == "Hall_KW_0123" and kinds[3] == "nothing" and kinds[4] is None and kinds[2].startswith("Hall_KW_")
    rest = spark.createDataFrame([("thing", "Thing"), ("key", "no")], "key string, name string")
    assert [r["site_name"] for r in align.site_names(df, "code", rest).orderBy("n").collect()] == ["BXkey00001x0123_KW", "BXkey00001xKW", "Thing", None]


def test_merged_parts(spark):
    a = spark.createDataFrame([("a", 1, 1.0)], "sensor string, t long, value double")
    b = spark.createDataFrame([(2.0, "a", 1)], "value double, sensor string, t long")
    assert sorted(tuple(r) for r in files.merge_parts([a, b]).collect()) == [("a", 1, 1.0), ("a", 1, 2.0)]


def doubled(factor: float = 2.0):
    return lambda rows, ranges: rows.select("uuid", "time_ns", (F.col("value") * factor).alias("value"))


def test_scheduler(spark, tmp_path):
    stream = "uuid string, time_ns long, value double, version long, deleted boolean"
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("a", 0, 1.0, 1, False), ("a", 10**9, 5.0, 1, False)], stream).write.parquet(source)
    section = {"deps": {"in": source}, "outputs": {"out": target}, "params": {"factor": 2.0}, "paramver": "1", "mintime": "1970-01-01", "maxtime": "2030-01-01T00:00:00"}
    config = {"global": {"enabled": "true", "algorithm": f"{__name__}.doubled"}, "twice": section}
    values = lambda: sorted((r["time_ns"], r["value"]) for r in schedule.latest(spark, target).collect())
    assert schedule.latest(spark, target).count() == 0
    assert schedule.run(spark, config) == schedule.DONE and values() == [(0, 2.0), (10**9, 10.0)]
    assert schedule.run(spark, config) == schedule.NO_CHANGE
    spark.createDataFrame([("a", 10**9, 6.0, 2, False)], stream).write.mode("append").parquet(source)
    assert schedule.run(spark, config) == schedule.DONE and values() == [(0, 2.0), (10**9, 12.0)]
    config["twice"] = {**section, "params": {"factor": 3.0}}
    assert schedule.run(spark, config) == schedule.DONE and values() == [(0, 3.0), (10**9, 18.0)]
    assert schedule.run(spark, {**config, "global": {"enabled": "no", "algorithm": ""}}) == schedule.SKIPPED
    for broken in ({"global": {"enabled": "true"}}, {"global": {"enabled": "true", "algorithm": "no.such.thing"}}, {**config, "twice": {"deps": {}}}):
        assert schedule.run(spark, broken) == schedule.BAD_CONFIG
    assert schedule.run(spark, {**config, "twice": {**section, "deps": {"in": f"{tmp_path}/none"}}}) == schedule.FAILED
