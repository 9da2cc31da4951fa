"""The whole analysis on a made-up building, and the exports."""

import json

import numpy as np
from pyspark.sql import functions as F

from tsengine.model import HOUR
from tsengine.plans.analysis import analyse
from tsengine.plans.analysis import weather_states
from tsengine.sources import exports, files


def test_finds_the_cause(spark):
    r = np.random.default_rng(4)
    n = 24 * 14
    hot = r.choice([0.0, 5.0, 9.0], n)
    rows = []
    for i in range(n):
        for k in range(3):
            t = i * HOUR + k * HOUR // 4
            rows += [("temp", t, hot[i] + r.normal(0, 0.05)), ("power", t, 2 * hot[i] + 1 + r.normal(0, 0.05)), ("noise", t, r.normal(0, 1))]
    rows += [("sparse", 5, 1.0)]
    df = spark.createDataFrame([(a, int(b), float(c)) for a, b, c in rows], "sensor string, t long, value double")
    sky = [("Clear", "Light Rain", "Light Snow")[[0.0, 5.0, 9.0].index(x)] for x in hot]
    weather = spark.createDataFrame([(i * HOUR + 7, f"{x + r.normal(0, 0.05):.3f}", c, "") for i, (x, c) in enumerate(zip(hot, sky))], "t long, TemperatureC string, Conditions string, Events string")
    a = analyse(df, 0, n * HOUR, HOUR, ["power", "absent"], n_causes=3, weather=weather)
    assert [x["sensor"] for x in a.purged.filter("purged").collect()] == ["sparse"]
    assert {(x["effect"], x["sig_tag"]) for x in a.failures.collect()} >= {("absent", "avg"), ("absent", "diff")}
    average = a.clusters.filter("sig_tag = 'avg'").drop("sig_tag")
    groups = {x["sensor"]: x["exemplar"] for x in average.collect()}
    assert groups["temp"] == groups["power"] != groups["noise"]
    s = a.states.filter("sig_tag = 'avg'")
    assert s.filter("name = 'power'").select("state").distinct().count() == 3
    assert {x["state"] for x in s.filter("name = 'Conditions'").select("state").distinct().collect()} == {8, 3, 1}
    assert {x["state"] for x in s.filter("name = 'TemperatureC'").select("state").distinct().collect()} == {0, 5, 9}
    assert s.filter("name = 'Events'").count() == 0  # it never changes
    assert a.ranked.filter("sig_tag = 'avg'").count() == 3
    assert {x["cause"] for x in a.ranked.filter("sig_tag = 'avg' and opt_prob > 0.99").collect()} >= {"Conditions", "TemperatureC"}
    nets = {}
    for x in a.edges.collect():
        nets.setdefault(x["model_id"], set()).add((x["src"], x["dst"]))
    explained = {x for x, y in nets["power|avg|weather"] if y == "power"}
    assert explained and explained <= {"Conditions", "TemperatureC"}
    assert ("power|avg|all" in nets) and all(x != "power" for edges in nets.values() for x, _ in edges)
    texts = {(x["effect"], x["sig_tag"], x["network"]): json.loads(x["json"]) for x in files.summary_json(a.ranked, a.edges).collect()}
    assert set(texts) == {("power", tag, net) for tag in ("avg", "diff") for net in ("sensor", "weather", "time", "all")}
    for (effect, tag, net), text in texts.items():
        assert {(e["src"], e["dst"]) for e in text["edges"]} == nets.get(f"{effect}|{tag}|{net}", set())
    assert [c["rank"] for c in texts["power", "avg", "all"]["causes"]] == [1, 2, 3] and texts["power", "avg", "weather"]["edges"]
    table = {x["sensor"]: x for x in exports.cluster_table(df, average).collect()}
    assert table["sparse"]["label"] == "-" and table["sparse"]["zero_variance"]


def test_weather_outliers_go(spark):
    rows = [(i * HOUR, str(float(i % 7))) for i in range(200)]
    bad = [(50 * HOUR + 1, "100000"), (60 * HOUR + 1, "-9999"), (70 * HOUR + 1, "x"), (None, "3")]
    good, all_ = (spark.createDataFrame(x, "t long, TemperatureC string") for x in (rows, rows + bad))
    found = [sorted(map(tuple, weather_states(w, 0, 200 * HOUR, HOUR, 5).collect())) for w in (good, all_)]
    assert found[0] == found[1] and len(found[0]) == 200


def test_exports(spark):
    edges = spark.createDataFrame([("m", "b", "a"), ("m", "c", "a")], "model_id string, src string, dst string")
    assert json.loads(exports.graph_json(edges).first()["json"]) == {"nodes": [{"name": "a"}, {"name": "b"}, {"name": "c"}], "links": [{"source": 1, "target": 0}, {"source": 2, "target": 0}]}
    old = spark.createDataFrame([("a", 5, 1.0)], "sensor string, t long, value double")
    new = spark.createDataFrame([("a", 5, 2.0), ("a", 6, 3.0), ("b", 1, 4.0)], old.schema)
    assert sorted(map(tuple, exports.append_later(old, new).collect())) == [("a", 5, 1.0), ("a", 6, 3.0), ("b", 1, 4.0)]
    avg = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0)], "sensor string, slot long, value double")
    assert json.loads(exports.processed_json(avg, avg.limit(1)).first()["json"]) == [[1, 2, 2]]


def test_queries_take_every_sensor_and_day(spark):
    from tsengine.plans import queries

    sf = "/root/testdata/sf0.01"
    sensors = {r["sensor"] for r in queries.events(spark, sf).select("sensor").distinct().collect()}
    assert {r["effect"] for r in queries.explained_peaks(spark, sf).select("effect").distinct().collect()} == sensors
    points = {}
    for r in queries.events(spark, sf).filter(F.col("t").between(queries.START, queries.END - 1)).collect():
        points.setdefault(r["sensor"], {}).setdefault(r["t"], []).append(r["value"])
    got = {}
    for r in queries.upsampled(spark, sf).collect():
        got.setdefault(r["sensor"], []).append((r["t"], r["value"]))
    grid = np.arange(queries.START, queries.END + 1, 600_000_000)
    assert set(got) == sensors
    for sensor, rows in got.items():
        at = {queries.START: 0.0, queries.END: 0.0} | {t: sum(v) / len(v) for t, v in points[sensor].items()}
        t = np.array(sorted(at))
        rows.sort()
        assert [x for x, _ in rows] == grid.tolist()
        want = np.interp((grid - queries.START).astype(float), (t - queries.START).astype(float), [at[x] for x in t.tolist()])
        assert np.allclose([v for _, v in rows], want, atol=6e-5)  # the query rounds to four decimals
