"""Registered queries of the time-series library: operators applied to the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.functions import scalar
from tsengine.model import DAY, HOUR, MINUTE, SECOND, micros, readings, shared_folder, table
from tsengine.operators import align, clean, clusters, features, likelihood, networks, ordered, states, weather
from tsengine.sources import files
from tsengine.streaming import live, pyramid, versions

START, END, WIDTH = 1704067200 * SECOND, 1706659200 * SECOND, 2 * HOUR  # January 2024 less a day, slots of two hours
LINE_START, LINE_END, LINE_WIDTH = 694224000 * SECOND, 946684800 * SECOND, 30 * DAY

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_R = "r AS (SELECT event_type AS sensor, epoch_us(ts) AS t, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value))"
_U = "r AS (SELECT CAST(user_id AS VARCHAR) AS sensor, epoch_us(ts) AS t, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value))"
_L = "r AS (SELECT l_returnflag AS sensor, epoch_us(l_shipdate) AS t, CAST(floor(l_quantity / 10) AS DOUBLE) AS value FROM lineitem)"
_S = f"s AS (SELECT *, (t - {START}) // {WIDTH} AS slot FROM r WHERE t >= {START} AND t < {END})"
_LS = f"s AS (SELECT *, (t - {LINE_START}) // {LINE_WIDTH} AS slot FROM r WHERE t >= {LINE_START} AND t < {LINE_END})"
_M = "m AS (SELECT sensor, slot, avg(value) AS value FROM s GROUP BY ALL)"
_GRID = f"g AS (SELECT sensor, slot FROM (SELECT DISTINCT sensor FROM s), (SELECT unnest(range(0, {(END - START) // WIDTH})) AS slot)), f AS (SELECT g.sensor, g.slot, value FROM g LEFT JOIN m USING (sensor, slot))"
_STATES = f"st AS (SELECT sensor AS name, slot, CASE WHEN value > 250 THEN 1 WHEN value < 220 THEN -1 ELSE 0 END AS state FROM m)"
_WIDE = "w AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(floor(l_quantity / 10) AS INT) AS qty, CAST(round(l_discount * 100) AS INT) AS disc FROM lineitem)"
_DATED = "d AS (SELECT l_returnflag AS name, CAST(least(2, floor(l_quantity / 20)) AS INT) AS state, CAST(month(l_shipdate) - 1 AS INT) AS month, CAST(isodow(l_shipdate) - 1 AS INT) AS weekday, CAST(hour(l_shipdate) AS INT) AS hour FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine; the sign of zero goes."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), places) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def events(spark: SparkSession, sf: str, sensor: str = "event_type") -> DataFrame:
    return readings(table(spark, sf, "events"), sensor, "ts", "value")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return readings(table(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", F.floor(F.col("l_quantity") / 10))


def slotted(spark, sf, sensor: str = "event_type") -> DataFrame:
    return align.assign_slots(events(spark, sf, sensor), START, END, WIDTH)


def means(spark, sf) -> DataFrame:
    return features.slot_feature(slotted(spark, sf))


def full_means(spark, sf) -> DataFrame:
    return align.with_all_slots(means(spark, sf), align.slot_grid(spark, START, END, WIDTH))


def simple_states(spark, sf) -> DataFrame:
    v = F.col("value")
    return means(spark, sf).select(F.col("sensor").alias("name"), "slot", F.when(v > 250, 1).when(v < 220, -1).otherwise(0).alias("state"))


def wide(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.floor(F.col("l_quantity") / 10).cast("int").alias("qty"), F.round(F.col("l_discount") * 100).cast("int").alias("disc"))


def dated_states(spark, sf) -> DataFrame:
    cal = scalar.calendar(micros("l_shipdate"))
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("name"), F.least(F.lit(2), F.floor(F.col("l_quantity") / 20)).cast("int").alias("state"), *[c.cast("int").alias(k) for k, c in cal.items()])


def stream(spark, sf) -> DataFrame:
    """Events as a versioned stream: seven versions by id, every eleventh event a delete."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("uuid"), (F.floor(micros("ts") / F.lit(10 * MINUTE)) * (10 * MINUTE) * 1000).alias("time_ns"), "value", (F.col("event_id") % 7).alias("version"), (F.col("event_id") % 11 == 0).alias("deleted"))


_STREAM = f"v AS (SELECT event_type AS uuid, epoch_us(ts) // {10 * MINUTE} * {10 * MINUTE} * 1000 AS time_ns, value, event_id % 7 AS version, event_id % 11 = 0 AS deleted FROM events)"


# --- alignment and slot features


@query(f"WITH {_R}, {_S} SELECT sensor, slot, round(avg(value), 6) AS value FROM s GROUP BY ALL")
def slot_mean(spark, sf):
    return rounded(means(spark, sf))


@query(f"WITH {_L}, {_LS}, c AS (SELECT sensor, slot, value, count(*) AS n FROM s GROUP BY ALL) SELECT sensor, slot, value FROM c QUALIFY row_number() OVER (PARTITION BY sensor, slot ORDER BY n DESC, value) = 1")
def slot_mode(spark, sf):
    r = lines(spark, sf)
    types = r.select("sensor").distinct().withColumn("num_type", F.lit(0))
    return features.slot_feature(align.assign_slots(r, LINE_START, LINE_END, LINE_WIDTH), types)


@query(f"WITH {_R}, {_S} SELECT sensor, slot, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY ALL")
def slot_count(spark, sf):
    return rounded(features.slot_statistics(slotted(spark, sf)))


@query(f"WITH {_R}, {_S}, {_M}, {_GRID} SELECT sensor, slot FROM f WHERE value IS NULL")
def slot_grid_missing(spark, sf):
    return full_means(spark, sf).filter("value is null").select("sensor", "slot")


@query(f"WITH {_R}, {_S} SELECT sensor, slot, t, t - {START} - slot * {WIDTH} AS \"offset\", value FROM s")
def slot_assignment(spark, sf):
    return slotted(spark, sf).select("sensor", "slot", "t", "offset", "value")


@query(f"SELECT i AS chunk, {START} + i * {7 * DAY} AS begin, least({START} + i * {7 * DAY} + {7 * DAY}, {END}) AS finish FROM (SELECT unnest(range(0, 5)) AS i)")
def week_chunks(spark, sf):
    return align.chunks(spark, START, END, 7 * DAY)


@query(f"WITH {_L} SELECT sensor, count(*) AS n, count(DISTINCT value) AS n_distinct, CASE WHEN CASE WHEN count(*) > 1000 THEN count(DISTINCT value) < 10 ELSE count(*) / count(DISTINCT value) > 100 END THEN 0 ELSE 1 END AS num_type FROM r GROUP BY sensor UNION ALL SELECT event_type, count(*), count(DISTINCT value), CASE WHEN CASE WHEN count(*) > 1000 THEN count(DISTINCT value) < 10 ELSE count(*) / count(DISTINCT value) > 100 END THEN 0 ELSE 1 END FROM events GROUP BY event_type")
def sensor_profile(spark, sf):
    return clean.infer_types(lines(spark, sf).union(events(spark, sf)))


@query(f"WITH {_U} SELECT sensor, count(*) AS n, count(*) < 10 AS purged FROM r GROUP BY sensor")
def purge_list(spark, sf):
    return align.purge_list(events(spark, sf, "user_id"), 10)


@query(f"WITH {_U} SELECT sensor, t, value FROM r WHERE sensor IN (SELECT sensor FROM r GROUP BY sensor HAVING count(*) >= 10)")
def purged_readings(spark, sf):
    return align.purge(events(spark, sf, "user_id"), 10)


@query(f"WITH {_U} SELECT sensor, count(*) AS n, count(*) >= 10 AS enough FROM r GROUP BY sensor")
def enough_samples(spark, sf):
    return align.enough_samples(events(spark, sf, "user_id"))


@query(f"WITH {_R}, e AS (SELECT min(t) AS a, max(t) AS b FROM r GROUP BY sensor HAVING count(*) >= 100) SELECT count(*) AS n_sensors, max(a) AS first_t, min(b) AS last_t FROM e")
def common_range(spark, sf):
    return align.common_range(events(spark, sf), 100)


@query(f"WITH {_R}, e AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(t) AS a, max(t) AS b FROM r GROUP BY sensor)) SELECT DISTINCT t FROM r, e WHERE t BETWEEN a AND b")
def common_times(spark, sf):
    return align.common_times(events(spark, sf))


@query("SELECT CAST(c_custkey AS VARCHAR) AS sensor FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def missing_sensors(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sensor"))
    return align.unavailable(wanted, events(spark, sf, "user_id"))


@query(f"WITH {_R} SELECT sensor, t, value FROM r WHERE t > {START + DAY} AND t < {START + 2 * DAY} AND regexp_matches(sensor, '^[a-p]')")
def selected_readings(spark, sf):
    return align.inside_open_range(align.select_sensors(events(spark, sf), "^[a-p]"), START + DAY, START + 2 * DAY)


@query("SELECT props FROM events WHERE props IS NOT NULL AND TRY_CAST(props AS DOUBLE) IS NULL")
def not_numeric(spark, sf):
    return align.not_numeric(table(spark, sf, "events").select("props"), "props")


@query(f"WITH {_R}, {_S}, {_M}, {_GRID}, k AS (SELECT slot FROM f WHERE value IS NOT NULL GROUP BY slot HAVING count(*) >= (SELECT count(DISTINCT sensor) FROM s)) SELECT sensor, slot, round(value, 6) AS value FROM f WHERE slot IN (SELECT slot FROM k)")
def complete_slots(spark, sf):
    m = full_means(spark, sf)
    return rounded(align.complete_slots(m, m.select("sensor").distinct().count()).select("sensor", "slot", "value"))


@query(f"WITH {_R}, {_S}, {_M}, {_GRID} SELECT sensor, count(*) FILTER (value IS NULL) AS n_missing, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (isinf(value)) AS n_infinite, count(DISTINCT value) <= 1 AS constant FROM f GROUP BY sensor")
def check_matrix(spark, sf):
    return align.check_matrix(full_means(spark, sf))


# --- cleaning

_TRIM = "p AS (SELECT sensor, value, row_number() OVER (PARTITION BY sensor ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY sensor) AS n FROM r), k AS (SELECT * FROM p WHERE i >= floor(n * 10 / 200.0) AND i < floor(n - n * 10 / 200.0)), b AS (SELECT sensor, CASE WHEN count(*) > 10 THEN min(value) - 0.1 * stddev_pop(value) END AS low, CASE WHEN count(*) > 10 THEN max(value) + 0.1 * stddev_pop(value) END AS high FROM k GROUP BY sensor)"


@query(f"WITH {_R}, {_TRIM} SELECT b.sensor, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high, count(*) FILTER (value > high OR value < low) AS n_outliers FROM r JOIN b USING (sensor) GROUP BY b.sensor")
def outliers_trimmed(spark, sf):
    r = events(spark, sf)
    marked = clean.mark_outliers(r, percent=10, sigmas=0.1).groupBy("sensor").agg(F.count_if("outlier").alias("n_outliers"))
    return rounded(clean.trim_bounds(r, ["sensor"], "value", 10, 0.1).join(marked, "sensor"), 4)


_FILL = "b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER w AS bs, last_value(value IGNORE NULLS) OVER w AS bv, first_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS s2, first_value(value IGNORE NULLS) OVER a AS av, min(slot) OVER (PARTITION BY sensor) AS lo, max(slot) OVER (PARTITION BY sensor) AS hi FROM f WINDOW w AS (PARTITION BY sensor ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY sensor ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
_FILLED = "CASE WHEN value IS NOT NULL THEN value WHEN slot = lo OR slot = hi OR s2 - bs - 1 > {gap} THEN NULL WHEN bs IS NULL THEN av WHEN s2 IS NULL THEN bv ELSE {between} END"
_LINE, _NEAR = "bv + (av - bv) * (slot - bs) / (s2 - bs)", "CASE WHEN slot - bs <= s2 - slot THEN bv ELSE av END"


@query(f"WITH {_R}, {_S}, {_M}, {_GRID}, {_FILL} SELECT sensor, slot, round(value, 6) AS value, round({_FILLED.format(gap=18, between=_LINE)}, 6) AS filled FROM b")
def interp_linear(spark, sf):
    return rounded(clean.fill_gaps(full_means(spark, sf), 18))


@query(f"WITH {_R}, {_S}, {_M}, {_GRID}, {_FILL} SELECT sensor, slot, round(value, 6) AS value, round({_FILLED.format(gap=1, between=_NEAR)}, 6) AS filled FROM b")
def interp_nearest(spark, sf):
    return rounded(clean.fill_gaps(full_means(spark, sf), 1, nearest=True))


@query(f"WITH {_R}, {_S}, {_M}, {_GRID} SELECT sensor, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(*) FILTER (value IS NULL) > count(*) / 5 AS excluded FROM f GROUP BY sensor")
def too_many_missing(spark, sf):
    return clean.too_many_missing(full_means(spark, sf), value="value")


@query(f"WITH {_R}, {_S}, {_M}, x AS (SELECT sensor, avg(value) AS mean, sqrt(sum(value * value)) AS norm FROM m GROUP BY sensor) SELECT sensor, slot, round((value - mean) / norm, 6) AS normalised FROM m JOIN x USING (sensor)")
def normalized(spark, sf):
    return rounded(clean.normalise(means(spark, sf)).select("sensor", "slot", "normalised"))


@query(f"WITH {_R}, {_S}, d AS (SELECT sensor, slot, abs(value - lag(value) OVER (PARTITION BY sensor, slot ORDER BY t, value)) AS d FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY sensor, slot ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY sensor, slot) AS n FROM d WHERE d IS NOT NULL) SELECT sensor, slot, round(avg(d), 6) AS value FROM p WHERE i >= floor(n * 0.5) GROUP BY ALL")
def slot_diff_upper_half(spark, sf):
    return rounded(features.slot_difference(slotted(spark, sf)))


@query(ORACLE_SQL["slot_diff_upper_half"].replace("SELECT sensor, slot, round(avg(d), 6) AS value", f", q AS (SELECT sensor, slot, avg(d) AS value").replace("GROUP BY ALL", "GROUP BY ALL)") + " SELECT sensor, slot, round(a.value, 6) AS avg_value, round(q.value, 6) AS diff_value FROM (SELECT sensor, slot, avg(value) AS value FROM s GROUP BY ALL) a JOIN q USING (sensor, slot)")
def avg_diff_joined(spark, sf):
    return rounded(features.pair_features(means(spark, sf), features.slot_difference(slotted(spark, sf))))


@query(f"WITH {_R}, p AS (SELECT *, (row_number() OVER (PARTITION BY sensor ORDER BY t, value) - 1) // 100 AS block FROM r) SELECT sensor, block, min(t) AS t, round(sum(value) / 100, 6) AS value FROM p GROUP BY ALL")
def downsampled(spark, sf):
    return rounded(clean.downsample(events(spark, sf), 100))


_TRIM1 = _TRIM.replace("* 10 / 200.0", "* 1 / 200.0").replace("0.1 * stddev", "20 * stddev")
_TYPES = "CASE WHEN CASE WHEN count(*) > 1000 THEN count(DISTINCT value) < 10 ELSE count(*) / count(DISTINCT value) > 100 END THEN 0 ELSE 1 END AS num_type"
_AROUND = "nb AS (SELECT q.sensor, q.t, b.t AS bt, b.value AS bv FROM q ASOF LEFT JOIN o b ON q.sensor = b.sensor AND q.t >= b.t), na AS (SELECT nb.*, a.t AS at2, a.value AS av FROM nb ASOF LEFT JOIN o a ON nb.sensor = a.sensor AND nb.t < a.t)"
_BETWEEN = "CASE WHEN bt = na.t OR at2 IS NULL THEN bv ELSE bv + (av - bv) * (na.t - bt) / (at2 - bt) END"
_EVEN = f"{_R}, {_TRIM1}, o AS (SELECT r.sensor, t, avg(value) AS value FROM r JOIN b USING (sensor) WHERE NOT coalesce(value > high OR value < low, false) GROUP BY ALL), st AS (SELECT sensor, min(t) AS a, max(t) AS z, CAST(ceil((max(t) - min(t)) / count(*) / 1000000) AS BIGINT) * 1000000 AS step FROM o GROUP BY sensor HAVING max(t) > min(t)), q AS (SELECT sensor, unnest(range(a, z, step)) AS t FROM st), ty AS (SELECT sensor, {_TYPES} FROM o GROUP BY sensor), {_AROUND}, ev AS (SELECT na.sensor, na.t, CASE WHEN num_type = 0 THEN CASE WHEN at2 IS NULL OR na.t - bt <= at2 - na.t THEN bv ELSE av END ELSE {_BETWEEN} END AS value FROM na JOIN ty USING (sensor))"


@query(f"WITH {_EVEN} SELECT sensor, t, round(value, 4) AS value FROM ev")
def regularised(spark, sf):
    return rounded(clean.regularise(events(spark, sf)), 4)


@query(f"WITH {_R}, e AS (SELECT * FROM r WHERE t >= {START} AND t < {END}), an AS (SELECT sensor, t, avg(value) AS value FROM e GROUP BY ALL UNION ALL SELECT DISTINCT sensor, {START}, 0.0 FROM e UNION ALL SELECT DISTINCT sensor, {END}, 0.0 FROM e), o AS (SELECT sensor, t, arg_max(value, abs(value)) AS value FROM an GROUP BY ALL), q AS (SELECT sensor, unnest(range({START}, {END} + 1, {10 * MINUTE})) AS t FROM (SELECT DISTINCT sensor FROM o)), {_AROUND} SELECT sensor, t, round({_BETWEEN}, 4) AS value FROM na")
def upsampled(spark, sf):
    return rounded(clean.upsample(align.in_range(events(spark, sf), START, END), 10 * MINUTE, START, END), 4)


@query(f"WITH RECURSIVE {_R}, p AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY t, value) AS i FROM r), k AS (SELECT sensor, t, value, i, value AS x, 1.0::DOUBLE AS p FROM p WHERE i = 1 UNION ALL SELECT n.sensor, n.t, n.value, n.i, k.x + (k.p + 0.1) / (k.p + 1.1) * (n.value - k.x), (k.p + 0.1) * (1 - (k.p + 0.1) / (k.p + 1.1)) FROM k JOIN p n ON n.sensor = k.sensor AND n.i = k.i + 1) SELECT sensor, t, value, round(x, 6) AS smoothed FROM k")
def kalman(spark, sf):
    return clean.kalman(events(spark, sf), 0.1, 1.0).withColumn("smoothed", F.round("smoothed", 6) + 0.0)


# Slots (sl: sensor, slot, value, num_type) as finished columns: outliers out, gaps filled, columns with too much missing out, the
# others normalised, constant ones out.
_COLUMNS = """p1 AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY value NULLS LAST) - 1 AS i, count(value) OVER (PARTITION BY sensor) AS n FROM sl),
b1 AS (SELECT sensor, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS sd, count(value) AS k FROM p1 WHERE value IS NOT NULL AND i >= floor(n / 200.0) AND i < floor(n - n / 200.0) GROUP BY sensor),
f AS (SELECT p1.sensor, slot, num_type, CASE WHEN k > 10 AND (value > hi + 20 * sd OR value < lo - 20 * sd) THEN NULL ELSE value END AS value FROM p1 LEFT JOIN b1 ON p1.sensor = b1.sensor),
{fill}, g1 AS (SELECT sensor, slot, num_type, CASE WHEN num_type = 0 THEN {near} ELSE {line} END AS value FROM b),
g2 AS (SELECT * FROM g1 QUALIFY count(*) FILTER (value IS NULL) OVER (PARTITION BY sensor) <= count(*) OVER (PARTITION BY sensor) / 5),
g3 AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY value NULLS LAST) - 1 AS i, count(value) OVER (PARTITION BY sensor) AS n FROM g2),
g4 AS (SELECT sensor, avg(value) AS mean, sqrt(sum(value * value)) AS norm, min(value) FILTER (value IS NOT NULL AND i >= floor(n * 0.05) AND i < floor(n * 0.95)) < max(value) FILTER (value IS NOT NULL AND i >= floor(n * 0.05) AND i < floor(n * 0.95)) AS varies FROM g3 GROUP BY sensor),
g5 AS (SELECT g3.sensor, slot, num_type, CASE WHEN num_type = 0 THEN value WHEN varies THEN (value - mean) / norm END AS value FROM g3 JOIN g4 USING (sensor))
SELECT sensor, slot, num_type, round(value, 6) AS value FROM g5 QUALIFY min(value) OVER (PARTITION BY sensor) <> max(value) OVER (PARTITION BY sensor)"""
_COLUMNS_18 = _COLUMNS.format(fill=_FILL, near=_FILLED.format(gap=18, between=_NEAR), line=_FILLED.format(gap=18, between=_LINE))


@query(f"WITH {_R}, {_S}, {_M}, ty AS (SELECT sensor, {_TYPES} FROM r GROUP BY sensor), sl AS (SELECT g.sensor, g.slot, value, num_type FROM (SELECT sensor, slot FROM (SELECT DISTINCT sensor FROM s), (SELECT unnest(range(0, {(END - START) // WIDTH})) AS slot)) g LEFT JOIN m USING (sensor, slot) JOIN ty ON ty.sensor = g.sensor), {_COLUMNS_18}")
def average_features(spark, sf):
    return rounded(features.average_features(events(spark, sf), align.slot_grid(spark, START, END, WIDTH), START, END, WIDTH, 18))


_DIFFS = "d1 AS (SELECT sensor, slot, abs(value - lag(value) OVER (PARTITION BY sensor, slot ORDER BY t, value)) AS d FROM s1), d2 AS (SELECT *, row_number() OVER (PARTITION BY sensor, slot ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY sensor, slot) AS n FROM d1 WHERE d IS NOT NULL), d3 AS (SELECT sensor, slot, avg(d) AS value FROM d2 WHERE i >= floor(n * 0.5) GROUP BY ALL)"


@query(f"WITH {_EVEN}, s1 AS (SELECT *, (t - {START}) // {DAY} AS slot FROM ev WHERE t >= {START} AND t < {END}), {_DIFFS}, ty1 AS (SELECT sensor, {_TYPES} FROM ev GROUP BY sensor), sl AS (SELECT g.sensor, g.slot, value, num_type FROM (SELECT sensor, slot FROM (SELECT DISTINCT sensor FROM s1), (SELECT unnest(range(0, {(END - START) // DAY})) AS slot)) g LEFT JOIN d3 USING (sensor, slot) JOIN ty1 ON ty1.sensor = g.sensor), {_COLUMNS_18.replace('b AS (', 'b9 AS (').replace('FROM b)', 'FROM b9)')}")
def difference_features(spark, sf):
    """Slots of a day, so that each has several readings of the even series at every size."""
    return rounded(features.difference_features(events(spark, sf), align.slot_grid(spark, START, END, DAY), START, END, DAY, 18))


# --- ordered


@query(f"WITH {_R}, {_S}, {_M}, p AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY slot) AS i, avg(value) OVER (PARTITION BY sensor ORDER BY slot ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x FROM m) SELECT sensor, slot, round(value, 6) AS value, round(CASE WHEN i <= 5 THEN avg(value) FILTER (i <= 5) OVER (PARTITION BY sensor) ELSE x END, 6) AS avg_before FROM p")
def moving_avg_prev(spark, sf):
    return rounded(ordered.moving_average_before(means(spark, sf), ["sensor"], ["slot"], 5))


@query(f"WITH {_R} SELECT sensor, t, value, round(value - lag(value) OVER (PARTITION BY sensor ORDER BY t, value), 6) AS diff FROM r")
def first_diff(spark, sf):
    d = ordered.first_difference(events(spark, sf))
    return d.withColumn("diff", F.round("diff", 6) + 0.0)


@query(f"WITH {_U} SELECT sensor, t, value, t - lag(t) OVER (PARTITION BY sensor ORDER BY t, value) AS gap FROM r")
def inter_arrival(spark, sf):
    return ordered.inter_arrival(events(spark, sf, "user_id"))


_CLAMP = "p AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY slot) AS i, count(*) OVER (PARTITION BY sensor) AS n, {v} OVER (PARTITION BY sensor ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM h)"


@query(f"WITH {_R}, {_S}, {_M}, h AS (SELECT sensor, slot, CAST(value > 250 AS INT) AS value FROM m), {_CLAMP.format(v='avg(value)')} SELECT sensor, slot, value, round(CASE WHEN i <= 2 THEN max(x) FILTER (i = least(3, n)) OVER (PARTITION BY sensor) WHEN i > n - 2 THEN max(x) FILTER (i = greatest(n - 2, 1)) OVER (PARTITION BY sensor) ELSE x END, 6) AS rolling_mean FROM p")
def rolling_binary(spark, sf):
    h = means(spark, sf).withColumn("value", (F.col("value") > 250).cast("int"))
    return rounded(ordered.rolling_binary_mean(h, ["sensor"], ["slot"], 5))


@query(f"WITH {_R}, {_S}, {_M}, h AS (SELECT sensor, slot, CASE WHEN value > 250 THEN 1 WHEN value < 220 THEN -1 ELSE 0 END AS value FROM m), {_CLAMP.format(v='list(value)')}, o AS (SELECT *, (SELECT y FROM (SELECT unnest(x) AS y) GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) AS z FROM p) SELECT sensor, slot, value, CASE WHEN i <= 2 THEN max(z) FILTER (i = least(3, n)) OVER (PARTITION BY sensor) WHEN i > n - 2 THEN max(z) FILTER (i = greatest(n - 2, 1)) OVER (PARTITION BY sensor) ELSE z END AS rolling_mode FROM o")
def rolling_mode(spark, sf):
    h = simple_states(spark, sf).select(F.col("name").alias("sensor"), "slot", F.col("state").alias("value"))
    return ordered.rolling_mode(h, ["sensor"], ["slot"], 5)


@query(f"WITH {_R}, {_S}, {_M}, {_STATES} SELECT name, slot, state FROM st QUALIFY row_number() OVER (PARTITION BY name ORDER BY slot) = 1 OR state <> lag(state) OVER (PARTITION BY name ORDER BY slot)")
def dedup_consecutive(spark, sf):
    return ordered.without_repeats(simple_states(spark, sf), ["name"], ["state"], ["slot"])


@query(f"WITH {_R}, {_S}, {_M}, {_STATES} SELECT name, slot, state, coalesce(state <> lag(state) OVER (PARTITION BY name ORDER BY slot), false) AS changed FROM st")
def change_marks(spark, sf):
    return ordered.change_marks(simple_states(spark, sf), ["name"], "state", ["slot"])


@query("WITH p AS (SELECT event_type AS sensor, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS q FROM events) SELECT sensor, count(*) AS n, bool_and(coalesce(t >= q, true)) AS is_sorted FROM p GROUP BY sensor")
def is_sorted(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("sensor"), "event_id", micros("ts").alias("t"))
    return ordered.sortedness(e, ["sensor"], "event_id", "t")


@query(f"WITH {_R}, b AS (SELECT sensor, t, value FROM r WHERE t < {START + 10 * DAY} QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY t DESC, value DESC) = 1), a AS (SELECT sensor, t, value FROM r WHERE t >= {START + 10 * DAY} QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY t, value) = 1) SELECT *, true AS backward FROM b UNION ALL SELECT *, false FROM a")
def nearest_value(spark, sf):
    r = events(spark, sf)
    return ordered.nearest_value(r, START + 10 * DAY, True).withColumn("backward", F.lit(True)).union(ordered.nearest_value(r, START + 10 * DAY, False).withColumn("backward", F.lit(False)))


def _asked(spark, r) -> DataFrame:
    return r.select("sensor").distinct().crossJoin(align.slot_grid(spark, START, END, HOUR).select(F.col("slot_t").alias("t")))


_ASKED = f"q AS (SELECT sensor, {START} + i * {HOUR} AS t FROM (SELECT DISTINCT sensor FROM r), (SELECT unnest(range(0, {(END - START) // HOUR})) AS i)), o AS (SELECT sensor, t, avg(value) AS value FROM r GROUP BY ALL), nb AS (SELECT q.sensor, q.t, b.t AS bt, b.value AS bv FROM q ASOF LEFT JOIN o b ON q.sensor = b.sensor AND q.t >= b.t), na AS (SELECT nb.*, a.t AS at2, a.value AS av FROM nb ASOF LEFT JOIN o a ON nb.sensor = a.sensor AND nb.t < a.t)"


@query(f"WITH {_R}, {_ASKED} SELECT sensor, t, bt AS before_t, round(bv, 6) AS before_value, at2 AS after_t, round(av, 6) AS after_value FROM na")
def asof_join(spark, sf):
    r = events(spark, sf).groupBy("sensor", "t").agg(F.avg("value").alias("value"))
    return rounded(ordered.neighbours(r, _asked(spark, r)))


@query(f"WITH {_R}, {_ASKED} SELECT sensor, t, round(CASE WHEN bt IS NOT NULL AND (at2 IS NULL OR t - bt <= at2 - t) THEN bv ELSE av END, 6) AS value FROM na")
def nearest_on_grid(spark, sf):
    r = events(spark, sf).groupBy("sensor", "t").agg(F.avg("value").alias("value"))
    return rounded(ordered.nearest_interpolation(r, _asked(spark, r)))


@query(f"WITH {_R}, {_ASKED}, k AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY t) AS i, row_number() OVER (PARTITION BY sensor ORDER BY t DESC) AS j FROM o), e AS (SELECT sensor, max(t) FILTER (i = 1) AS t0, max(value) FILTER (i = 1) AS v0, max(t) FILTER (i = 2) AS t1, max(value) FILTER (i = 2) AS v1, max(t) FILTER (j = 2) AS t2, max(value) FILTER (j = 2) AS v2, max(t) FILTER (j = 1) AS t3, max(value) FILTER (j = 1) AS v3 FROM k GROUP BY sensor) SELECT na.sensor, na.t, round(CASE WHEN t1 IS NULL THEN v0 WHEN bt IS NULL THEN v0 + (v1 - v0) * (na.t - t0) / (t1 - t0) WHEN bt = na.t THEN bv WHEN at2 IS NULL THEN v2 + (v3 - v2) * (na.t - t2) / (t3 - t2) ELSE bv + (av - bv) * (na.t - bt) / (at2 - bt) END, 4) AS value FROM na JOIN e ON na.sensor = e.sensor")
def linear_on_grid(spark, sf):
    r = events(spark, sf)
    return rounded(ordered.linear_interpolation(r, _asked(spark, r)), 4)


# --- sampling quality


@query(f"WITH {_R}, {_S}, c AS (SELECT sensor, slot, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT sensor, slot FROM (SELECT DISTINCT sensor FROM s), (SELECT unnest(range(0, {(END - START) // WIDTH})) AS slot)) SELECT sensor, slot, coalesce(n, 0) AS n, round(coalesce(n, 0) / {WIDTH / (20 * MINUTE)}, 6) AS density FROM g LEFT JOIN c USING (sensor, slot)")
def sampling_density(spark, sf):
    return rounded(features.sampling_density(events(spark, sf), START, END, WIDTH, 20 * MINUTE))


@query(f"WITH d AS ({ORACLE_SQL['sampling_density'].replace('round(coalesce(n, 0)', '(coalesce(n, 0)').replace(', 6) AS density', ') AS density')}), p AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY slot) - 1 AS i, count(*) OVER (PARTITION BY sensor) AS k FROM d) SELECT sensor, round(min(density), 6) AS min_density, round(max(density), 6) AS max_density, round(avg(density), 6) AS avg_density, min(density) = 0 AND max(density) = 0 AS broken FROM p WHERE i >= floor(k * 0.025) AND i < k - floor(k * 0.025) GROUP BY sensor")
def density_stats(spark, sf):
    return rounded(features.density_statistics(features.sampling_density(events(spark, sf), START, END, WIDTH, 20 * MINUTE)))


@query(f"WITH {_U}, p AS (SELECT sensor, t - lag(t) OVER (PARTITION BY sensor ORDER BY t) AS d FROM r) SELECT sensor, count(*) AS n, round(coalesce(avg(d) / 1000000, 10000.0), 4) AS interval_s FROM p GROUP BY sensor")
def mean_interval(spark, sf):
    return rounded(features.mean_interval(events(spark, sf, "user_id")), 4)


@query(f"WITH {_U} SELECT sensor, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM r GROUP BY sensor")
def availability(spark, sf):
    return features.availability(events(spark, sf, "user_id"))


@query(f"WITH {_STREAM} SELECT uuid, time_ns >> 43 << 43 AS time, count(*) AS count, min(value) AS min, round(avg(value), 6) AS mean, max(value) AS max FROM v WHERE time_ns >= ({START}000 >> 43 << 43) AND time_ns < ({END}000 >> 43 << 43) GROUP BY ALL")
def stat_windows_pw(spark, sf):
    return rounded(features.statistical_windows(stream(spark, sf), START * 1000, END * 1000, 43))


@query("SELECT event_type AS a, user_id AS b, count(*) AS n FROM events GROUP BY ALL")
def cross_counts(spark, sf):
    return features.cross_counts(table(spark, sf, "events").select(F.col("event_type").alias("a"), F.col("user_id").alias("b")), "a", "b")


# --- versioned streams


def _raw_ranges(spark, sf) -> DataFrame:
    return stream(spark, sf).select("uuid", F.col("time_ns").alias("start_ns"), (F.col("time_ns") + F.lit(900 * SECOND * 1000)).alias("end_ns"))


_MERGE = "x AS (SELECT *, max(end_ns) OVER (PARTITION BY uuid ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg), y AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ns > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY uuid ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS k FROM x), mr AS (SELECT uuid, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM y GROUP BY uuid, k)"
_RANGES = f"{_STREAM}, rg AS (SELECT uuid, time_ns AS start_ns, time_ns + {900 * SECOND * 1000} AS end_ns FROM v)"


@query(f"WITH {_RANGES}, {_MERGE.format(gap=0)} SELECT uuid, start_ns, end_ns FROM mr")
def merge_ranges(spark, sf):
    return versions.merge_ranges(_raw_ranges(spark, sf))


@query(f"WITH {_RANGES}, {_MERGE.format(gap=0)}, c AS (SELECT uuid, start_ns, end_ns, unnest(range(start_ns >> 42, ((end_ns - 1) >> 42) + 1)) AS k FROM mr) SELECT uuid, greatest(start_ns, k << 42) AS start_ns, least(end_ns, (k + 1) << 42) AS end_ns FROM c")
def aligned_chunks(spark, sf):
    return versions.slices(versions.merge_ranges(_raw_ranges(spark, sf)), 42)


@query(f"WITH {_STREAM}, rg AS (SELECT uuid, time_ns AS start_ns, time_ns + 1 AS end_ns FROM v WHERE version > 3 AND version <= 5), {_MERGE.format(gap=1200 * SECOND * 1000)} SELECT uuid, start_ns, end_ns FROM mr")
def changed_ranges(spark, sf):
    return versions.changed_ranges(stream(spark, sf), 3, 5, 1200 * SECOND * 1000)


def _unique_stream(spark, sf) -> DataFrame:
    """One row for each uuid, time and version, so that a snapshot is determined."""
    s = stream(spark, sf)
    return s.groupBy("uuid", "time_ns", "version").agg(F.max("value").alias("value"), F.bool_or("deleted").alias("deleted")).select(*s.columns)


_UNIQUE = f"{_STREAM}, u AS (SELECT uuid, time_ns, version, max(value) AS value, bool_or(deleted) AS deleted FROM v GROUP BY ALL)"


@query(f"WITH {_UNIQUE}, l AS (SELECT * FROM u WHERE version <= 4 QUALIFY row_number() OVER (PARTITION BY uuid, time_ns ORDER BY version DESC) = 1) SELECT uuid, time_ns, value FROM l WHERE NOT deleted")
def snapshot_at_version(spark, sf):
    return versions.snapshot(_unique_stream(spark, sf), 4)


@query(f"WITH {_STREAM} SELECT uuid, max(version) AS version FROM v GROUP BY uuid")
def current_versions(spark, sf):
    return versions.current_versions(stream(spark, sf))


def _hourly(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    hour = 3600 * SECOND * 1000
    return rows.groupBy("uuid", (F.floor(F.col("time_ns") / F.lit(hour)) * hour).alias("time_ns")).agg(F.avg("value").alias("value"))


@query(f"WITH {_UNIQUE}, l AS (SELECT * FROM u WHERE version <= 6 QUALIFY row_number() OVER (PARTITION BY uuid, time_ns ORDER BY version DESC) = 1) SELECT uuid, time_ns // {3600 * SECOND * 1000} * {3600 * SECOND * 1000} AS time_ns, round(avg(value), 6) AS value FROM l WHERE NOT deleted GROUP BY ALL")
def incremental_equals_full(spark, sf):
    """An hourly mean brought from nothing to version 3, then to 6 by its changed ranges."""
    hour = 3600 * SECOND * 1000
    s = _unique_stream(spark, sf)
    d = versions.Distillate("hourly", _hourly, before=hour, after=hour)
    empty = s.limit(0).select("uuid", "time_ns", "value")
    out, control, _ = versions.refresh(d, s, empty, None, 3)
    out, _, _ = versions.refresh(d, s, out, control, 6)
    return rounded(out)


def _replayed(spark, sf, make, name: str) -> DataFrame:
    """A stream of the events file, run to its end; the complete result of the last batch is a table in the shared folder."""
    rows = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    live = rows.select(F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), "value")
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/result")
    q = make(live).writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/result")


@query("SELECT event_type AS sensor, epoch_us(ts) // 21600000000 * 21600000000 AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    out = _replayed(spark, sf, lambda s: versions.live_windows(s, "6 hours", "40 days"), "stream_tumbling_out")
    return rounded(out.select("sensor", micros("start").alias("start_us"), "n", "mean"))


@query("WITH p AS (SELECT event_type AS sensor, epoch_us(ts) AS t, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events), q AS (SELECT *, sum(new) OVER (PARTITION BY sensor ORDER BY t, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM p) SELECT sensor, min(t) AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM q GROUP BY sensor, k")
def stream_session(spark, sf):
    out = _replayed(spark, sf, lambda s: versions.live_sessions(s, "30 minutes", "40 days"), "stream_session_out")
    return rounded(out.select("sensor", micros("start").alias("start_us"), "n", "mean"))


@query("""WITH r AS (SELECT event_type AS sensor, epoch_us(ts) AS t, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
  p AS (SELECT *, lag(value) OVER w AS pv, lag(t) OVER w AS pt FROM r WINDOW w AS (PARTITION BY sensor ORDER BY t, value))
SELECT sensor, t, round(value, 6) AS value, round(value - pv, 6) AS diff, t - pt AS gap, CAST(coalesce(abs(value - pv) >= 150, false) AS INT) AS event FROM p""")
def live_differences(spark, sf):
    """The events replayed as a stream, six hours held back; what waits or came late takes its place at the end."""
    rows = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    told = live.live_differences(readings(rows, "event_type", "ts", "value"), 6 * HOUR, 150.0)
    live.write_live(told, f"{folder}/rows", f"{folder}/late", f"{folder}/state").awaitTermination()
    late = spark.read.parquet(f"{folder}/late").select(F.col("uuid").alias("sensor"), F.expr("time_ns div 1000").alias("t"), "value")
    return rounded(live.corrected(spark.read.parquet(f"{folder}/rows"), late.union(live.waiting(spark, f"{folder}/state")), 150.0))


def _cents(df: DataFrame) -> DataFrame:
    """Means from sums in whole cents, so that the order of adding doesn't show in the last digit."""
    return df.withColumn("mean", F.round(F.col("mean") * F.col("count"), 2) / F.col("count"))


def _grown_pyramid(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A store of windows of version 3 brought up to version 4, and the stream."""
    s = _unique_stream(spark, sf)
    folder = f"{shared_folder(spark)}/pyramid-{uuid.uuid4().hex}"
    pyramid.build(s, 3).write.parquet(folder)
    pyramid.updated(spark.read.parquet(folder), s, 3, 4).write.mode("append").parquet(folder)
    return spark.read.parquet(folder), s


_LAST = f"{_UNIQUE}, l AS (SELECT * FROM u WHERE version <= 4 QUALIFY row_number() OVER (PARTITION BY uuid, time_ns ORDER BY version DESC) = 1), k AS (SELECT uuid, time_ns, value FROM l WHERE NOT deleted)"


@query(f"WITH {_LAST} SELECT uuid, time_ns >> 43 << 43 AS time, count(*) AS count, min(value) AS min, round(round(sum(value), 2) / count(*), 6) AS mean, max(value) AS max FROM k WHERE time_ns >= ({START}000 >> 43 << 43) AND time_ns < ({END}000 >> 43 << 43) GROUP BY ALL")
def pyramid_windows(spark, sf):
    return rounded(_cents(pyramid.windows(_grown_pyramid(spark, sf)[0], START * 1000, END * 1000, 43)))


@query(f"WITH {_LAST}, a AS (SELECT i AS range, e.uuid, {START}000 + i * {13 * HOUR}000 AS s, {START}000 + i * {13 * HOUR}000 + (i + 1) * {11 * HOUR}000 + {7 * MINUTE}000 AS e FROM (SELECT DISTINCT uuid FROM v) e, (SELECT unnest(range(50)) AS i)) SELECT CAST(range AS INT) AS range, a.uuid, count(*) AS count, min(value) AS min, round(round(sum(value), 2) / count(*), 6) AS mean, max(value) AS max FROM a JOIN k ON k.uuid = a.uuid AND time_ns >= s AND time_ns < e GROUP BY ALL")
def pyramid_ranges(spark, sf):
    store, s = _grown_pyramid(spark, sf)
    i = F.col("range")
    ranges = s.select("uuid").distinct().withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(49))))
    begin = F.lit(START * 1000) + i * F.lit(13 * HOUR * 1000)
    ranges = ranges.select("range", "uuid", begin.alias("start_ns"), (begin + (i + 1) * F.lit(11 * HOUR * 1000) + F.lit(7 * MINUTE * 1000)).alias("end_ns"))
    return rounded(_cents(pyramid.range_statistics(store, versions.snapshot(s, 4), ranges)))


# --- likelihoods


@query(f"WITH {_WIDE} SELECT round(avg(CASE WHEN flag IN ('A', 'R') AND qty IN (1, 2) THEN 1.0 ELSE 0.0 END), 6) AS prob FROM w")
def joint_prob(spark, sf):
    return rounded(likelihood.joint_probability(wide(spark, sf), {"flag": ["A", "R"], "qty": [1, 2]}))


@query(f"WITH {_WIDE} SELECT round(coalesce(count(*) FILTER (flag = 'A' AND qty = 3) / nullif(count(*) FILTER (qty = 3), 0), 0), 6) AS prob FROM w")
def cond_prob(spark, sf):
    return rounded(likelihood.conditional_probability(wide(spark, sf), {"flag": ["A"]}, {"qty": [3]}))


@query(f"WITH {_WIDE}, g AS (SELECT * FROM (SELECT DISTINCT flag FROM w), (SELECT DISTINCT disc FROM w)), p AS (SELECT flag, disc, avg(CASE WHEN qty IN (0, 4) THEN 1.0 ELSE 0.0 END) AS prob FROM w GROUP BY ALL) SELECT flag, disc, round(coalesce(prob, 0), 6) AS prob FROM g LEFT JOIN p USING (flag, disc)")
def cause_likelihood(spark, sf):
    return rounded(likelihood.cause_likelihood(wide(spark, sf), ["flag", "disc"], "qty", [0, 4]))


@query(f"WITH {_WIDE} SELECT qty, round(count(*) FILTER (flag = 'N') / (SELECT count(*) FROM w WHERE flag = 'N'), 6) AS prob FROM w GROUP BY qty")
def effect_prob(spark, sf):
    return rounded(likelihood.effect_probability(wide(spark, sf), "qty", {"flag": ["N"]}))


_LH = f"{_R}, {_S}, {_M}, {_STATES}, pk AS (SELECT name, {{x}}(state) AS peak FROM st GROUP BY name), lh AS (SELECT e.name AS effect, peak, c.name AS cause, c.state, avg(CASE WHEN e.state = peak THEN 1.0 ELSE 0.0 END) AS prob FROM st e JOIN pk ON e.name = pk.name JOIN st c ON e.slot = c.slot AND e.name <> c.name GROUP BY ALL)"
_BEST = "br AS (SELECT effect, cause, state AS opt_state, prob AS opt_prob FROM lh QUALIFY row_number() OVER (PARTITION BY effect, cause ORDER BY prob DESC, state) = 1)"


@query(f"WITH {_LH.format(x='max')}, {_BEST} SELECT effect, cause, opt_state, round(opt_prob, 6) AS opt_prob FROM br")
def best_state_rank(spark, sf):
    return rounded(likelihood.best_states(likelihood.state_likelihoods(simple_states(spark, sf))))


@query(f"WITH a AS (WITH {_LH.format(x='min')} SELECT *, 'min' AS extreme FROM lh), b AS (WITH {_LH.format(x='max')} SELECT *, 'max' AS extreme FROM lh) SELECT effect, peak, cause, state, round(prob, 6) AS prob, extreme FROM (FROM a UNION ALL FROM b)")
def peak_analysis(spark, sf):
    return rounded(likelihood.peak_analysis(simple_states(spark, sf)))


@query(f"WITH {_LH.format(x='max')}, {_BEST} SELECT effect, cause, opt_state, round(opt_prob, 6) AS opt_prob, CAST(row_number() OVER (PARTITION BY effect ORDER BY opt_prob DESC, cause) AS INT) AS rank FROM br QUALIFY rank <= 2")
def top_causes(spark, sf):
    return rounded(likelihood.top_causes(likelihood.best_states(likelihood.state_likelihoods(simple_states(spark, sf))), 2))


@query(f"WITH {_LH.format(x='max')}, {_BEST} SELECT effect, round(stddev_pop(opt_prob), 6) AS spread FROM br GROUP BY effect")
def likelihood_spread(spark, sf):
    return rounded(likelihood.likelihood_spread(likelihood.best_states(likelihood.state_likelihoods(simple_states(spark, sf)))))


_SHARE = f"{_DATED}, c AS (SELECT name, month AS level, state, count(*) AS n FROM d GROUP BY ALL), f AS (SELECT l.name, l.level, v.state, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY l.name, l.level) AS prob FROM (SELECT DISTINCT name, level FROM c) l JOIN (SELECT DISTINCT name, state FROM c) v ON l.name = v.name LEFT JOIN c ON c.name = l.name AND c.level = l.level AND c.state = v.state)"
_SENS = f"WITH {_SHARE}, pr AS (SELECT p.name, p.level, q.level AS other, {{d}} AS d FROM f p JOIN f q ON p.name = q.name AND p.state = q.state GROUP BY ALL) SELECT name, round(avg(d), 5) AS sensitivity FROM pr GROUP BY name"


@query(_SENS.format(d="sqrt(1 - least(1, sum(sqrt(p.prob * q.prob))))"))
def sensitivity_hellinger(spark, sf):
    return rounded(likelihood.sensitivity(dated_states(spark, sf), "month", "h"), 5)


@query(_SENS.format(d="-ln(least(1, sum(sqrt(p.prob * q.prob))))"))
def sensitivity_bhatt(spark, sf):
    return rounded(likelihood.sensitivity(dated_states(spark, sf), "month", "b"), 5)


@query(_SENS.format(d="0.5 * least(1, sum(abs(p.prob - q.prob)))"))
def sensitivity_tv(spark, sf):
    return rounded(likelihood.sensitivity(dated_states(spark, sf), "month", "v"), 5)


_HELLINGER = "sqrt(1 - least(1, sum(sqrt(p.prob * q.prob))))"


def _sens_of(factor: str) -> str:
    return _SENS.format(d=_HELLINGER).replace("month AS level", f"{factor} AS level").replace("round(avg(d), 5)", "avg(d)")


@query(f"WITH a AS (SELECT *, 'month' AS factor FROM ({_sens_of('month')}) UNION ALL SELECT *, 'weekday' FROM ({_sens_of('weekday')})) SELECT name, factor, round(sensitivity, 5) AS sensitivity, round(sum(sensitivity) OVER (PARTITION BY name), 5) AS total FROM a")
def sensitivity_report(spark, sf):
    return rounded(likelihood.sensitivity_report(dated_states(spark, sf), ["month", "weekday"], "h"), 5)


@query(f"WITH a AS (SELECT *, 'month' AS factor FROM ({_sens_of('month')}) UNION ALL SELECT *, 'weekday' FROM ({_sens_of('weekday')})), t AS (SELECT name, sum(sensitivity) AS total FROM a GROUP BY name) SELECT name, round(total, 5) AS total, CAST(row_number() OVER (ORDER BY total DESC, name) AS INT) AS rank FROM t QUALIFY rank <= 2")
def most_sensitive(spark, sf):
    return rounded(likelihood.most_sensitive(likelihood.sensitivity_report(dated_states(spark, sf), ["month", "weekday"], "h"), 2), 5)


@query(f"WITH {_DATED} SELECT name, month, weekday, hour, state, round(count(*) / sum(count(*)) OVER (PARTITION BY name, month, weekday, hour), 6) AS prob FROM d GROUP BY name, month, weekday, hour, state")
def time_effect_map(spark, sf):
    return rounded(likelihood.time_effect_map(dated_states(spark, sf)))


@query(f"WITH {_DATED}, p AS (SELECT name, month, weekday, hour, state, count(*) / sum(count(*)) OVER (PARTITION BY name, month, weekday, hour) AS prob FROM d GROUP BY name, month, weekday, hour, state), k AS (SELECT m.name, month, weekday, hour, state FROM (SELECT DISTINCT name, month FROM p) m JOIN (SELECT DISTINCT name, weekday, hour, state FROM p) c ON m.name = c.name), f AS (SELECT k.*, coalesce(prob, 0) AS prob FROM k LEFT JOIN p USING (name, month, weekday, hour, state)) SELECT a.name, a.month, b.month AS other, round(sqrt(sum((a.prob - b.prob) * (a.prob - b.prob))), 6) AS distance FROM f a JOIN f b USING (name, weekday, hour, state) WHERE a.month < b.month GROUP BY ALL")
def month_distances(spark, sf):
    return rounded(likelihood.month_distances(likelihood.time_effect_map(dated_states(spark, sf))))


_IRR = f"{_R}, {_S}, {_M}, {_STATES}, c AS (SELECT name, state, count(*) AS n FROM st GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n, state) AS i, count(*) OVER (PARTITION BY name) AS m FROM c), h AS (SELECT *, max(n) FILTER (i = 1) OVER (PARTITION BY name) AS n1, max(n) FILTER (i = 2) OVER (PARTITION BY name) AS n2, max(n) FILTER (i = 3) OVER (PARTITION BY name) AS n3 FROM k), ir AS (SELECT st.name, slot, CAST(m > 1 AND (i = 1 OR i = 2 AND coalesce((n1 + n2) * 10 < n3, false)) AS INT) AS irregular FROM st JOIN h ON st.name = h.name AND st.state = h.state)"


@query(f"WITH {_IRR} SELECT * FROM ir")
def irregular_state(spark, sf):
    return likelihood.irregular_states(simple_states(spark, sf))


@query(f"WITH {_IRR}, z AS (SELECT name, sum(irregular)::DOUBLE AS a, count(*) FILTER (irregular = 0)::DOUBLE AS b FROM ir GROUP BY name) SELECT name, CASE WHEN a * b > 0 THEN round(abs(a - b) / sqrt(a * b), 6) END AS skew FROM z")
def irregular_skew(spark, sf):
    return rounded(likelihood.irregular_skew(likelihood.irregular_states(simple_states(spark, sf))))


@query(f"WITH {_WIDE} SELECT flag, qty, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY flag), 6) AS prob FROM w GROUP BY flag, qty")
def conditional_table(spark, sf):
    return rounded(networks.conditional_table(wide(spark, sf), "qty", ["flag"]))


# --- distances, clusters, networks

_NORM = f"{_R}, {_S}, {_M}, x AS (SELECT sensor, avg(value) AS mean, sqrt(sum(value * value)) AS norm FROM m GROUP BY sensor), z AS (SELECT sensor, slot, (value - mean) / norm AS value FROM m JOIN x USING (sensor)), zz AS (SELECT s.sensor, g.slot, coalesce(value, 0) AS value FROM (SELECT DISTINCT sensor FROM z) s, (SELECT DISTINCT slot FROM z) g LEFT JOIN z ON z.sensor = s.sensor AND z.slot = g.slot), dd AS (SELECT a.sensor AS a, b.sensor AS b, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d FROM zz a JOIN zz b ON a.slot = b.slot AND a.sensor < b.sensor GROUP BY ALL)"


def _norm(spark, sf) -> DataFrame:
    return clean.normalise(means(spark, sf)).select("sensor", "slot", F.col("normalised").alias("value"))


@query(f"WITH {_NORM} SELECT a, b, round(d, 6) AS d FROM dd")
def pairwise_distance(spark, sf):
    return rounded(clusters.distances(_norm(spark, sf)))


@query(f"WITH {_NORM} SELECT round(min(d), 6) AS min_d, round(max(d), 6) AS max_d, round(avg(d), 6) AS avg_d FROM dd")
def distance_summary(spark, sf):
    return rounded(clusters.distance_summary(clusters.distances(_norm(spark, sf))))


@query(f"WITH {_NORM}, n AS (SELECT DISTINCT sensor FROM z) SELECT x.sensor AS a, y.sensor AS b, round(CASE WHEN x.sensor = y.sensor THEN 0 ELSE coalesce(p.d, q.d, 2.0) END, 6) AS d FROM n x, n y LEFT JOIN dd p ON p.a = x.sensor AND p.b = y.sensor LEFT JOIN dd q ON q.a = y.sensor AND q.b = x.sensor")
def distance_matrix(spark, sf):
    f = _norm(spark, sf)
    return rounded(clusters.full_matrix(clusters.distances(f), f))


@query(f"WITH {_R}, {_S}, {_M}, {_STATES} SELECT name, CASE WHEN stddev_pop(st.state) > 0 AND stddev_pop(m.value) > 0 THEN round(corr(st.state, m.value), 3) END AS r FROM st JOIN m ON st.name = m.sensor AND st.slot = m.slot GROUP BY name")
def pearson_state(spark, sf):
    m = means(spark, sf).withColumnRenamed("sensor", "name")
    return simple_states(spark, sf).join(m, ["name", "slot"]).groupBy("name").agg(likelihood.correlation("state", "value").alias("r"))


_NAMES = "t AS (SELECT DISTINCT p_type AS name, unnest(list_distinct(string_split(p_type, ' '))) AS token FROM part), sz AS (SELECT name, count(*) AS k FROM t GROUP BY name), sh AS (SELECT a.name AS a, b.name AS b, count(*) AS c FROM t a JOIN t b ON a.token = b.token AND a.name < b.name GROUP BY ALL)"


@query(f"WITH {_NAMES} SELECT x.name AS a, y.name AS b, CAST(x.k + y.k - 2 * coalesce(c, 0) AS DOUBLE) AS distance FROM sz x JOIN sz y ON x.name < y.name LEFT JOIN sh ON sh.a = x.name AND sh.b = y.name")
def name_similarity(spark, sf):
    return clusters.name_similarity(table(spark, sf, "part"), "p_type")


@query()
def cluster_exemplars(spark, sf):
    f = _norm(spark, sf)
    return clusters.cluster(clusters.distances(f), f)


@query()
def cluster_packs(spark, sf):
    f = _norm(spark, sf)
    return clusters.cluster(clusters.distances(f), f, "pack", 0.1)


@query()
def cluster_quality(spark, sf):
    f = _norm(spark, sf)
    d = clusters.distances(f)
    return clusters.cluster_quality(d, clusters.cluster(d, f))


@query()
def kmeans_states(spark, sf):
    return states.peak_states(means(spark, sf))


@query()
def irregular_events(spark, sf):
    return states.irregular_events(events(spark, sf))


#: Columns that depend on each other by rule: the half year on the quarter, big orders on the quantity.
NET = ["quarter", "half", "qty", "big"]


def dependent(spark, sf) -> DataFrame:
    quarter = F.quarter("l_shipdate") - 1
    qty = F.floor(F.col("l_quantity") / 10).cast("int")
    noisy = F.when(F.col("l_orderkey") % 10 == 0, F.lit(1)).otherwise((qty > 2).cast("int"))
    return table(spark, sf, "lineitem").select(quarter.cast("int").alias("quarter"), F.floor(quarter / 2).cast("int").alias("half"), qty.alias("qty"), noisy.alias("big"))


_NET = "w AS (SELECT CAST(quarter(l_shipdate) - 1 AS INT) AS quarter, CAST((quarter(l_shipdate) - 1) // 2 AS INT) AS half, CAST(floor(l_quantity / 10) AS INT) AS qty, CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE CAST(floor(l_quantity / 10) > 2 AS INT) END AS big FROM lineitem)"


def _families() -> list[tuple[str, list[str]]]:
    return [(c, [p for j, p in enumerate(rest) if k >> j & 1]) for c in NET for rest in [[v for v in NET if v != c]] for k in range(8)]


def _family_sql(child: str, parents: list[str]) -> str:
    whole = f"GROUP BY {', '.join(parents)}" if parents else ""
    size = " * ".join(["1.0", *[f"(SELECT count(DISTINCT {p}) FROM w)" for p in parents]])
    return f"SELECT '{child}' AS child, '{','.join(parents)}' AS parents, (SELECT sum(n * ln(n)) FROM (SELECT count(*) AS n FROM w GROUP BY {", ".join([*parents, child])})) - (SELECT sum(n * ln(n)) FROM (SELECT count(*) AS n FROM w {whole})) - ln((SELECT count(*) FROM w)) / 2 * {size} * ((SELECT count(DISTINCT {child}) FROM w) - 1) AS bic"


_FAMILIES = f"{_NET}, fb AS ({' UNION ALL '.join(_family_sql(*f) for f in _families())})"


@query(f"WITH {_FAMILIES} SELECT child, parents, round(bic, 4) AS bic FROM fb")
def family_scores(spark, sf):
    """The BIC of every family of four variables."""
    s = networks.FamilyScores(dependent(spark, sf), NET)
    rows = [(c, ",".join(p), x) for (c, p), x in zip(_families(), s.scores(_families()))]
    s.close()
    return rounded(spark.createDataFrame(rows, "child string, parents string, bic double"), 4)


# The best network: of all orders of the variables, the one whose best families from variables before them sum highest.
_ORDERS = " UNION ALL ".join(f"SELECT {i} AS o, {k} AS place, '{v}' AS v" for i, order in enumerate(itertools.permutations(NET)) for k, v in enumerate(order))


@query(f"WITH {_FAMILIES}, od AS ({_ORDERS}), bf AS (SELECT a.o, a.v, max(bic) AS bic FROM od a JOIN fb ON fb.child = a.v WHERE NOT EXISTS (SELECT 1 FROM od b WHERE b.o = a.o AND b.place >= a.place AND contains(',' || fb.parents || ',', ',' || b.v || ',')) GROUP BY ALL) SELECT 'lines' AS model_id, round(max(total), 4) AS bic FROM (SELECT o, sum(bic) AS total FROM bf GROUP BY o)")
def best_network(spark, sf):
    """The score of the network that hill climbing finds, beside the best of all networks."""
    _, score = networks.hill_climb(dependent(spark, sf), NET)
    return rounded(spark.createDataFrame([("lines", float(score))], "model_id string, bic double"), 4)


@query()
def bn_edges(spark, sf):
    edges, _ = networks.hill_climb(dependent(spark, sf), NET)
    return networks.edges_table(spark, "lines", edges)


# --- scalar functions


@query("SELECT o_orderpriority AS symbol, CAST(row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) AS INT) AS code FROM orders GROUP BY o_orderpriority")
def symbol_encode(spark, sf):
    return weather.symbol_codes(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN regexp_matches(translate(p_name, './- ', '____'), '^[0-9]') THEN 'a_' ELSE '' END || translate(p_name, './- ', '____') AS clean, upper('T_' || translate(p_type, '/- ', '___')) AS table_name FROM part")
def clean_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalar.clean_name("p_name").alias("clean"), scalar.table_name("p_type").alias("table_name"))


@query("SELECT event_id, CAST(month(ts) - 1 AS INT) AS month, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour FROM events")
def time_states(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.cast("int").alias(k) for k, c in scalar.calendar(micros("ts")).items()])


@query(r"SELECT regexp_replace(p_name, '\s+\S+\s*$', '') AS phrase, count(*) AS n FROM part GROUP BY ALL")
def token_count(spark, sf):
    return features.token_frequency(table(spark, sf, "part"), "p_name")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-') AS k, coalesce(json_extract_string(props, '$.missing'), '-') AS missing FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", *[F.coalesce(F.get_json_object("props", f"$.{c}"), F.lit("-")).alias(c) for c in ("k", "missing")])


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) * 1000 + 500000000 AS ns FROM events")
def parse_nanoseconds(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.parse_nanoseconds(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5"))).alias("ns"))


_CONDITIONS = ["Clear", "Partly Cloudy", "Scattered Clouds", "Mostly Cloudy", "Overcast", "Fog", "Mist", "Patches of Fog", "Light Drizzle", "Heavy Rain", "Thunderstorms and Rain", "Light Freezing Rain", "Ice Pellets", "Light Snow", "Snow Showers", "Unknown", "Haze"]
_EVENTS = ["", "Rain", "Snow", "Fog", "Rain-Snow", "Fog-Rain", "Fog-Snow", "Rain-Thunderstorm", "Thunderstorm", "Hail"]


@query(f"""WITH t AS (SELECT {_CONDITIONS}[o_orderkey % {len(_CONDITIONS)} + 1] AS conditions, {_EVENTS}[o_custkey % {len(_EVENTS)} + 1] AS events FROM orders)
SELECT conditions, events, CASE WHEN conditions = 'Clear' THEN 8 WHEN conditions IN ('Partly Cloudy', 'Scattered Clouds') THEN 7 WHEN conditions IN ('Mostly Cloudy', 'Overcast') THEN 6
  WHEN conditions IN ('Fog', 'Mist', 'Patches of Fog') THEN 5 WHEN conditions = 'Light Drizzle' THEN 4 WHEN conditions IN ('Heavy Rain', 'Thunderstorms and Rain', 'Light Freezing Rain') THEN 3
  WHEN conditions = 'Ice Pellets' THEN 2 WHEN conditions IN ('Light Snow', 'Snow Showers') THEN 1 WHEN conditions = 'Unknown' THEN 0 END AS conditions_class,
  CASE WHEN events = '' THEN 0 WHEN events IN ('Snow', 'Rain-Snow', 'Fog-Snow') THEN 1 WHEN events IN ('Rain', 'Thunderstorm', 'Rain-Thunderstorm') THEN 2 WHEN events IN ('Fog', 'Fog-Rain') THEN 3 END AS events_class,
  count(*) AS n FROM t GROUP BY ALL""")
def class_map(spark, sf):
    """Weather texts, dealt to the orders by their keys, and their classes; texts that no class has are null."""
    pick = lambda texts, key: F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))
    o = table(spark, sf, "orders").select(pick(_CONDITIONS, "o_orderkey").alias("conditions"), pick(_EVENTS, "o_custkey").alias("events"))
    o = weather.classify(weather.classify(o, "conditions", weather.CONDITION_CLASSES), "events", weather.EVENT_CLASSES)
    return o.groupBy("conditions", "events", "conditions_class", "events_class").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, 'u' || s_suppkey AS uuid, CASE WHEN s_suppkey % 2 = 0 THEN 'kW' ELSE '-' END AS unit,
  CASE s_suppkey % 4 WHEN 0 THEN 'Power' WHEN 1 THEN '-' WHEN 2 THEN s_name ELSE '-' END AS sensor_type, CASE s_suppkey % 4 WHEN 0 THEN 'P1' WHEN 1 THEN '-' WHEN 2 THEN 'M2' ELSE '-' END AS node_id,
  CASE s_suppkey % 4 WHEN 0 THEN s_nationkey || 'FL' WHEN 1 THEN '-' WHEN 2 THEN 'point' ELSE '-' END AS floor, CASE s_suppkey % 4 WHEN 0 THEN '-' WHEN 1 THEN 'R1' WHEN 2 THEN 'area' ELSE 'told' END AS room,
  CASE s_suppkey % 4 WHEN 0 THEN '2m' WHEN 1 THEN '-' WHEN 2 THEN 'op' ELSE '-' END AS installed, CASE s_suppkey % 4 WHEN 2 THEN 'kind' ELSE '-' END AS additional FROM supplier""")
def sensor_metadata(spark, sf):
    """Metadata texts of four kinds, one for each branch of the rules, and the fields found in them."""
    s, kind = table(spark, sf, "supplier"), F.col("s_suppkey") % 4
    inner = (
        F.when(kind == 0, F.format_string('{"Instrument": {"SensorType": "Power", "PartNumber": "P1"}, "SourceName": "x", "Location": {"Floor": "%s", "Height": "2m"}}', F.col("s_nationkey").cast("string")))
        .when(kind == 1, F.lit('{"Instrument": {}, "Location": {"RoomNumber": "R1"}, "PointName": "no"}'))
        .when(kind == 2, F.format_string('{"SourceName": "%s", "PointName": "point", "Extra": {"MeterName": "M2", "ServiceArea": "area", "Operator": "op", "Type": "kind"}}', "s_name"))
        .otherwise(F.lit("{}"))
    )
    unit = F.when(F.col("s_suppkey") % 2 == 0, F.lit('{"UnitofMeasure": "kW"}')).otherwise(F.lit("{}"))
    text = F.format_string('{"uuid": "u%s", "Description": "told", "Properties": %s, "Metadata": %s}', F.col("s_suppkey").cast("string"), unit, inner)
    found = scalar.metadata("text")
    return s.withColumn("text", text).select("s_suppkey", *[found[k].alias(k) for k in ("uuid", "unit", "sensor_type", "node_id", "floor", "room", "installed", "additional")])


@query("WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k, 'both' AS side FROM (FROM a INTERSECT FROM b) UNION ALL SELECT k, 'any' FROM (FROM a UNION FROM b) UNION ALL SELECT k, 'only' FROM (FROM a EXCEPT FROM b)")
def set_ops(spark, sf):
    a = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    marked = [(a.intersect(b), "both"), (a.union(b).distinct(), "any"), (a.subtract(b), "only")]
    out = [d.withColumn("side", F.lit(s)) for d, s in marked]
    return out[0].union(out[1]).union(out[2])


@query()
def explained_peaks(spark, sf):
    """The whole analysis of the events: ranked causes of every sensor's peaks."""
    from .analysis import analyse

    r = events(spark, sf)
    names = [x["sensor"] for x in r.select("sensor").distinct().orderBy("sensor").collect()]
    return analyse(r, START, END, DAY, names, tags=["avg"]).ranked


@query()
def explained_networks(spark, sf):
    """Causes and the four networks of one sensor, average and difference, with weather: shipped quantities by month explained by
    what was ordered then, as JSON texts."""
    from .analysis import analyse

    pick = F.element_at(F.array(*map(F.lit, _CONDITIONS)), (F.floor(F.col("o_totalprice") / 20000) % len(_CONDITIONS) + 1).cast("int"))
    weather_rows = table(spark, sf, "orders").select(micros("o_orderdate").alias("t"), (F.col("o_totalprice") / 10000).cast("string").alias("TemperatureC"), pick.alias("Conditions"))
    found = analyse(lines(spark, sf), LINE_START, LINE_END, LINE_WIDTH, ["R"], n_causes=3, weather=weather_rows)
    return files.summary_json(found.ranked, found.edges)


@query()
def network_graphs(spark, sf):
    """Learnt edges as graph JSON."""
    from tsengine.sources import exports

    return exports.graph_json(bn_edges(spark, sf))


@query(f"WITH {_LH.format(x='max')}, {_BEST} SELECT effect, cause, opt_state, round(opt_prob, 6) AS opt_prob FROM br WHERE opt_prob > 0.5")
def likely_causes(spark, sf):
    best = likelihood.best_states(likelihood.state_likelihoods(simple_states(spark, sf)))
    return rounded(likelihood.likely(best, 0.5).select("effect", "cause", "opt_state", "opt_prob"))


@query(f"WITH {_R} SELECT sensor, epoch_us((make_timestamp(t) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'Europe/Helsinki') AS t, value FROM r")
def zone_repaired(spark, sf):
    return clean.repair_zone(events(spark, sf), "America/Los_Angeles", "Europe/Helsinki").select("sensor", "t", "value")


@query("SELECT s_name AS name, s_nationkey AS nation, CASE WHEN s_acctbal > 0 THEN s_suppkey END AS id FROM supplier")
def name_to_id(spark, sf):
    s = table(spark, sf, "supplier")
    names = s.filter("s_acctbal > 0").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return align.with_ids(s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), names)


_CLUSTERED = """q AS (SELECT CAST(month(l_shipdate) AS INT) AS month, CAST(l_suppkey AS VARCHAR) AS sensor, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY ALL),
  cl AS (SELECT month, sensor, mean, min(sensor) OVER (PARTITION BY month, CAST(sensor AS INT) % 7) AS exemplar FROM q WHERE sd > 0), n AS (SELECT month, exemplar, dense_rank() OVER (PARTITION BY month ORDER BY exemplar) - 1 AS k FROM (SELECT DISTINCT month, exemplar FROM cl)),
  lb AS (SELECT month, sensor, k || CASE WHEN sensor = exemplar THEN '*' ELSE '' END AS label, CAST(sensor = exemplar AS INT) AS sparsity FROM cl JOIN n USING (month, exemplar) UNION ALL SELECT month, sensor, '-', 0 FROM q WHERE sd = 0)"""


def _monthly_clusters(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Suppliers by the rest of their key by seven in each month, and those whose quantity doesn't vary."""
    q = table(spark, sf, "lineitem").groupBy(F.month("l_shipdate").alias("month"), F.col("l_suppkey").cast("string").alias("sensor")).agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("sd"))
    of = q.filter("sd > 0").withColumn("_g", F.col("sensor").cast("int") % 7)
    least = of.groupBy("month", "_g").agg(F.min("sensor").alias("exemplar"))
    c = of.join(least, ["month", "_g"]).withColumn("is_exemplar", F.col("sensor") == F.col("exemplar"))
    centre = of.select("month", F.col("sensor").alias("exemplar"), F.col("mean").alias("_m"))
    found = c.join(centre, ["month", "exemplar"]).select("month", "sensor", "exemplar", "is_exemplar", F.abs(F.col("mean") - F.col("_m")).alias("error"))
    return found, q.filter("sd = 0").select("month", "sensor")


@query(f"WITH {_CLUSTERED} SELECT sensor, {', '.join(f'max(label) FILTER (month = {m}) AS m{m}' for m in range(1, 13))} FROM lb GROUP BY sensor")
def cluster_label_table(spark, sf):
    found, constant = _monthly_clusters(spark, sf)
    labels = clusters.cluster_labels(found, constant, ["month"])
    return clusters.label_table(labels, "month", list(range(1, 13))).withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})


@query(f"WITH {_CLUSTERED} SELECT sensor, sum(sparsity)::BIGINT AS months FROM lb GROUP BY sensor")
def cluster_sparsity(spark, sf):
    return clusters.cluster_labels(*_monthly_clusters(spark, sf), ["month"]).groupBy("sensor").agg(F.sum("sparsity").alias("months"))


@query(f"""WITH {_CLUSTERED}, e AS (SELECT month, c.exemplar, count(*) AS n, avg(abs(c.mean - x.mean)) AS err FROM cl c JOIN (SELECT month, sensor AS exemplar, mean FROM cl) x USING (month, exemplar) GROUP BY ALL),
  z AS (SELECT month, count(*) AS n_constant FROM q WHERE sd = 0 GROUP BY month), t AS (SELECT month, sum(n)::BIGINT AS n_labelled, count(*) AS n_clusters, avg(err) AS avg_error FROM e GROUP BY month)
SELECT month, coalesce(n_constant, 0) AS n_constant, coalesce(n_labelled, 0) AS n_labelled, coalesce(n_clusters, 0) AS n_clusters, round(n_labelled / n_clusters, 6) AS sensors_per_cluster, round(avg_error, 6) AS avg_error FROM t FULL JOIN z USING (month)""")
def cluster_statistics(spark, sf):
    return rounded(clusters.cluster_statistics(*_monthly_clusters(spark, sf), ["month"]))


@query()
def compared_clusterings(spark, sf):
    f = _norm(spark, sf)
    d = clusters.distances(f)
    return clusters.compare_clusterings(d, clusters.clusterings(d, f), clusters.distance_bounds(0.9), clusters.distance_bounds(0.1))


@query()
def mixture_states(spark, sf):
    return states.peak_states(means(spark, sf), method="mixture")


@query(f"""WITH t AS (SELECT {_CONDITIONS}[o_orderkey % {len(_CONDITIONS)} + 1] AS conditions FROM orders)
SELECT conditions, CASE WHEN conditions = 'Clear' THEN 5 WHEN conditions IN ('Partly Cloudy', 'Scattered Clouds') THEN 4 WHEN conditions IN ('Mostly Cloudy', 'Overcast') THEN 3
  WHEN conditions IN ('Mist', 'Patches of Fog', 'Light Drizzle', 'Light Freezing Rain', 'Light Snow') THEN 2 WHEN conditions IN ('Fog', 'Heavy Rain', 'Thunderstorms and Rain') THEN 1 WHEN conditions = 'Unknown' THEN 0 END AS conditions_class, count(*) AS n FROM t GROUP BY ALL""")
def older_class_map(spark, sf):
    pick = F.element_at(F.array(*map(F.lit, _CONDITIONS)), (F.col("o_orderkey") % len(_CONDITIONS) + 1).cast("int"))
    o = weather.classify(table(spark, sf, "orders").select(pick.alias("conditions")), "conditions", weather.OLDER_CONDITION_CLASSES)
    return o.groupBy("conditions", "conditions_class").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type AS sensor, epoch_us(date_trunc('minute', ts)) AS t, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND ts IS NOT NULL)
SELECT sensor, t + CASE WHEN count(*) OVER w = 1 THEN 30000000 ELSE (row_number() OVER (PARTITION BY sensor, t ORDER BY value) - 1) * 60000000 // count(*) OVER w END AS t, round(value, 6) AS value FROM r WINDOW w AS (PARTITION BY sensor, t)""")
def within_minutes(spark, sf):
    r = readings(table(spark, sf, "events"), "event_type", F.date_trunc("minute", F.col("ts").cast("timestamp_ntz")), "value")
    return rounded(align.within_minutes(r))


@query("""SELECT p_partkey, CASE WHEN r_name IS NULL THEN code ELSE r_name || '_' || kind || '_' || code4 END AS site_name FROM (
  SELECT p_partkey, 'XX' || p_partkey % 7 || 'u' || lpad((p_partkey % 100)::VARCHAR, 4, '0') || '-' || CASE WHEN p_size % 2 = 0 THEN 'KW' ELSE 'KVA' END AS code, lpad((p_partkey % 100)::VARCHAR, 4, '0') AS code4, CASE WHEN p_size % 2 = 0 THEN 'KW' ELSE 'KVA' END AS kind, p_partkey % 7 AS k FROM part)
  LEFT JOIN region ON r_regionkey = k""")
def site_names(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, "KW").otherwise("KVA")
    code = F.concat(F.lit("XX"), (F.col("p_partkey") % 7).cast("string"), F.lit("u"), F.lpad((F.col("p_partkey") % 100).cast("string"), 4, "0"), F.lit("-"), kind)
    names = table(spark, sf, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit("u")).alias("key"), F.col("r_name").alias("name"))
    return align.site_names(table(spark, sf, "part").select("p_partkey", code.alias("code")), "code", names, 2, 2, ("KW", "KVA")).select("p_partkey", "site_name")


@query("SELECT event_type AS sensor, epoch_us(ts) AS t, round(value, 6) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-25' AND value IS NOT NULL AND NOT isnan(value)")
def merged_parts(spark, sf):
    r = events(spark, sf)
    return rounded(files.merge_parts([align.in_range(r, START + k * 8 * DAY, START + (k + 1) * 8 * DAY) for k in range(3)]))
