"""Cleaning: type inference, outliers, gaps, normalisation, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsengine.model import FLOAT_TYPE, INT_TYPE, SECOND, settled

from . import ordered

#: (percent trimmed, standard deviations) of the outlier rule, by what is cleaned.
OUTLIER_RULES = {"weather": (5, 10), "slots": (1, 20), "raw": (1, 20)}


def num_type(n: Column, n_distinct: Column) -> Column:
    """INT_TYPE for few levels: more than 1000 values of fewer than 10 levels, or over 100 values a level; null without values."""
    few = F.when(n > 1000, n_distinct < 10).otherwise(n / n_distinct > 100)
    return F.when(n == 0, None).when(few, INT_TYPE).otherwise(FLOAT_TYPE)


def infer_types(df: DataFrame, keys: Sequence[str] = ("sensor",), value: str = "value") -> DataFrame:
    """(keys, n, n_distinct, num_type) of the values that aren't missing."""
    # one row for each key and level before the sums, so a frequent sensor is counted by all tasks
    levels = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    counted = levels.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(value).alias("n_distinct"))
    return counted.withColumn("num_type", F.when(F.col("n") > 0, num_type(F.col("n"), F.greatest(F.col("n_distinct"), F.lit(1)))))


def trim_bounds(df: DataFrame, keys: Sequence[str], value: str, percent: float, sigmas: float) -> DataFrame:
    """(keys, low, high): bounds outside of which a value is an outlier; null where 10 or fewer values are left.

    Values are trimmed by position, percent/2 at each side; the bounds lie `sigmas` population deviations beyond the rest.
    Positions come from counts of distinct values, so repeated values cost one row. These are range-sorted by key and value, so many
    values of one key are spread over many tasks; a range's place follows from one row a range and key.
    """
    levels = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(levels.repartitionByRange(ranges, *keys, "_v")).withColumn("_range", F.spark_partition_id())
    key, by = Window.partitionBy(*keys), Window.partitionBy(*keys, "_range").orderBy("_v")
    parts = dealt.groupBy(*keys, "_range").agg(F.sum("_c").alias("_m"))
    past = F.coalesce(F.sum("_m").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_past": past, "_n": F.sum("_m").over(key)}).drop("_m")
    placed = dealt.withColumn("_end", F.sum("_c").over(by)).join(parts, [*keys, "_range"]).withColumn("_end", F.col("_end") + F.col("_past"))
    cut = F.col("_n") * percent / 2 / 100
    first, stop = F.floor(cut), F.floor(F.col("_n") - cut)
    kept = F.least(F.col("_end"), stop) - F.greatest(F.col("_end") - F.col("_c"), first)
    rest = placed.withColumn("_k", kept.cast("double")).filter("_k > 0")
    # deviations from a nearby value keep the sums small: of a range from its least, then of ranges from the least of all
    k, d = F.col("_k"), F.col("_v") - F.col("_m")
    sums = rest.withColumn("_m", F.first("_v").over(by)).groupBy(*keys, "_range", "_m").agg(F.sum("_k").alias("_k"), F.sum(k * d).alias("_s"), F.sum(k * d * d).alias("_q"), F.max("_v").alias("_hi"))
    sums = sums.withColumn("_d", F.col("_m") - F.min("_m").over(key))
    total, s, d = F.sum("_k"), F.col("_s"), F.col("_d")
    mean = F.sum(s + k * d) / total
    spread = F.sqrt(F.greatest(F.sum(F.col("_q") + 2 * d * s + k * d * d) / total - mean * mean, F.lit(0.0)))
    enough = total > 10
    return sums.groupBy(*keys).agg(F.when(enough, F.min("_m") - sigmas * spread).alias("low"), F.when(enough, F.max("_hi") + sigmas * spread).alias("high"))


def mark_outliers(df: DataFrame, keys: Sequence[str] = ("sensor",), value: str = "value", percent: float = 1, sigmas: float = 20) -> DataFrame:
    """`df` with outlier boolean. The bounds, two numbers a key, are broadcast: a join by key would bring a key's rows to one task."""
    bounds = trim_bounds(df, keys, value, percent, sigmas)
    out = df.join(F.broadcast(bounds), list(keys), "left")
    return out.withColumn("outlier", F.coalesce((F.col(value) > F.col("high")) | (F.col(value) < F.col("low")), F.lit(False))).drop("low", "high")


def fill_gaps(slots: DataFrame, max_gap: int, keys: Sequence[str] = ("sensor",), nearest: bool | Column = False) -> DataFrame:
    """`slots` (keys, slot, value) with filled: inner missing values on the line between their neighbours, or the nearest one's
    (the earlier at a midpoint).

    The first and the last slot are never filled. A run of missing values between two known ones stays if it is longer than
    max_gap; a run that reaches an end takes the one neighbour it has.
    """
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("slot"), F.desc("slot")))
    point = F.when(F.col("value").isNotNull(), F.struct("slot", "value"))
    seen = slots.withColumns({
        "_b": F.last(point, True).over(up),
        "_a": F.last(point, True).over(down),
        "_lo": F.min("slot").over(Window.partitionBy(*keys)),
        "_hi": F.max("slot").over(Window.partitionBy(*keys)),
    })
    s, b, a = F.col("slot"), F.col("_b"), F.col("_a")
    run = a["slot"] - b["slot"] - 1
    line = b["value"] + (a["value"] - b["value"]) * (s - b["slot"]) / (a["slot"] - b["slot"])
    near = F.when(s - b["slot"] <= a["slot"] - s, b["value"]).otherwise(a["value"])
    between = F.when(nearest, near).otherwise(line) if isinstance(nearest, Column) else near if nearest else line
    edge = (s == F.col("_lo")) | (s == F.col("_hi"))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(edge | (run > max_gap), None).when(b.isNull(), a["value"]).when(a.isNull(), b["value"]).otherwise(between)
    return seen.withColumn("filled", filled).drop("_b", "_a", "_lo", "_hi")


def too_many_missing(slots: DataFrame, keys: Sequence[str] = ("sensor",), value: str = "filled") -> DataFrame:
    """(keys, n, n_missing, excluded): columns of which more than a fifth is still missing are excluded."""
    counted = slots.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"))
    return counted.withColumn("excluded", F.col("n_missing") > F.col("n") / 5)


def normalise(df: DataFrame, keys: Sequence[str] = ("sensor",), value: str = "value") -> DataFrame:
    """`df` with normalised: the value less the mean, over the Euclidean norm of the values; null for a column whose middle 90 %
    (by position) is constant."""
    levels = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    by = Window.partitionBy(*keys)
    placed = levels.withColumns({"_end": F.sum("_c").over(by.orderBy("_v")), "_n": F.sum("_c").over(by)})
    middle = (F.col("_end") > F.floor(F.col("_n") * 0.05)) & (F.col("_end") - F.col("_c") < F.floor(F.col("_n") * 0.95))
    stats = placed.groupBy(*keys).agg(
        (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_mean"),
        F.sqrt(F.sum(F.col("_v") * F.col("_v") * F.col("_c"))).alias("_norm"),
        (F.min(F.when(middle, F.col("_v"))) < F.max(F.when(middle, F.col("_v")))).alias("_varies"),
    )
    out = df.join(stats, list(keys), "left")
    return out.withColumn("normalised", F.when(F.col("_varies"), (F.col(value) - F.col("_mean")) / F.col("_norm"))).drop("_mean", "_norm", "_varies")


def clean_columns(slots: DataFrame, max_gap: int, few: Column, raw: Column, percent: float = 1, sigmas: float = 20) -> DataFrame:
    """`slots` (sensor, slot, value, ...) as finished columns: outliers out, gaps filled (`few`: by the nearest), columns of which
    more than a fifth is missing left out, values normalised unless `raw`, constant columns left out.

    The same rules as `mark_outliers`, `fill_gaps`, `too_many_missing`, `normalise` and `varying`, as windows over one shuffle by
    sensor: a sensor has one row a slot, so none is larger than another.
    """
    w = Window.partitionBy("sensor")

    def placed(df, value):
        return df.withColumns({"_i": F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())) - 1, "_n": F.count(value).over(w)})

    cut = F.col("_n") * percent / 2 / 100
    v = F.when(F.col("value").isNotNull() & (F.col("_i") >= F.floor(cut)) & (F.col("_i") < F.floor(F.col("_n") - cut)), F.col("value"))
    bounds = placed(slots, "value").withColumns({"_lo": F.min(v).over(w), "_hi": F.max(v).over(w), "_sd": F.stddev_pop(v).over(w), "_k": F.count(v).over(w)})
    out = (F.col("_k") > 10) & ((F.col("value") > F.col("_hi") + sigmas * F.col("_sd")) | (F.col("value") < F.col("_lo") - sigmas * F.col("_sd")))
    good = bounds.withColumn("value", F.when(~F.coalesce(out, F.lit(False)), F.col("value"))).select(*slots.columns)
    filled = fill_gaps(good, max_gap, nearest=few).withColumn("value", F.col("filled")).drop("filled")
    kept = filled.withColumn("_missing", F.count_if(F.col("value").isNull()).over(w)).withColumn("_all", F.count("*").over(w)).filter("_missing <= _all / 5").select(*slots.columns)
    middle = F.when((F.col("_i") >= F.floor(F.col("_n") * 0.05)) & (F.col("_i") < F.floor(F.col("_n") * 0.95)), F.col("value"))
    stats = placed(kept, "value").withColumns({"_mean": F.avg("value").over(w), "_norm": F.sqrt(F.sum(F.col("value") * F.col("value")).over(w)), "_varies": F.min(middle).over(w) < F.max(middle).over(w)})
    done = stats.withColumn("value", F.when(raw, F.col("value")).when(F.col("_varies"), (F.col("value") - F.col("_mean")) / F.col("_norm"))).select(*slots.columns)
    return done.withColumns({"_lo": F.min("value").over(w), "_hi": F.max("value").over(w)}).filter("_lo <> _hi").select(*slots.columns)


def stepped(spans: DataFrame, a: Column, last: Column, step: Column, block: int = 4096) -> DataFrame:
    """`spans` with t from a to at most `last` every `step`, one row each: blocks of steps first, so that no row holds a whole span, dealt to all
    tasks, so that none makes all rows of a long one."""
    blocks = spans.withColumns({"_a": a.cast("long"), "_s": step.cast("long")}).withColumn("_n", F.floor((last - F.col("_a")) / F.col("_s")))
    many = blocks.filter("_n >= 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / block))))
    many = many.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), *spans.columns, "_k")
    one = many.withColumn("_i", F.explode(F.sequence(F.col("_k") * block, F.least(F.col("_n"), F.col("_k") * block + block - 1))))
    return one.withColumn("t", F.col("_a") + F.col("_i") * F.col("_s")).drop("_a", "_s", "_n", "_k", "_i")


def regularise(r: DataFrame, percent: float = 1, sigmas: float = 20) -> DataFrame:
    """Readings on an even grid of each sensor's own step, the mean interval rounded up to seconds; from the first reading to
    before the last, outliers left out first. Linear between neighbours; sensors of few levels take the nearest."""
    good = mark_outliers(r, percent=percent, sigmas=sigmas).filter("not outlier").drop("outlier")
    good = settled(good.groupBy("sensor", "t").agg(F.avg("value").alias("value")))
    steps = good.groupBy("sensor").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).filter("b > a")
    step = F.ceil((F.col("b") - F.col("a")) / F.col("n") / SECOND) * SECOND
    grid = stepped(steps, F.col("a"), F.col("b") - 1, step).select("sensor", "t")
    near = ordered.neighbours(good, grid)
    types = infer_types(good).select("sensor", "num_type")
    early = F.col("after_t").isNull() | (F.col("t") - F.col("before_t") <= F.col("after_t") - F.col("t"))
    nearest = F.when(early, F.col("before_value")).otherwise(F.col("after_value"))
    line = F.when(F.col("before_t") == F.col("t"), F.col("before_value")).otherwise(ordered.linear(F.col("t"), F.col("before_t"), F.col("before_value"), F.col("after_t"), F.col("after_value")))
    return near.join(F.broadcast(types), "sensor").select("sensor", "t", F.when(F.col("num_type") == INT_TYPE, nearest).otherwise(line).alias("value"))


def upsample(r: DataFrame, step: int = SECOND, start: int | None = None, end: int | None = None) -> DataFrame:
    """Readings every `step` on the lines between neighbours; start and end, where given, are anchors of value 0."""
    points = r.groupBy("sensor", "t").agg(F.avg("value").alias("value"))
    anchors = [t for t in (start, end) if t is not None]
    if anchors:
        zero = r.select("sensor").distinct().select("sensor", F.explode(F.array(*[F.lit(t).cast("long") for t in anchors])).alias("t"), F.lit(0.0).alias("value"))
        points = points.union(zero).groupBy("sensor", "t").agg(F.max_by("value", F.abs("value")).alias("value"))
    span = points.groupBy("sensor").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = stepped(span, F.col("a"), F.col("b"), F.lit(step)).select("sensor", "t")
    n = ordered.neighbours(points, grid)
    line = ordered.linear(F.col("t"), F.col("before_t"), F.col("before_value"), F.col("after_t"), F.col("after_value"))
    return n.select("sensor", "t", F.when(F.col("after_t").isNull() | (F.col("before_t") == F.col("t")), F.col("before_value")).otherwise(line).alias("value"))


def downsample(r: DataFrame, rows: int = 600) -> DataFrame:
    """(sensor, block, t, value): sums of `rows` readings in time order over `rows`, of a short last block too."""
    placed = ordered.with_totals(r, ["sensor"], "value", ["t", "value"])
    return placed.withColumn("block", F.floor((F.col("place") - 1) / rows)).groupBy("sensor", "block").agg(F.min("t").alias("t"), (F.sum("value") / rows).alias("value"))


def _kalman_variance(q: float, noise: float, steps: int) -> float:
    """The filter's variance after so many updates from 1: each is the linear fraction noise (p + q) / (p + q + noise), so the
    steps are a power of a 2 x 2 matrix."""
    import numpy as np

    one, all_ = np.array([[noise, noise * q], [1.0, q + noise]]), np.eye(2)
    while steps:
        if steps & 1:
            all_ = one @ all_
            all_ /= all_.max()
        one = one @ one
        one /= one.max()
        steps >>= 1
    return float((all_[0, 0] + all_[0, 1]) / (all_[1, 0] + all_[1, 1]))


def kalman(r: DataFrame, q: float, noise: float, rows: int = 20_000) -> DataFrame:
    """Readings with smoothed: a one-dimensional Kalman filter (first state the first value, first variance 1) over each sensor's
    values in order of t and value.

    Gains depend on the number of the step only, so a run of readings takes a state x to a x + b. Each sensor is cut by
    quantiles of t into at most 1,000 chunks of about `rows` readings; one (a, b) a chunk gives the state with which each
    chunk begins, and then every chunk is finished on its own. Readings of one time stay in one chunk.
    """
    import pandas as pd

    share = [i / 1000 for i in range(1, 1000)]
    edges = r.groupBy("sensor").agg(F.ceil(F.count("*") / rows).alias("_n"), F.percentile_approx("t", share, 10_000).alias("_at"))
    # of 999 quantiles every so many, for the number of chunks wanted
    some = F.filter("_at", lambda x, i: F.floor((i + 1) * F.col("_n") / 1000) > F.floor(i * F.col("_n") / 1000))
    edges = edges.select("sensor", F.array_distinct(some).alias("_at"))
    # two steps of some 32 comparisons: every 32nd edge, then those between two of them
    edges = edges.withColumn("_top", F.filter("_at", lambda x, i: i % 32 == 0))
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("t")))
    found = r.join(edges, "sensor").withColumn("_c", upto(F.col("_top")))
    chunk = F.when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * 32 + upto(F.slice("_at", F.greatest((F.col("_c") - 1) * 32 + 1, F.lit(1)), 32)))
    cut = found.select("sensor", "t", "value", chunk.alias("_chunk"))
    order = Window.partitionBy("sensor").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("sensor", "_chunk").agg(F.count("*").alias("_c"))
    begin = counts.select("sensor", "_chunk", F.coalesce(F.sum("_c").over(order), F.lit(0)).cast("long").alias("_done"))

    def fold(t: pd.DataFrame, x: float):
        """a, b and the states of a chunk that begins with x."""
        t = t.sort_values(["t", "value"], na_position="first")
        done, values, a, out = int(t["_done"].iloc[0]), t["value"].tolist(), 1.0, []
        if not done:
            x, a = values[0], 0.0
            out.append(x)
        p = _kalman_variance(q, noise, max(done - 1, 0))
        for v in values[len(out) :]:
            p += q
            k = p / (p + noise)
            x += k * (v - x)
            p *= 1 - k
            a *= 1 - k
            out.append(x)
        return t, a, out

    def compose(t: pd.DataFrame) -> pd.DataFrame:
        _, a, out = fold(t, 0.0)
        return t[["sensor", "_chunk"]].head(1).assign(_a=a, _b=out[-1])

    def carry(t: pd.DataFrame) -> pd.DataFrame:
        t, x, out = t.sort_values("_chunk"), 0.0, []
        for a, b in zip(t["_a"].tolist(), t["_b"].tolist()):
            out.append(x)
            x = a * x + b
        return t[["sensor", "_chunk"]].assign(_x=out)

    def finish(t: pd.DataFrame) -> pd.DataFrame:
        t, _, out = fold(t, float(t["_x"].iloc[0]))
        return t[["sensor", "t", "value"]].assign(smoothed=out)

    numbered = cut.join(begin, ["sensor", "_chunk"])
    steps = numbered.groupBy("sensor", "_chunk").applyInPandas(compose, "sensor string, _chunk int, _a double, _b double")
    states = steps.groupBy("sensor").applyInPandas(carry, "sensor string, _chunk int, _x double")
    return numbered.join(states, ["sensor", "_chunk"]).groupBy("sensor", "_chunk").applyInPandas(finish, "sensor string, t long, value double, smoothed double")


def repair_zone(r: DataFrame, recorded: str, site: str) -> DataFrame:
    """Readings whose times were taken from a clock in zone `recorded`, with the times that a clock in zone `site` showed."""
    right = F.to_utc_timestamp(F.timestamp_micros("t"), recorded)
    return r.withColumn("t", F.unix_micros(F.from_utc_timestamp(right, site)))
