"""Discrete states of signals: one-dimensional k-means, the knee of its likelihood, peak states, irregular events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.model import settled

from . import ordered

PEAK, MIDDLE, LOW = 1, 0, -1
#: Distinct values of one sensor that the dynamic programme takes as they are; more are first gathered into levels.
MOST_LEVELS = 1 << 16
_SMALLEST_STD, _SMALLEST_VARIANCE = 1e-6, 1e-3


def best_cuts(values: np.ndarray, weights: np.ndarray, most: int) -> list[np.ndarray]:
    """For k = 1, 2, ... up to `most`: the starts of the k groups of sorted distinct values with the least squared error.

    The best last start never falls as the end grows, so ends are taken halfway between known ones and look between their starts:
    n log n work for each k.
    """
    n = len(values)
    w = np.concatenate([[0], np.cumsum(weights)])
    x = values - values.mean()
    s, q = np.concatenate([[0], np.cumsum(weights * x)]), np.concatenate([[0], np.cumsum(weights * x * x)])
    i = np.arange(n)

    def inside(a, b):
        return q[b] - q[a] - (s[b] - s[a]) ** 2 / (w[b] - w[a])

    cost, back, out = inside(np.zeros(n, int), i + 1), [], [np.zeros(1, int)]
    for k in range(2, min(most, n) + 1):
        new, came = np.full(n, np.inf), np.zeros(n, int)
        size = n - k + 1  # ends k - 1 to n - 1
        step = 1 << (size - 1).bit_length()
        while step:
            ends = np.arange(step - 1, size, 2 * step) + k - 1
            if len(ends):
                low = np.where(ends - step >= k - 1, came[np.maximum(ends - step, 0)], k - 1)
                high = np.where(ends + step < n, came[np.minimum(ends + step, n - 1)], ends)
                high = np.maximum(np.minimum(high, ends), low)
                many = high - low + 1
                at = np.cumsum(many) - many
                start = np.arange(many.sum()) - np.repeat(at - low, many)
                c = cost[start - 1] + inside(start, np.repeat(ends + 1, many))
                new[ends] = np.minimum.reduceat(c, at)
                hit = np.flatnonzero(c == np.repeat(new[ends], many))
                came[ends] = start[hit[np.searchsorted(hit, at)]]
            step >>= 1
        cost = new
        back.append(came)
        cuts, end = [], n - 1
        for b in reversed(back):
            cuts.append(int(b[end]))
            end = cuts[-1] - 1
        out.append(np.array([0, *reversed(cuts)]))
    return out


def log_likelihood(values: np.ndarray, weights: np.ndarray, starts: np.ndarray, within: np.ndarray | None = None) -> float:
    """Sum over groups of the normal log density of their values, by population deviation, at least 1e-6.

    within: where values are means of levels, each level's squared error about its mean."""
    total = 0.0
    for a, b in zip(starts, [*starts[1:], len(values)]):
        x, w = values[a:b], weights[a:b]
        n = w.sum()
        m = (w * x).sum() / n
        error = (w * (x - m) ** 2).sum() + (0.0 if within is None else within[a:b].sum())
        sd = max(np.sqrt(error / n), _SMALLEST_STD)
        total += -n * np.log(sd * np.sqrt(2 * np.pi)) - error / (2 * sd * sd)
    return float(total)


def knee(scores: list[float]) -> int:
    """k at the knee of scores for k = 1, 2, ...: one more than the number of scores left of the cut with the least squared error of
    a line on each side; the first of equal cuts."""

    def error(part):
        if len(part) < 3:
            return 0.0
        x = np.arange(len(part), dtype=float)
        return float(((part - np.polyval(np.polyfit(x, part, 1), x)) ** 2).sum())

    y = np.array(scores, float)
    return min(range(len(y)), key=lambda i: (round(error(y[:i]) + error(y[i:]), 9), i), default=0) + 1


def mixture(values: np.ndarray, weights: np.ndarray, starts: np.ndarray, within: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, label of each value, means) of a mixture of normal laws, one for each of the groups that `starts` gives.

    Expectation and maximisation from those groups until a round gains less than 1e-6 a row; variances are at least 1e-3. A label is
    the likeliest component, components ordered by mean; `within` as in `log_likelihood`.
    """
    group = np.searchsorted(starts, np.arange(len(values)), side="right") - 1
    belongs = np.eye(len(starts))[group]
    last = -np.inf
    for _ in range(rounds):
        w = belongs * weights[:, None]
        n = np.maximum(w.sum(0), 1e-12)
        mean = w.T @ values / n
        square = (values[:, None] - mean) ** 2 + (within / weights)[:, None]
        var = (w * square).sum(0) / n + _SMALLEST_VARIANCE
        log = np.log(n / n.sum()) - 0.5 * (np.log(2 * np.pi * var) + square / var)
        top = log.max(1)
        each = top + np.log(np.exp(log - top[:, None]).sum(1))
        belongs = np.exp(log - each[:, None])
        total = float((weights * each).sum())
        if total - last < 1e-6 * weights.sum():
            break
        last = total
    order = np.argsort(mean, kind="stable")
    return total, belongs[:, order].argmax(1), mean[order]


def discover(values: np.ndarray, weights: np.ndarray, most: int, within: np.ndarray | None = None, method: str = "kmeans") -> tuple[np.ndarray, np.ndarray]:
    """(label of each value, centres): k by the knee, groups by k-means without random start, or by a mixture of normal laws that
    starts from those groups (method "mixture"); labels follow the centres' order."""
    cuts = best_cuts(values, weights, most)
    if method == "mixture":
        fits = [mixture(values, weights, c, np.zeros(len(values)) if within is None else within) for c in cuts]
        _, label, centres = fits[max(knee([f[0] for f in fits]), 1) - 1]
        return label, centres
    k = knee([log_likelihood(values, weights, c, within) for c in cuts])
    starts = cuts[max(k, 1) - 1]
    label = np.searchsorted(starts, np.arange(len(values)), side="right") - 1
    centres = np.bincount(label, weights * values) / np.bincount(label, weights)
    return label, centres


def _levels(counts: DataFrame, keys: list[str]) -> DataFrame:
    """`counts` (keys, value, _c: one row a distinct value) with _l: the value itself, or the least value of its level where a key
    has more than MOST_LEVELS values.

    Levels are an eighth of MOST_LEVELS cells of equal distance; a cell with more than its share of the values is cut again, twice
    at most, into as many cells of equal distance between its own ends as it has shares. So a far value has a level apart, and a key
    has fewer than MOST_LEVELS levels. All of it are counts by cell that are joined back; nothing goes to the driver.
    """
    part = max(2, MOST_LEVELS // 8)
    v = F.col("value")
    large = counts.groupBy(*keys).agg(F.count("*").alias("_d"), F.min(v).alias("_a"), F.max(v).alias("_b")).filter(F.col("_d") > MOST_LEVELS)
    if large.isEmpty():
        return counts.withColumn("_l", v)
    place = (v - F.col("_a")) / (F.col("_b") - F.col("_a"))
    cut = counts.join(large, keys).withColumn("_cell", F.floor(place * part).cast("string"))
    for _ in range(2):
        cells = cut.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"), F.min(v).alias("_a"), F.max(v).alias("_b"))
        cut = cut.drop("_n", "_a", "_b").join(cells, [*keys, "_cell"])
        again = F.concat("_cell", F.lit("/"), F.floor(place * F.ceil(F.col("_n") * part / F.col("_d"))).cast("string"))
        cut = cut.withColumn("_cell", F.when((F.col("_n") * part > F.col("_d")) & (F.col("_b") > F.col("_a")), again).otherwise(F.col("_cell")))
    least = cut.groupBy(*keys, "_cell").agg(F.min(v).alias("_l"))
    cut = cut.join(least, [*keys, "_cell"]).select(*keys, "value", "_c", "_l")
    return cut.unionByName(counts.join(large, keys, "left_anti").withColumn("_l", v))


def value_states(df: DataFrame, keys: list[str], value: str = "value", most: int = 6, method: str = "kmeans") -> DataFrame:
    """(keys, value, label, centre, n_states): the state of every distinct value of each key, by `discover`.

    Only counts of distinct values go to a key's task, so a sensor's readings never meet in one task. Up to MOST_LEVELS distinct
    values of a key are split with the least squared error. More are first gathered into levels, by their count and their
    distance; counts, sums and squares of the levels are true ones, so the split is the best of those that keep levels whole:
    it is no worse than a best split with its cuts moved to the edges of levels, each of which spans at most 1 / 8,192 of the range.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("_c"))
    counts = _levels(settled(counts), keys)  # one row a distinct value, read several times
    # two steps: squares about a level's own mean keep their digits
    w = F.sum("_c")
    means = counts.groupBy(*keys, "_l").agg((F.sum(F.col("_c") * F.col("value")) / w).alias("_v"), w.alias("_n"))
    spread = counts.join(means, [*keys, "_l"]).groupBy(*keys, "_l").agg(F.first("_v").alias("_v"), F.first("_n").alias("_c"), F.sum(F.col("_c") * (F.col("value") - F.col("_v")) ** 2).alias("_s"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_v")
        label, centres = discover(t["_v"].to_numpy(float), t["_c"].to_numpy(float), most, t["_s"].to_numpy(float), method)
        return t[[*keys, "_l"]].assign(label=label.astype("int32"), centre=centres[label], n_states=np.int32(len(centres)))

    fields = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    found = spread.groupBy(*keys).applyInPandas(run, f"{fields}, _l double, label int, centre double, n_states int")
    return counts.select(*keys, F.col("value").cast(dict(df.dtypes)[value]).alias("value"), "_l").join(found, [*keys, "_l"]).drop("_l")


def peak_states(features: DataFrame, most: int = 6, method: str = "kmeans") -> DataFrame:
    """(sensor, slot, state): PEAK for the cluster with the largest centre, LOW for the smallest, else MIDDLE; a sensor of one
    cluster is always LOW."""
    found = value_states(features, ["sensor"], "value", most, method)
    state = F.when(F.col("label") == 0, LOW).when(F.col("label") == F.col("n_states") - 1, PEAK).otherwise(MIDDLE)
    return features.join(found, ["sensor", "value"]).select("sensor", "slot", state.alias("state"))


def exponential_quantile(gaps: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(keys, quantile): of an exponential law fitted to gaps: shift min, scale mean - min."""
    return gaps.groupBy(*keys).agg((F.min("gap") - (F.avg("gap") - F.min("gap")) * float(np.log(1 - alpha))).alias("quantile"))


def raw_events(r: DataFrame, most: int = 6, few: int = 10, method: str = "kmeans") -> DataFrame:
    """(sensor, t, value, levels, event 0/1): of sensors with fewer than `few` levels the rarest value is the event (the smallest of
    equally rare); else the absolute differences are clustered and those of the top cluster are. A sensor's first row, which has
    no difference, takes the second's."""
    levels = r.groupBy("sensor", "value").agg(F.count("*").alias("n"))
    kinds = levels.groupBy("sensor").agg(F.count("*").alias("levels"), F.min_by("value", F.struct("n", "value")).alias("rarest"))
    d = ordered.first_difference(r).withColumn("change", F.abs("diff")).join(kinds, "sensor")
    many = d.filter(F.col("levels") >= few)
    top = value_states(many, ["sensor"], "change", most, method).filter("label = n_states - 1 and n_states > 1")
    top = top.groupBy("sensor").agg(F.min("value").alias("least_change"))
    second = many.filter("change is not null").groupBy("sensor").agg(F.min_by("change", F.struct("t", "value", -F.col("change"))).alias("second"))
    d = d.join(second, "sensor", "left").withColumn("change", F.coalesce("change", "second"))
    event = F.when(F.col("levels") < few, F.col("value") == F.col("rarest")).otherwise(F.coalesce(F.col("change") >= F.col("least_change"), F.lit(False)))
    return d.join(top, "sensor", "left").select("sensor", "t", "value", "levels", event.cast("int").alias("event"))


def irregular_events(r: DataFrame, most: int = 6, few: int = 10, alpha: float = 0.5, method: str = "kmeans") -> DataFrame:
    """(sensor, t, event double): `raw_events`; of sensors with more than ten levels and more than ten gaps between events the
    centred mean of that label, the ends taking the nearest full window's.

    The window is the alpha quantile of an exponential law fitted to the gaps between events over the mean interval of readings
    (span over count), whole rows, an even number one more. Means are differences of running totals that are joined by place, so
    windows may differ by sensor and no sensor meets in one task.
    """
    found = settled(raw_events(r, most, few, method))
    gaps = ordered.inter_arrival(found.filter("event = 1").select("sensor", "t", "value")).filter("gap is not null")
    law = gaps.groupBy("sensor").agg(F.count("*").alias("gaps")).join(exponential_quantile(gaps, ["sensor"], alpha), "sensor")
    span = found.groupBy("sensor").agg((F.max("t") - F.min("t")).alias("span"), F.count("*").alias("n"), F.first("levels").alias("levels"))
    rows = F.floor(F.col("quantile") * F.col("n") / F.col("span"))
    half = span.join(law, "sensor").filter("gaps > 10 and levels > 10 and span > 0").select("sensor", "n", F.floor(rows / 2).alias("half"))
    placed = settled(ordered.with_totals(found.select("sensor", "t", "value", "event"), ["sensor"], "event", ["t", "value", "event"]))
    totals = placed.select("sensor", "place", "total")
    at = lambda c: totals.select("sensor", F.col("place").alias(c), F.col("total").alias(f"_{c}"))
    middle = F.greatest(F.least(F.greatest(F.col("place"), F.col("half") + 1), F.col("n") - F.col("half")), F.lit(1))
    asked = placed.join(F.broadcast(half), "sensor", "left").withColumn("_middle", middle)
    asked = asked.withColumns({"hi": F.least(F.col("_middle") + F.col("half"), F.col("n")), "lo": F.greatest(F.col("_middle") - F.col("half") - 1, F.lit(0))})
    both = asked.join(at("hi"), ["sensor", "hi"], "left").join(at("lo"), ["sensor", "lo"], "left")
    mean = (F.col("_hi") - F.coalesce("_lo", F.lit(0))) / (F.col("hi") - F.col("lo"))
    return both.select("sensor", "t", F.coalesce(mean, F.col("event").cast("double")).alias("event"))


def binary_table(events: DataFrame, cut: float, remove_repeats: bool = True) -> DataFrame:
    """(t, events map): all sensors' binary labels at the common times (each takes its nearest), rows equal to the one before
    left out if asked. The map is by sensor."""
    from . import align

    times = align.common_times(events)
    points = events.select("sensor", "t", (F.col("event") >= cut).cast("double").alias("value"))
    asked = points.select("sensor").distinct().crossJoin(times)
    found = ordered.nearest_interpolation(points, asked)
    rows = found.groupBy("t").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sensor", F.col("value").cast("int"))))).alias("events"))
    if not remove_repeats:
        return rows
    keyed = rows.withColumns({"_all": F.lit(0), "_e": F.to_json("events")})
    return ordered.without_repeats(keyed, ["_all"], ["_e"]).select("t", "events")
