"""Slot features of sensors, sampling quality and statistical windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsengine.model import INT_TYPE, settled

from . import align, clean


def slot_feature(slotted: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(sensor, slot, value): the mean of a slot, or, for sensors of few levels, its mode (the smallest on a tie), cut to a whole
    number. types: (sensor, num_type); without it every sensor takes the mean."""
    # counts of distinct values first: partial aggregates are small and a hot slot is summed by all tasks
    if types is None:
        return slotted.groupBy("sensor", "slot").agg(F.avg("value").alias("value"))
    # only levels of few are told apart: sums and counts are plain aggregates then, of which every task makes a part
    few = F.col("num_type") == INT_TYPE
    typed = slotted.join(F.broadcast(types.select("sensor", "num_type")), "sensor").withColumn("_level", F.when(few, F.col("value")))
    levels = typed.groupBy("sensor", "slot", "num_type", "_level").agg(F.count("value").alias("_n"), F.sum("value").alias("_sum"))
    mode = F.max_by("_level", F.when(F.col("_level").isNotNull(), F.struct("_n", -F.col("_level"))))
    both = levels.groupBy("sensor", "slot", "num_type").agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean"), mode.alias("_mode"))
    return both.select("sensor", "slot", F.when(few, F.col("_mode").cast("long").cast("double")).otherwise(F.col("_mean")).alias("value"))


def slot_statistics(slotted: DataFrame) -> DataFrame:
    """(sensor, slot, n, mean, std): count, mean and population deviation."""
    return slotted.groupBy("sensor", "slot").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def slot_difference(slotted: DataFrame, confidence: float = 0.5, types: DataFrame | None = None) -> DataFrame:
    """(sensor, slot, value): the mean of the upper part (from position floor(n * confidence)) of the sorted absolute differences
    of neighbours inside a slot; the mode for sensors of few levels. Slots with one reading have none."""
    w = Window.partitionBy("sensor", "slot").orderBy("t", "value")
    d = slotted.withColumn("d", F.abs(F.col("value") - F.lag("value").over(w))).filter("d is not null")
    by = Window.partitionBy("sensor", "slot")
    upper = d.withColumns({"_i": F.row_number().over(by.orderBy("d")) - 1, "_n": F.count("*").over(by)}).filter(F.col("_i") >= F.floor(F.col("_n") * confidence))
    return slot_feature(upper.select("sensor", "slot", F.col("d").alias("value")), types)


def average_features(r: DataFrame, grid: DataFrame, start: int, end: int, width: int, max_gap: int, raw: Sequence[str] = ()) -> DataFrame:
    """(sensor, slot, value, num_type): the whole chain of the average feature: types, slot values, outliers out, gaps filled,
    columns with too much missing out, then normalised. Sensors of few levels and those named in `raw` (weather) stay as they are."""
    types = clean.infer_types(r).select("sensor", "num_type")
    slots = align.with_all_slots(slot_feature(align.assign_slots(r, start, end, width), types), grid).join(types, "sensor")
    few = F.col("num_type") == INT_TYPE
    return clean.clean_columns(slots, max_gap, few, few | F.col("sensor").isin(list(raw)) if raw else few).select("sensor", "slot", "value", "num_type")


def difference_features(r: DataFrame, grid: DataFrame, start: int, end: int, width: int, max_gap: int, confidence: float = 0.5) -> DataFrame:
    """(sensor, slot, value, num_type): the chain of the difference feature: regular series, slot differences, outliers out, gaps
    filled, columns with too much missing out, floats normalised, constant columns out."""
    even = settled(clean.regularise(r))
    types = clean.infer_types(even).select("sensor", "num_type")
    slots = align.with_all_slots(slot_difference(align.assign_slots(even, start, end, width), confidence, types), grid).join(types, "sensor")
    few = F.col("num_type") == INT_TYPE
    return clean.clean_columns(slots, max_gap, few, few).select("sensor", "slot", "value", "num_type")


def pair_features(average: DataFrame, difference: DataFrame) -> DataFrame:
    """(sensor, slot, avg_value, diff_value) of the slots that both have."""
    return average.select("sensor", "slot", F.col("value").alias("avg_value")).join(difference.select("sensor", "slot", F.col("value").alias("diff_value")), ["sensor", "slot"])


def sampling_density(r: DataFrame, start: int, end: int, width: int, period: int) -> DataFrame:
    """(sensor, slot, n, density): readings of a slot over those that a period of `period` makes; 0 in empty slots."""
    counted = align.assign_slots(r, start, end, width).groupBy("sensor", "slot").agg(F.count("*").alias("n"))
    full = align.with_all_slots(counted, align.slot_grid(r.sparkSession, start, end, width))
    return full.select("sensor", "slot", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / (width / period)).alias("density"))


def density_statistics(density: DataFrame, trimmed: float = 0.025) -> DataFrame:
    """(sensor, min, max and mean density, broken): without the first and last `trimmed` share of slots in time; a sensor that is
    never seen in the rest is broken."""
    by = Window.partitionBy("sensor")
    placed = density.withColumns({"_i": F.row_number().over(by.orderBy("slot")) - 1, "_n": F.count("*").over(by)})
    cut = F.floor(F.col("_n") * trimmed)
    rest = placed.filter((F.col("_i") >= cut) & (F.col("_i") < F.col("_n") - cut))
    out = rest.groupBy("sensor").agg(F.min("density").alias("min_density"), F.max("density").alias("max_density"), F.avg("density").alias("avg_density"))
    return out.withColumn("broken", (F.col("min_density") == 0) & (F.col("max_density") == 0))


def mean_interval(r: DataFrame, default: float = 10000.0) -> DataFrame:
    """(sensor, n, interval_s): mean seconds between readings; `default` for fewer than two. Telescoping: two extremes and a count."""
    span = (F.max("t") - F.min("t")) / 1_000_000
    return r.groupBy("sensor").agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, span / F.greatest(F.count("*") - 1, F.lit(1))).otherwise(F.lit(default)).alias("interval_s"))


def availability(r: DataFrame) -> DataFrame:
    """(sensor, first_t, last_t, n)."""
    return r.groupBy("sensor").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


def statistical_windows(stream: DataFrame, start: int, end: int, width_power: int, keys: Sequence[str] = ("uuid",), time: str = "time_ns") -> DataFrame:
    """(keys, time, count, min, mean, max) of windows of 2^width_power ticks; both bounds are rounded down to windows."""
    if not 0 <= width_power <= 61:
        raise ValueError("width_power must be from 0 to 61")
    a, b = start >> width_power << width_power, end >> width_power << width_power
    kept = stream.filter((F.col(time) >= a) & (F.col(time) < b))
    bin_ = F.shiftleft(F.shiftright(F.col(time), width_power), width_power)
    v = F.col("value")
    return kept.groupBy(*keys, bin_.alias("time")).agg(F.count("*").alias("count"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"))


def token_frequency(names: DataFrame, column: str, strip_last: bool = True) -> DataFrame:
    """(phrase, n): how often names occur, their last word left off if asked."""
    phrase = F.regexp_replace(F.col(column), r"\s+\S+\s*$", "") if strip_last else F.col(column)
    return names.groupBy(phrase.alias("phrase")).agg(F.count("*").alias("n"))


def cross_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): rows of each pair of keys."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))
