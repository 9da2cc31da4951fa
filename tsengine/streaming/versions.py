"""Versioned streams: snapshots, changed ranges, ranges of recomputation, idempotent writes, and live windows.

A stream table is append-only: uuid string, time_ns long, value double, version long, deleted boolean. A row is visible at
version v if its version is at most v and no later one up to v has the same uuid and time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Log2 of nanoseconds of the slices that recomputation works in (about 137 s).
SLICE_POWER = 37


def current_versions(stream: DataFrame) -> DataFrame:
    """(uuid, version)."""
    return stream.groupBy("uuid").agg(F.max("version").alias("version"))


def snapshot(stream: DataFrame, version: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """(uuid, time_ns, value) as visible at `version`, in [start, end). Filters come before the shuffle."""
    kept = stream.filter(F.col("version") <= version)
    if start is not None:
        kept = kept.filter(F.col("time_ns") >= start)
    if end is not None:
        kept = kept.filter(F.col("time_ns") < end)
    last = kept.groupBy("uuid", "time_ns").agg(F.max_by(F.struct("value", "deleted"), "version").alias("x"))
    return last.filter(~F.coalesce("x.deleted", F.lit(False))).select("uuid", "time_ns", F.col("x.value").alias("value"))


def merge_ranges(ranges: DataFrame, keys: Sequence[str] = ("uuid",), gap: int = 0) -> DataFrame:
    """(keys, start_ns, end_ns): the union of [start, end) ranges; those that overlap, touch or lie within `gap` become one."""
    w = Window.partitionBy(*keys).orderBy("start_ns", "end_ns")
    reach = F.max("end_ns").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.filter("end_ns > start_ns").withColumn("_new", F.coalesce(F.col("start_ns") > reach + gap, F.lit(True)).cast("int"))
    placed = marked.withColumn("_island", F.sum("_new").over(w))
    return placed.groupBy(*keys, "_island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("_island")


def changed_ranges(stream: DataFrame, after: int, upto: int, threshold: int = 300_000) -> DataFrame:
    """(uuid, start_ns, end_ns) of what changed with versions in (after, upto]; changes within `threshold` are one range.

    Changes are first merged in slices of time, so a stream's changes aren't all sorted by one task.
    """
    changed = stream.filter((F.col("version") > after) & (F.col("version") <= upto)).select("uuid", F.col("time_ns").alias("start_ns"), (F.col("time_ns") + 1).alias("end_ns"))
    sliced = merge_ranges(changed.withColumn("_slice", F.shiftright("start_ns", SLICE_POWER + 8)), ["uuid", "_slice"], threshold)
    return merge_ranges(sliced.drop("_slice"), ["uuid"], threshold)


def clamp(ranges: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Ranges cut to [low, high); empty ones go."""
    out = ranges
    if low is not None:
        out = out.withColumn("start_ns", F.greatest("start_ns", F.lit(low)))
    if high is not None:
        out = out.withColumn("end_ns", F.least("end_ns", F.lit(high)))
    return out.filter("end_ns > start_ns")


def widen(ranges: DataFrame, before: int, after: int) -> DataFrame:
    """Ranges with what a window needs before and after them, merged."""
    return merge_ranges(ranges.withColumns({"start_ns": F.col("start_ns") - before, "end_ns": F.col("end_ns") + after}), [c for c in ranges.columns if c not in ("start_ns", "end_ns")])


def slices(ranges: DataFrame, power: int = SLICE_POWER) -> DataFrame:
    """Ranges cut at multiples of 2^power."""
    first, last = F.shiftright("start_ns", power), F.shiftright(F.col("end_ns") - 1, power)
    each = ranges.filter("end_ns > start_ns").withColumn("_k", F.explode(F.sequence(first, last)))
    begin = F.shiftleft("_k", power)
    return each.withColumns({"start_ns": F.greatest("start_ns", begin), "end_ns": F.least("end_ns", begin + (1 << power))}).drop("_k")


def rows_in_ranges(stream: DataFrame, ranges: DataFrame, power: int = SLICE_POWER + 8) -> DataFrame:
    """Rows of a stream inside some range, each once: an equi-join on slices of time, then the exact bounds. No theta join."""
    cut = slices(merge_ranges(ranges), power).withColumn("_k", F.shiftright("start_ns", power))
    keyed = stream.withColumn("_k", F.shiftright("time_ns", power))
    inside = (F.col("time_ns") >= F.col("start_ns")) & (F.col("time_ns") < F.col("end_ns"))
    return keyed.join(cut, ["uuid", "_k"]).filter(inside).select(*stream.columns)


def replace_ranges(old: DataFrame, bounds: DataFrame, new: DataFrame) -> DataFrame:
    """`old` with everything inside the bounds gone and `new` in its place: applying it twice gives the same."""
    gone = rows_in_ranges(old, bounds).select("uuid", "time_ns").distinct()
    return old.join(gone, ["uuid", "time_ns"], "left_anti").unionByName(new)


def erase_then_insert(bounds: DataFrame, visible: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """Rows to append to an append-only table for `replace_ranges`: tombstones for visible rows inside the bounds that `new`
    doesn't have, and the new rows, all of one version."""
    gone = rows_in_ranges(visible, bounds).join(new.select("uuid", "time_ns"), ["uuid", "time_ns"], "left_anti")
    tombs = gone.select("uuid", "time_ns", F.lit(None).cast("double").alias("value"), F.lit(version).cast("long").alias("version"), F.lit(True).alias("deleted"))
    rows = new.select("uuid", "time_ns", "value", F.lit(version).cast("long").alias("version"), F.lit(False).alias("deleted"))
    return tombs.union(rows)


@dataclass
class Distillate:
    """A derived stream: compute(input rows, ranges) gives (uuid, time_ns, value) for the ranges.

    before/after: nanoseconds of input that a range needs around it. version, params: of the algorithm; a change of
    either computes all anew.
    """

    name: str
    compute: Callable[[DataFrame, DataFrame], DataFrame]
    version: int = 1
    before: int = 0
    after: int = 0
    low: int | None = None
    high: int | None = None
    run_once: bool = False
    params: dict = field(default_factory=dict)


def params_text(d: Distillate) -> str:
    """A distillate's parameters as its control row has them."""
    return json.dumps(d.params, sort_keys=True, default=str)


CONTROL = "name string, algorithm long, params string, input_version long"


def refresh(d: Distillate, inputs: DataFrame, output: DataFrame, control: DataFrame | None, target: int) -> tuple[DataFrame, DataFrame, bool]:
    """(new output, new control row, whether all was computed anew): brings a distillate from its last input version to `target`.

    What changed is merged, clamped and widened; only input rows in the widened ranges are read, and only the changed ranges of
    the output are replaced. Without control row, or with another algorithm version or other parameters, the output is dropped and
    all recomputed.
    """
    row = control.filter(F.col("name") == d.name).first() if control is not None else None
    params = params_text(d)
    anew = row is None or (row["algorithm"], row["params"]) != (d.version, params)
    if not anew and d.run_once:
        return output, control.filter(F.col("name") == d.name), False
    since = -1 if anew else row["input_version"]
    ranges = clamp(changed_ranges(inputs, since, target), d.low, d.high)
    ranges = widen(ranges, d.after, d.before) if d.before or d.after else ranges
    needed = widen(ranges, d.before, d.after)
    computed = d.compute(rows_in_ranges(snapshot(inputs, target), needed), ranges)
    base = output.limit(0) if anew else output
    fresh = rows_in_ranges(computed, ranges.withColumn("uuid", F.col("uuid")))
    control_row = inputs.sparkSession.createDataFrame([(d.name, d.version, params, target)], CONTROL)
    return replace_ranges(base, ranges, fresh), control_row, anew


def live_windows(stream: DataFrame, width: str, lateness: str, slide: str | None = None, time: str = "ts", keys: Sequence[str] = ("sensor",)) -> DataFrame:
    """Count and mean of tumbling (or sliding) windows of a stream with a watermark; readings later than that are dropped by the
    engine and should be appended as a new version, which `changed_ranges` then finds."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, lateness).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def live_sessions(stream: DataFrame, gap: str, lateness: str, time: str = "ts", keys: Sequence[str] = ("sensor",)) -> DataFrame:
    """Sessions: readings less than `gap` apart."""
    out = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def collect_files(spark: SparkSession, folder: str, schema, target: str, checkpoint: str):
    """Appends the files of a folder that weren't read yet to a Parquet table; the returned query ends when all are in."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
