"""Ordered operators: neighbours in time, rolling statistics, as-of look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsengine.model import DAY, settled

#: Rows of a key that one task orders for rolling statistics, and about so many in a chunk of time.
ROWS_PER_BLOCK = 50_000


def chunk_width(df: DataFrame, keys: Sequence[str], time: str, widest: int) -> int:
    """The width of chunks of the integer `time` in which no key has more than about ROWS_PER_BLOCK rows, at most `widest`.

    The fullest of cells of a 1,024th of `widest` decides, as rows inside a cell are taken as even; one number reaches the driver.
    """
    cell = -(-widest // 1024)
    counts = df.groupBy(*keys, F.floor(F.col(time) / F.lit(cell))).agg(F.count("*").alias("_n"))
    fullest = counts.agg(F.max("_n")).first()[0] or 0
    return max(1, min(widest, cell * ROWS_PER_BLOCK // max(fullest, 1)))


def with_previous(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str] = ("t",), chunk: int = 30 * DAY) -> DataFrame:
    """`df` with prev_<value>: the row before, in each key, by `order` (its first column is an integer time).

    Rows are sorted in chunks of time of at most `chunk`, narrower where rows are many (`chunk_width`), so that a sensor with a third
    of all rows isn't sorted by one task; the first row of a chunk takes the last of the chunk before, from a table of one row a chunk.
    """
    chunk = chunk_width(df, keys, order[0], chunk)
    cut = df.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(chunk)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inside = cut.withColumns({"_prev": F.lag(F.struct(*values)).over(w), "_first": F.row_number().over(w) == 1})
    ends = cut.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_end")
    joined = inside.join(before, [*keys, "_chunk"], "left")
    prev = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))
    return joined.select(*df.columns, *[prev[v].alias(f"prev_{v}") for v in values])


def with_totals(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ("t",), chunk: int = 30 * DAY) -> DataFrame:
    """`df` with place, the number of the row in its key by `order` (from 1; its first column is an integer time), and total, the
    sum of `value` up to the row; counted in chunks of time as in `with_previous`."""
    chunk = chunk_width(df, keys, order[0], chunk)
    cut = df.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(chunk)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inside = cut.withColumn("_i", F.row_number().over(w)).withColumn("_s", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n"), F.coalesce(F.sum("_v").over(past), F.lit(0)).alias("_v"))
    joined = inside.join(before, [*keys, "_chunk"])
    return joined.select(*df.columns, (F.col("_i") + F.col("_n")).alias("place"), (F.col("_s") + F.col("_v")).alias("total"))


def first_difference(r: DataFrame) -> DataFrame:
    """Readings with diff, the value less the one before; null for a sensor's first."""
    return with_previous(r, ["sensor"], ["value"], ["t", "value"]).withColumn("diff", F.col("value") - F.col("prev_value")).drop("prev_value")


def inter_arrival(r: DataFrame) -> DataFrame:
    """Readings with gap, the microseconds since the one before."""
    return with_previous(r, ["sensor"], ["t"], ["t", "value"]).withColumn("gap", F.col("t") - F.col("prev_t")).drop("prev_t")


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with _place, the number of the row in its key by `order` (from 1), and _n, the key's rows.

    Rows are range-sorted by key and order, so a large key is spread over many tasks; a row's number is its place in its range and the
    rows of its key in ranges before, from one row a range and key.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    placed = settled(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)).withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    parts = placed.groupBy(*keys, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_m"))
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_m").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_n": F.sum("_m").over(key)}).drop("_m")
    return placed.join(parts, [*keys, "_range"]).withColumn("_place", F.col("_row") - F.col("_first") + F.col("_before") + 1).drop("_range", "_row", "_first", "_before")


def _framed(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int, make) -> DataFrame:
    """`df` with _place, _n and _v, a statistic over the rows from `before` before to `after` after each (-1: to the one before).

    A key's rows are cut by place into blocks; a block's task also gets the `before` rows that precede it and the `after` that
    follow, so no task orders more than a block whatever a key's size.
    """
    size = max(ROWS_PER_BLOCK, before + after, 1)
    i = F.col("_place") - 1
    block, inside = F.floor(i / size), i % size
    near = F.array(block, F.when(inside < after, block - 1), F.when(inside >= size - before, block + 1))
    copies = with_place(df, keys, order).withColumns({"_own": block, "_block": F.explode(F.array_compact(near))})
    by = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(-before, after)
    return copies.withColumn("_v", make(by)).filter("_block = _own").drop("_own", "_block")


def moving_average_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], w: int, value: str = "value") -> DataFrame:
    """`df` with avg_before: the mean of the w values before a row; the first w rows take the mean of the first w values."""
    out = _framed(df, keys, order, w, -1, lambda by: F.avg(value).over(by))
    first = out.filter(F.col("_place") <= w).groupBy(*keys).agg(F.avg(value).alias("_start"))
    return out.join(first, list(keys)).withColumn("avg_before", F.when(F.col("_place") <= w, F.col("_start")).otherwise(F.col("_v"))).select(*df.columns, "avg_before")


def _clamped(df: DataFrame, keys, order, width: int, make, name: str) -> DataFrame:
    """A statistic over a centred window of odd width; at the ends the value of the nearest full window."""
    k = (width if width % 2 else width + 1) // 2
    out = settled(_framed(df, keys, order, k, k, make))
    low, high = F.least(F.lit(k + 1), F.col("_n")), F.greatest(F.col("_n") - k, F.lit(1))
    at = lambda place: F.max(F.when(F.col("_place") == place, F.col("_v")))
    ends = out.filter((F.col("_place") == low) | (F.col("_place") == high)).groupBy(*keys).agg(at(low).alias("_low"), at(high).alias("_high"))
    value = F.when(F.col("_place") <= k, F.col("_low")).when(F.col("_place") > F.col("_n") - k, F.col("_high")).otherwise(F.col("_v"))
    return out.join(ends, list(keys)).withColumn(name, value).select(*df.columns, name)


def rolling_binary_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, value: str = "value") -> DataFrame:
    """Centred rolling mean of a 0/1 label; the ends take the nearest full window's."""
    return _clamped(df, keys, order, width, lambda w: F.avg(value).over(w), "rolling_mean")


def rolling_mode(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, value: str = "value") -> DataFrame:
    """Centred rolling mode (the smallest of equally frequent labels); the ends take the nearest full window's."""
    values = lambda w: F.collect_list(value).over(w)  # noqa: E731  at most `width` labels

    def make(w):
        v = values(w)
        counted = F.transform(F.array_distinct(v), lambda x: F.struct((-F.size(F.filter(v, lambda y: y == x))).alias("n"), x.alias("v")))
        return F.array_min(counted)["v"]

    return _clamped(df, keys, order, width, make, "rolling_mode")


def without_repeats(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str] = ("t",)) -> DataFrame:
    """Rows that differ from the row before in some of `values`; each key's first row stays."""
    marked = with_previous(df.withColumn("_row", F.lit(True)), keys, [*values, "_row"], order)
    same = F.col("prev__row").isNotNull()
    for v in values:
        same &= F.col(v).eqNullSafe(F.col(f"prev_{v}"))
    return marked.filter(~same).select(*df.columns)


def sortedness(df: DataFrame, keys: Sequence[str], arrival: str, time: str) -> DataFrame:
    """(keys, n, is_sorted): whether times never go back in order of arrival."""
    step = with_previous(df.withColumn("_at", F.col(arrival).cast("long")), keys, [time], ["_at"], chunk=1_000_000)
    return step.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col(time) >= F.col(f"prev_{time}"), F.lit(True))).alias("is_sorted"))


def change_marks(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ("t",)) -> DataFrame:
    """`df` with changed: whether the value differs from the row before; false for the first."""
    marked = with_previous(df, keys, [value], order)
    return marked.withColumn("changed", F.coalesce(F.col(value) != F.col(f"prev_{value}"), F.lit(False))).drop(f"prev_{value}")


def nearest_value(r: DataFrame, at: int, backward: bool) -> DataFrame:
    """(sensor, t, value): each sensor's last reading before `at` (backward) or its first from `at` on. An aggregate: one row a
    task and sensor moves."""
    kept, pick = (r.filter(F.col("t") < at), F.max_by) if backward else (r.filter(F.col("t") >= at), F.min_by)
    key = F.struct("t", F.col("value"))
    return kept.groupBy("sensor").agg(pick(key, key).alias("x")).select("sensor", "x.t", "x.value")


def neighbours(points: DataFrame, queries: DataFrame, chunk: int = 30 * DAY) -> DataFrame:
    """queries (sensor, t) with before_t, before_value (last point at or before t) and after_t, after_value (first after t).

    A union sorted in chunks of time (at most `chunk`, narrower where rows are many), not a range join: one shuffle of both sides;
    chunk edges come from one row a chunk.
    """
    chunk = chunk_width(points.select("sensor", "t").union(queries.select("sensor", "t")), ["sensor"], "t", chunk)
    p = points.select("sensor", "t", F.struct("t", "value").alias("_p"), F.lit(0).alias("_q"))
    q = queries.select("sensor", "t", F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.lit(1).alias("_q"))
    both = p.union(q).withColumn("_chunk", F.floor(F.col("t") / F.lit(chunk)))
    # a frame that ends at the partition's end is worked out anew for every row; the same rows in falling order are not
    w = Window.partitionBy("sensor", "_chunk").orderBy("t", "_q", "_p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("sensor", "_chunk").orderBy(F.desc("t"), F.desc("_q"), F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    edges = points.withColumn("_chunk", F.floor(F.col("t") / F.lit(chunk))).withColumn("_p", F.struct("t", "value"))
    edges = edges.groupBy("sensor", "_chunk").agg(F.max("_p").alias("_hi"), F.min("_p").alias("_lo"))
    spans = edges.unionByName(queries.select("sensor", F.floor(F.col("t") / F.lit(chunk)).alias("_chunk")).distinct(), allowMissingColumns=True)
    spans = spans.groupBy("sensor", "_chunk").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    past, future = (Window.partitionBy("sensor").orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc("_chunk"), F.desc("_chunk")))
    spans = spans.withColumns({"_left": F.last("_hi", True).over(past), "_right": F.last("_lo", True).over(future)}).drop("_hi", "_lo")
    seen = both.withColumns({"_b": F.last("_p", True).over(w), "_a": F.last("_p", True).over(down)})
    seen = seen.filter("_q = 1").join(spans, ["sensor", "_chunk"], "left")
    before, after = F.coalesce("_b", "_left"), F.coalesce("_a", "_right")
    return seen.select("sensor", "t", before["t"].alias("before_t"), before["value"].alias("before_value"), after["t"].alias("after_t"), after["value"].alias("after_value"))


def nearest_interpolation(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(sensor, t, value): the nearest point's value; an exact midpoint takes the earlier one."""
    n = neighbours(points, queries)
    early = F.col("after_t").isNull() | (F.col("t") - F.col("before_t") <= F.col("after_t") - F.col("t"))
    return n.select("sensor", "t", F.when(F.col("before_t").isNotNull() & early, F.col("before_value")).otherwise(F.col("after_value")).alias("value"))


def linear(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """The line through two points at t; the first value where both times are equal."""
    return F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))


def linear_interpolation(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(sensor, t, value) on the line between the neighbours; beyond the ends the line through the last two points goes on.

    Points of one time count as one, with their mean. A sensor of one point is constant.
    """
    points = points.groupBy("sensor", "t").agg(F.avg("value").alias("value"))
    point = F.struct("t", "value")
    # the two first and last of a sensor, as the first and last of what an aggregate leaves: no task sorts a sensor
    edges = points.groupBy("sensor").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    ends = points.join(edges, "sensor").groupBy("sensor").agg(
        F.min(point).alias("a0"),
        F.min(F.when(F.col("t") > F.col("_lo"), point)).alias("a1"),
        F.max(F.when(F.col("t") < F.col("_hi"), point)).alias("b0"),
        F.max(point).alias("b1"),
    )
    n = neighbours(points, queries).join(ends, "sensor")
    t = F.col("t")
    through = lambda p, q: linear(t, F.col(f"{p}.t"), F.col(f"{p}.value"), F.col(f"{q}.t"), F.col(f"{q}.value"))
    value = F.when(F.col("a1").isNull(), F.col("a0.value")).when(F.col("before_t").isNull(), through("a0", "a1")).when(F.col("before_t") == t, F.col("before_value"))
    value = value.when(F.col("after_t").isNull(), through("b0", "b1")).otherwise(linear(t, F.col("before_t"), F.col("before_value"), F.col("after_t"), F.col("after_value")))
    return n.select("sensor", "t", value.alias("value"))
