"""Alignment of irregular readings on a grid of time slots, and the selections around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsengine.model import MINUTE, SECOND


def slot_grid(spark: SparkSession, start: int, end: int, width: int) -> DataFrame:
    """(slot, slot_t): slots of `width` from `start` while they begin before `end`."""
    return spark.range(max(0, -(-(end - start) // width))).select(F.col("id").alias("slot"), (F.col("id") * width + start).alias("slot_t"))


def in_range(r: DataFrame, start: int, end: int) -> DataFrame:
    """Readings with start <= t < end; the filter reaches the scan when t is stored."""
    return r.filter((F.col("t") >= start) & (F.col("t") < end))


def inside_open_range(r: DataFrame, start: int, end: int) -> DataFrame:
    """Readings strictly between the bounds."""
    return r.filter((F.col("t") > start) & (F.col("t") < end))


def assign_slots(r: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """Readings in [start, end) with slot and offset (microseconds since the slot began); no shuffle."""
    kept = in_range(r, start, end)
    return kept.withColumns({"slot": F.floor((F.col("t") - start) / F.lit(width)), "offset": (F.col("t") - start) % width})


def with_all_slots(values: DataFrame, grid: DataFrame, keys: Sequence[str] = ("sensor",)) -> DataFrame:
    """One row for each key and slot, null where `values` has none. The grid is small (one row a slot) and broadcast."""
    return values.select(*keys).distinct().crossJoin(F.broadcast(grid.select("slot"))).join(values, [*keys, "slot"], "left")


def enough_samples(r: DataFrame, least: int = 10) -> DataFrame:
    """(sensor, n, enough): whether a sensor has at least `least` readings."""
    return r.groupBy("sensor").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= least)


def purge_list(r: DataFrame, n_slots: int) -> DataFrame:
    """(sensor, n, purged): sensors with fewer readings than slots are purged."""
    return r.groupBy("sensor").agg(F.count("*").alias("n")).withColumn("purged", F.col("n") < n_slots)


def purge(r: DataFrame, n_slots: int) -> DataFrame:
    """Readings of the sensors that `purge_list` keeps. Their names are broadcast, so the readings stay where they are."""
    return r.join(F.broadcast(purge_list(r, n_slots).filter("not purged").select("sensor")), "sensor", "left_semi")


def unavailable(wanted: DataFrame, r: DataFrame) -> DataFrame:
    """Wanted sensors without any reading."""
    return wanted.select("sensor").distinct().join(r.select("sensor"), "sensor", "left_anti")


def common_range(r: DataFrame, n_slots: int) -> DataFrame:
    """(n_sensors, first_t, last_t): the range that all sensors with at least n_slots readings cover."""
    each = r.groupBy("sensor").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).filter(F.col("n") >= n_slots)
    return each.agg(F.count("*").alias("n_sensors"), F.max("a").alias("first_t"), F.min("b").alias("last_t"))


def common_times(r: DataFrame) -> DataFrame:
    """Distinct times inside the range that all sensors cover."""
    span = common_range(r, 1)
    return r.join(F.broadcast(span), (F.col("t") >= F.col("first_t")) & (F.col("t") <= F.col("last_t"))).select("t").distinct()


def chunks(spark: SparkSession, start: int, end: int, width: int) -> DataFrame:
    """(chunk, begin, finish): [start, end) cut into ranges of `width`, the last clipped."""
    n = max(0, -(-(end - start) // width))
    return spark.range(n).select(F.col("id").alias("chunk"), (F.col("id") * width + start).alias("begin"), F.least(F.col("id") * width + start + width, F.lit(end)).alias("finish"))


def not_numeric(raw: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose raw value isn't a number; an empty result verifies the format."""
    return raw.filter(F.col(value).isNotNull() & F.col(value).try_cast("double").isNull())


def check_matrix(long: DataFrame, keys: Sequence[str] = ("sensor",)) -> DataFrame:
    """For each column of a matrix in long form: missing, NaN and infinite entries, and whether it is constant."""
    v = F.col("value")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return long.groupBy(*keys).agg(
        F.count_if(v.isNull()).alias("n_missing"),
        F.count_if(F.coalesce(F.isnan(v), F.lit(False))).alias("n_nan"),
        F.count_if(F.coalesce(F.abs(v) == float("inf"), F.lit(False))).alias("n_infinite"),
        (F.count_distinct(F.when(~bad, v)) <= 1).alias("constant"),
    )


def select_sensors(df: DataFrame, which: str | Sequence[str] | None, column: str = "sensor") -> DataFrame:
    """Rows whose sensor matches a regular expression, or is listed, or all."""
    if which is None:
        return df
    return df.filter(F.col(column).rlike(which) if isinstance(which, str) else F.col(column).isin(list(which)))


def matching(names: DataFrame, phrase: str, column: str) -> DataFrame:
    """Distinct names that contain a phrase, whatever its case."""
    return names.filter(F.upper(F.col(column)).contains(phrase.upper())).select(column).distinct()


def is_uuid(column: str | Column) -> Column:
    """Whether a string begins as a uuid does."""
    return (F.col(column) if isinstance(column, str) else column).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


def complete_slots(long: DataFrame, n_columns: int) -> DataFrame:
    """Rows of the slots in which no column is missing."""
    full = long.filter("value is not null").groupBy("slot").agg(F.count_distinct("sensor").alias("n")).filter(F.col("n") >= n_columns)
    return long.join(full.select("slot"), "slot", "left_semi")


def varying(long: DataFrame, keys: Sequence[str] = ("sensor",), value: str = "value") -> DataFrame:
    """Rows of the columns that take more than one value."""
    good = long.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo <> hi").select(*keys)
    return long.join(good, list(keys), "left_semi")


def with_ids(rows: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """`rows` with the id of their name, from `names` (`name`, id); null where `names` doesn't have it."""
    return rows.join(names.select(name, "id"), name, "left")


def within_minutes(r: DataFrame) -> DataFrame:
    """Readings whose times were cut to the minute, spread over it in the order of their values: the k-th of n gets k times 60 / n
    seconds from k = 0, one alone 30."""
    w = Window.partitionBy("sensor", "t")
    # whole numbers of 64 bits: the 36th place times a minute passes 32 bits
    place, many = F.row_number().over(w.orderBy("value")).cast("long") - 1, F.count("*").over(w)
    return r.select("sensor", (F.col("t") + F.when(many == 1, F.lit(30 * SECOND)).otherwise(F.call_function("div", place * MINUTE, many))).alias("t"), "value")


def site_names(df: DataFrame, column: str, names: DataFrame, skip: int = 2, take: int | None = None, kinds: Sequence[str] = ()) -> DataFrame:
    """`df` with site_name: the name that `names` (key, name) has for the text after `skip` characters, `take` long; else the text as
    it is.

    With kinds, the first of them that the text contains and the four characters before the separator ahead of that many last
    characters follow, joined by _; a text without any keeps its own.
    """
    text = F.col(column)
    key = F.substring(text, F.lit(skip + 1), F.lit(take if take is not None else 1 << 20))
    found = df.withColumn("_key", key).join(names.select(F.col("key").alias("_key"), F.col("name").alias("_name")), "_key", "left")
    name = F.col("_name")
    if kinds:
        kind = F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in kinds])
        from_end = F.length(text) - F.length(kind)
        name = F.concat_ws("_", name, kind, F.substring(text, from_end - 4, F.lit(4)))
        name = F.when(F.col("_name").isNotNull() & kind.isNotNull(), name)
    return found.withColumn("site_name", F.coalesce(name, text)).drop("_key", "_name")
