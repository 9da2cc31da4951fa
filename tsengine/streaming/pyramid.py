"""A stored tree of statistical windows: count, minimum, sum and maximum by power of two of time, kept up to date by changed ranges.

A node is (uuid, level, idx, n, low, total, high, version): of the readings with time_ns in [idx << level, (idx + 1) << level). A store
is append-only; of the nodes of one place the one of the highest version counts, and n = 0 stands for one that lost its readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.model import settled

from . import versions

#: Powers of the lowest and the highest stored level (about 18 minutes and 104 days), and levels that are summed in one step.
BASE, TOP, STEP = 40, 53, 4
NODE = ["uuid", "level", "idx", "n", "low", "total", "high"]


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("uuid", "level", "idx").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("total").alias("total"), F.max("high").alias("high"))


def leaves(rows: DataFrame, base: int = BASE) -> DataFrame:
    """The nodes of the lowest level of rows (uuid, time_ns, value); counted where the rows lie before they move."""
    v = F.col("value")
    one = rows.select("uuid", F.lit(base).alias("level"), F.shiftright("time_ns", base).alias("idx"), F.lit(1).cast("long").alias("n"), v.alias("low"), v.alias("total"), v.alias("high"))
    return _summed(one)


def _above(nodes: DataFrame, base: int, top: int) -> list[DataFrame]:
    """The levels over the nodes of one level, STEP levels at a time from the topmost one known."""
    out, level = [], base
    while level < top:
        ups = list(range(level + 1, min(level + STEP, top) + 1))
        up = nodes.withColumn("up", F.explode(F.array(*map(F.lit, ups))))
        many = settled(_summed(up.select("uuid", F.col("up").alias("level"), F.expr("shiftright(idx, up - level)").alias("idx"), "n", "low", "total", "high")))
        out.append(many)
        level = ups[-1]
        nodes = many.filter(F.col("level") == level)
    return out


def build(stream: DataFrame, version: int, base: int = BASE, top: int = TOP) -> DataFrame:
    """All nodes of a versioned stream as visible at `version`."""
    first = settled(leaves(versions.snapshot(stream, version), base))
    out = first
    for more in _above(first, base, top):
        out = out.unionByName(more)
    return out.select(*NODE, F.lit(version).cast("long").alias("version"))


def current(store: DataFrame) -> DataFrame:
    """The nodes that count, empty ones left out."""
    last = store.groupBy("uuid", "level", "idx").agg(F.max_by(F.struct("n", "low", "total", "high"), "version").alias("x"))
    return last.select("uuid", "level", "idx", "x.*").filter("n > 0")


def updated(store: DataFrame, stream: DataFrame, after: int, version: int, base: int = BASE, top: int = TOP) -> DataFrame:
    """The nodes to append to a store of version `after` so that it becomes that of `version`.

    Only leaves that changed ranges touch are counted again, from their rows, and only nodes above them are summed again, each from its
    two stored or new children; so the work follows the changes, not the store.
    """
    ranges = versions.changed_ranges(stream, after, version, 0)
    cut = versions.slices(ranges, base)
    touched = settled(cut.select("uuid", F.shiftright("start_ns", base).alias("idx")).distinct())
    whole = touched.select("uuid", F.shiftleft("idx", base).alias("start_ns"), F.shiftleft(F.col("idx") + 1, base).alias("end_ns"))
    rows = versions.rows_in_ranges(versions.snapshot(versions.rows_in_ranges(stream, whole), version), whole)
    fresh = touched.withColumn("level", F.lit(base)).join(leaves(rows, base), ["uuid", "level", "idx"], "left").fillna(0, ["n"])
    old = current(store)
    parts = [settled(fresh.select(*NODE))]
    for level in range(base + 1, top + 1):
        below = parts[-1]
        parents = below.select("uuid", F.shiftright("idx", 1).alias("idx")).distinct()
        children = parents.select("uuid", F.lit(level - 1).alias("level"), F.explode(F.array(F.col("idx") * 2, F.col("idx") * 2 + 1)).alias("idx"))
        kept = children.join(below.select("uuid", "idx"), ["uuid", "idx"], "left_anti").join(old.filter(F.col("level") == level - 1), ["uuid", "level", "idx"])
        both = kept.select(*NODE).unionByName(below.select(*NODE))
        parts.append(settled(_summed(both.withColumns({"level": F.lit(level), "idx": F.shiftright("idx", 1)})).select(*NODE)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("version", F.lit(version).cast("long"))


def windows(store: DataFrame, start: int, end: int, width_power: int) -> DataFrame:
    """(uuid, time, count, min, mean, max) of windows of 2^width_power ticks, both bounds rounded down to windows, as
    `features.statistical_windows`; a stored level is read as it is and no reading is touched."""
    a, b = start >> width_power, end >> width_power
    nodes = current(store.filter((F.col("level") == width_power) & (F.col("idx") >= a) & (F.col("idx") < b)))
    return nodes.select("uuid", F.shiftleft("idx", width_power).alias("time"), F.col("n").alias("count"), F.col("low").alias("min"), (F.col("total") / F.col("n")).alias("mean"), F.col("high").alias("max"))


def edge_rows(rows: DataFrame, ranges: DataFrame, base: int = BASE) -> DataFrame:
    """(range, uuid, time_ns, value): the rows of each range that lie in its first or last leaf and not in a leaf that is whole
    inside the range: an equi-join on leaves, of which a range has two at most."""
    leaf = lambda c: F.shiftright(c, base)
    whole_from, whole_to = leaf(F.col("start_ns") + ((1 << base) - 1)), leaf(F.col("end_ns"))
    ends = ranges.filter("end_ns > start_ns").withColumns({"_from": whole_from, "_to": whole_to})
    at = ends.withColumn("_leaf", F.explode(F.array_distinct(F.array(leaf(F.col("start_ns")), leaf(F.col("end_ns") - 1)))))
    at = at.filter(~((F.col("_leaf") >= F.col("_from")) & (F.col("_leaf") < F.col("_to"))))
    near = rows.withColumn("_leaf", leaf(F.col("time_ns"))).join(at, ["uuid", "_leaf"])
    return near.filter((F.col("time_ns") >= F.col("start_ns")) & (F.col("time_ns") < F.col("end_ns"))).select("range", "uuid", "time_ns", "value")


def whole_nodes(ranges: DataFrame, base: int = BASE, top: int = TOP) -> DataFrame:
    """(range, uuid, level, idx): the nodes that make up the whole leaves of each range (range, uuid, start_ns, end_ns): at most two a
    level, and those of the highest level in between."""
    cover = ranges.withColumns({"_lo": F.shiftright(F.col("start_ns") + ((1 << base) - 1), base), "_hi": F.shiftright("end_ns", base)}).filter("_lo < _hi")
    out = None
    for k in range(top - base + 1):
        lo, hi = F.shiftright(F.col("_lo") + ((1 << k) - 1), k), F.shiftright("_hi", k)
        if k < top - base:  # an odd end has no partner inside
            ends = F.array_compact(F.array(F.when((lo < hi) & (F.pmod(lo, F.lit(2)) == 1), lo), F.when((lo < hi) & (F.pmod(hi, F.lit(2)) == 1), hi - 1)))
        else:
            ends = F.when(lo < hi, F.sequence(lo, hi - 1))
        level = cover.select("range", "uuid", F.lit(base + k).alias("level"), F.explode(ends).alias("idx"))
        out = level if out is None else out.unionByName(level)
    return out


def range_statistics(store: DataFrame, rows: DataFrame, ranges: DataFrame, base: int = BASE, top: int = TOP) -> DataFrame:
    """(range, uuid, count, min, mean, max) of any [start_ns, end_ns) of `ranges` (range, uuid, start_ns, end_ns); those without
    readings give no row. rows: (uuid, time_ns, value) as visible at the store's version.

    Whole leaves come from stored nodes, about twice as many as there are levels; rows are read only at a range's two ends.
    """
    nodes = whole_nodes(ranges, base, top).join(current(store), ["uuid", "level", "idx"]).select("range", "uuid", "n", "low", "total", "high")
    v = F.col("value")
    ends = edge_rows(rows, ranges, base).select("range", "uuid", F.lit(1).cast("long").alias("n"), v.alias("low"), v.alias("total"), v.alias("high"))
    both = nodes.unionByName(ends).groupBy("range", "uuid").agg(F.sum("n").alias("count"), F.min("low").alias("min"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("high").alias("max"))
    return both
