"""Tables in the forms that reports and front ends read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def processed_json(average: DataFrame, difference: DataFrame) -> DataFrame:
    """(sensor, json): [[slot, avg, diff], ...] of the slots that both features have."""
    both = average.select("sensor", "slot", F.col("value").alias("a")).join(difference.select("sensor", "slot", F.col("value").alias("d")), ["sensor", "slot"])
    rows = F.sort_array(F.collect_list(F.struct(F.col("slot").cast("double").alias("s"), "a", "d")))
    return both.groupBy("sensor").agg(rows.alias("x")).select("sensor", F.to_json(F.transform("x", lambda x: F.array(x["s"], x["a"], x["d"]))).alias("json"))


def graph_json(edges: DataFrame) -> DataFrame:
    """(model_id, json): nodes by name with their index, and links between indices."""
    node = edges.select("model_id", F.explode(F.array("src", "dst")).alias("name")).groupBy("model_id").agg(F.array_sort(F.collect_set("name")).alias("nodes"))
    linked = edges.join(node, "model_id").select("model_id", "nodes", F.struct((F.array_position("nodes", F.col("src")) - 1).alias("source"), (F.array_position("nodes", F.col("dst")) - 1).alias("target")).alias("link"))
    out = linked.groupBy("model_id", "nodes").agg(F.sort_array(F.collect_set("link")).alias("links"))
    return out.select("model_id", F.to_json(F.struct(F.transform("nodes", lambda n: F.struct(n.alias("name"))).alias("nodes"), "links")).alias("json"))


def cluster_table(sensors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(sensor, zero_variance, exemplar, label): every sensor; those in no cluster have no variance and the label '-'; an exemplar's
    label ends in '*'."""
    ranked = clusters.select("exemplar").distinct()
    ids = ranked.withColumn("k", F.xxhash64("exemplar")).groupBy().agg(F.array_sort(F.collect_set("exemplar")).alias("all"))
    labelled = clusters.crossJoin(F.broadcast(ids)).select("sensor", "exemplar", F.concat(F.array_position("all", F.col("exemplar")).cast("string"), F.when(F.col("is_exemplar"), "*").otherwise("")).alias("label"))
    return sensors.select("sensor").distinct().join(labelled, "sensor", "left").select("sensor", F.col("exemplar").isNull().alias("zero_variance"), "exemplar", F.coalesce("label", F.lit("-")).alias("label"))


def append_later(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old` with the rows of `new` that are later than a sensor's last."""
    last = old.groupBy("sensor").agg(F.max("t").alias("_last"))
    later = new.join(last, "sensor", "left").filter(F.col("_last").isNull() | (F.col("t") > F.col("_last"))).select(*new.columns)
    return old.unionByName(later)


def non_zero(r: DataFrame) -> DataFrame:
    """Readings without those whose time and value are both 0, and with times cut to whole seconds."""
    return r.filter((F.col("t") != 0) | (F.col("value") != 0)).withColumn("t", F.floor(F.col("t") / F.lit(1_000_000)) * 1_000_000)
