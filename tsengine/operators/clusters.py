"""Distances between sensors, clusters with exemplars, and cluster quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsengine.model import settled

from . import grouping


def pairs(names: DataFrame, column: str = "sensor") -> DataFrame:
    """(a, b): all pairs a < b of a column's distinct names. For tables of sensors, not of readings."""
    one = names.select(column).distinct()
    return one.select(F.col(column).alias("a")).join(one.select(F.col(column).alias("b")), F.col("a") < F.col("b"))


def distances(features: DataFrame) -> DataFrame:
    """(a, b, d): Euclidean distances, a < b, from sums of products per slot (|x|^2 + |y|^2 - 2 xy), missing values as 0.

    A slot's rows meet each other: one row a sensor and slot, so the work is slots times sensors squared, and partial sums move.
    """
    f = features.filter("value is not null").select("sensor", "slot", "value")
    left, right = f.select(F.col("sensor").alias("a"), "slot", F.col("value").alias("x")), f.select(F.col("sensor").alias("b"), "slot", F.col("value").alias("y"))
    dot = left.join(right, "slot").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    norm = f.groupBy("sensor").agg(F.sum(F.col("value") * F.col("value")).alias("n2"))
    all_pairs = pairs(norm).join(norm.select(F.col("sensor").alias("a"), F.col("n2").alias("na")), "a").join(norm.select(F.col("sensor").alias("b"), F.col("n2").alias("nb")), "b")
    return all_pairs.join(dot, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(F.col("na") + F.col("nb") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0))).alias("d"))


def full_matrix(d: DataFrame, names: DataFrame, default: float = 2.0) -> DataFrame:
    """(a, b, d) for all ordered pairs; 0 on the diagonal, `default` where no distance is known."""
    both = d.select("a", "b", "d").union(d.select("b", "a", "d"))
    one = names.select("sensor").distinct()
    grid = one.select(F.col("sensor").alias("a")).crossJoin(one.select(F.col("sensor").alias("b")))
    return grid.join(both, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("d", F.lit(default))).alias("d"))


def distance_summary(d: DataFrame) -> DataFrame:
    """(min_d, max_d, avg_d) over the pairs a < b."""
    return d.filter("a < b").agg(F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.avg("d").alias("avg_d"))


def distance_bounds(correlation: float) -> float:
    """Distance of two normalised columns with that correlation."""
    return float(np.sqrt(2 * (1 - correlation)))


def _others(d: DataFrame, names: DataFrame, sparse: bool) -> DataFrame:
    return (d.select("a", "b", "d").union(d.select("b", "a", "d")) if sparse else full_matrix(d, names)).filter("a <> b")


def clusterings(d: DataFrame, names: DataFrame, low_correlation: float = 0.1, high_correlation: float = 0.9) -> DataFrame:
    """(method, k, sensor, exemplar, is_exemplar): the sensors grouped by packing, by affinity, and by Ward and k-means over the rows
    of the matrix of distances, those two for every k from 2 to the number of packs. Exemplars of the latter are medoids.

    Ward's pairs of rows meet on their columns, so this takes the cube of the number of sensors; it is meant for comparing methods.
    """
    low, high = distance_bounds(high_correlation), distance_bounds(low_correlation)
    matrix = settled(full_matrix(d, names))
    others = matrix.filter("a <> b")
    told = lambda method, found: found.withColumn("method", F.lit(method))
    packed = grouping.packs(others, names, low, high)
    near = grouping.affinity(others.select("a", "b", (2.0 - F.col("d")).alias("s")), names)
    counted = [told(m, c.crossJoin(F.broadcast(c.agg(F.count_distinct("exemplar").cast("int").alias("k"))))) for m, c in (("pack", packed), ("affinity", near))]  # one number
    most = packed.filter("is_exemplar").count()
    found = counted
    if most > 1:
        x, y = matrix.select("a", F.col("b").alias("slot"), F.col("d").alias("x")), matrix.select(F.col("a").alias("b"), F.col("b").alias("slot"), F.col("d").alias("y"))
        cost = x.join(y, "slot").filter("a < b").groupBy("a", "b").agg((F.sum((F.col("x") - F.col("y")) ** 2) / 2).alias("c"))
        ward = grouping.ward_groups(grouping.ward(cost, names), names, list(range(2, most + 1)))
        means = grouping.kmeans(matrix.select(F.col("a").alias("sensor"), F.col("b").alias("slot"), F.col("d").alias("value")), most)
        found = [*counted, *(told(m, grouping.medoids(others, g, ["k"])) for m, g in (("ward", ward), ("kmeans", means)))]
    out = found[0].select("method", "k", "sensor", "exemplar", "is_exemplar")
    for f in found[1:]:
        out = out.unionByName(f.select(out.columns))
    return out


def compare_clusterings(d: DataFrame, found: DataFrame, low: float, high: float) -> DataFrame:
    """(method, k, intra_min, intra_avg, intra_max, inter_min, validity, intra_violations, inter_violations): `cluster_quality` and
    `constraint_violations` of every clustering in `found`."""
    of = ["method", "k"]
    a, b = (found.select(*of, *[F.col(c).alias(f"{c}_{x}") for c in ("sensor", "exemplar", "is_exemplar")]) for x in "ab")
    both = d.filter("a < b").join(a, F.col("a") == F.col("sensor_a")).join(b.withColumnRenamed("sensor_b", "b"), ["b", *of])
    inside = F.col("exemplar_a") == F.col("exemplar_b")
    x = lambda f, cond: f(F.when(cond, F.col("d")))
    out = both.groupBy(*of).agg(
        x(F.min, inside).alias("intra_min"), x(F.avg, inside).alias("intra_avg"), x(F.max, inside).alias("intra_max"), x(F.min, ~inside).alias("inter_min"),
        F.count_if(inside & (F.col("d") > high)).alias("intra_violations"), F.count_if(F.col("is_exemplar_a") & F.col("is_exemplar_b") & (F.col("d") < low)).alias("inter_violations"),
    )
    return out.withColumn("validity", F.try_divide("intra_avg", "inter_min"))


def cluster_labels(clusters: DataFrame, constant: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sensor, label, sparsity): of each period a sensor's cluster number, counted from 0 by the exemplars' names; an exemplar's
    has a star and sparsity 1; '-' for the constant ones.

    clusters: (keys, sensor, exemplar, is_exemplar); constant: (keys, sensor). Numbers are given over a period's exemplars.
    """
    w = Window.partitionBy(*keys).orderBy("exemplar")
    number = clusters.select(*keys, "exemplar").distinct().withColumn("_n", F.row_number().over(w) - 1)
    label = F.concat(F.col("_n").cast("string"), F.when(F.col("is_exemplar"), F.lit("*")).otherwise(F.lit("")))
    named = clusters.join(number, [*keys, "exemplar"]).select(*keys, "sensor", label.alias("label"), F.col("is_exemplar").cast("int").alias("sparsity"))
    return named.unionByName(constant.select(*keys, "sensor", F.lit("-").alias("label"), F.lit(0).alias("sparsity")))


def label_table(labels: DataFrame, period: str, periods: list, value: str = "label") -> DataFrame:
    """One row a sensor, one column a period with its label (or another value); null where it has none."""
    return labels.groupBy("sensor").pivot(period, periods).agg(F.first(value))


def cluster_statistics(clusters: DataFrame, constant: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """(keys, n_constant, n_labelled, n_clusters, sensors_per_cluster, avg_error): of each period; avg_error is the mean over its
    clusters of their sensors' mean `error` (such as the distance to the exemplar)."""
    each = clusters.groupBy(*keys, "exemplar").agg(F.count("*").alias("_n"), F.avg(error).alias("_e"))
    total = each.groupBy(*keys).agg(F.sum("_n").alias("n_labelled"), F.count("*").alias("n_clusters"), F.avg("_e").alias("avg_error"))
    out = total.join(constant.groupBy(*keys).agg(F.count("*").alias("n_constant")), keys, "full")
    out = out.fillna(0, ["n_constant", "n_labelled", "n_clusters"])
    return out.withColumn("sensors_per_cluster", F.try_divide(F.col("n_labelled").cast("double"), "n_clusters"))


def cluster(d: DataFrame, names: DataFrame, method: str = "affinity", correlation: float = 0.9, sparse: bool = False) -> DataFrame:
    """(sensor, exemplar, is_exemplar): sensors grouped around exemplars, from distances (a, b, d), a < b.

    method: affinity, or pack with the distances of correlation 0.9 and its square as bounds. sparse: pairs without a distance stay
    out, for many sensors with few near ones each; otherwise they have the distance 2, and the table has all pairs.
    """
    others = _others(d, names, sparse)
    if method == "affinity":
        return grouping.affinity(others.select("a", "b", (2.0 - F.col("d")).alias("s")), names)
    return grouping.packs(others, names, distance_bounds(correlation), distance_bounds(correlation**2))


def members(clusters: DataFrame) -> DataFrame:
    """(exemplar, children): the other members of each exemplar's cluster, by name."""
    return clusters.groupBy("exemplar").agg(F.sort_array(F.collect_list(F.when(~F.col("is_exemplar"), F.col("sensor")))).alias("children"))


def cluster_quality(d: DataFrame, clusters: DataFrame) -> DataFrame:
    """(n_clusters, intra_min, intra_avg, intra_max, inter_min, validity): distances inside and between clusters; validity is
    intra_avg over inter_min."""
    c = clusters.select("sensor", "exemplar")
    both = d.filter("a < b").join(c.select(F.col("sensor").alias("a"), F.col("exemplar").alias("ea")), "a").join(c.select(F.col("sensor").alias("b"), F.col("exemplar").alias("eb")), "b")
    inside = F.col("ea") == F.col("eb")
    x = lambda f, cond: f(F.when(cond, F.col("d")))
    out = both.agg(x(F.min, inside).alias("intra_min"), x(F.avg, inside).alias("intra_avg"), x(F.max, inside).alias("intra_max"), x(F.min, ~inside).alias("inter_min"))
    count = clusters.agg(F.count_distinct("exemplar").alias("n_clusters"))
    return count.crossJoin(out).withColumn("validity", F.try_divide("intra_avg", "inter_min"))


def constraint_violations(d: DataFrame, clusters: DataFrame, low: float, high: float) -> DataFrame:
    """(intra_violations, inter_violations): pairs of a cluster further apart than `high`, exemplars closer than `low`."""
    c = clusters.select("sensor", "exemplar", "is_exemplar")
    a, b = c.select(*[F.col(x).alias(f"{x}_a") for x in c.columns]), c.select(*[F.col(x).alias(f"{x}_b") for x in c.columns])
    both = d.filter("a < b").join(a, F.col("a") == F.col("sensor_a")).join(b, F.col("b") == F.col("sensor_b"))
    return both.agg(
        F.count_if((F.col("exemplar_a") == F.col("exemplar_b")) & (F.col("d") > high)).alias("intra_violations"),
        F.count_if(F.col("is_exemplar_a") & F.col("is_exemplar_b") & (F.col("d") < low)).alias("inter_violations"),
    )


def name_similarity(names: DataFrame, column: str, weights: DataFrame | None = None) -> DataFrame:
    """(a, b, distance): weighted number of name tokens (parted by _, / or blank) that one name has and the other lacks.

    weights: (token, weight); 1 without it. Names that share a token meet on it; others differ by all their tokens.
    """
    tokens = names.select(column).distinct().select(F.col(column).alias("name"), F.explode(F.array_distinct(F.filter(F.split(column, r"[_/\s]+"), lambda x: x != ""))).alias("token"))
    w = tokens.withColumn("weight", F.lit(1.0)) if weights is None else tokens.join(weights, "token", "left").fillna(1.0, ["weight"])
    size = w.groupBy("name").agg(F.sum("weight").alias("size"))
    both = w.select("token", "weight", F.col("name").alias("a")).join(w.select("token", F.col("name").alias("b")), "token").filter("a < b").groupBy("a", "b").agg(F.sum("weight").alias("shared"))
    grid = pairs(size, "name").join(size.select(F.col("name").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("name").alias("b"), F.col("size").alias("sb")), "b")
    return grid.join(both, ["a", "b"], "left").select("a", "b", (F.col("sa") + F.col("sb") - 2 * F.coalesce("shared", F.lit(0.0))).alias("distance"))


def exclusive(one_hot: DataFrame, a: str, b: str) -> DataFrame:
    """(exclusive): whether exactly one of two 0/1 columns is set in every row."""
    return one_hot.agg(F.bool_and(F.col(a) + F.col(b) == 1).alias("exclusive"))
