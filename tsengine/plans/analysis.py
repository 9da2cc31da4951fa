"""The whole analysis: readings to features, clusters, states, likelihoods and networks of what explains a sensor's peaks."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.functions import scalar
from tsengine.model import FLOAT_TYPE, INT_TYPE, settled
from tsengine.operators import align, clean, clusters, features, likelihood, networks, states
from tsengine.operators.weather import CONDITION_CLASSES, EVENT_CLASSES, FIELDS


@dataclass
class Analysis:
    """What one run gives; every field is a table, those of a feature with sig_tag, avg or diff."""

    purged: DataFrame
    features: DataFrame
    clusters: DataFrame
    states: DataFrame
    ranked: DataFrame
    edges: DataFrame
    failures: DataFrame


def feature_states(average: DataFrame) -> DataFrame:
    """(name, slot, state): peak states of float columns, whole numbers of the others."""
    few = average.filter(F.col("num_type") == INT_TYPE).filter("value is not null").select(F.col("sensor").alias("name"), "slot", F.col("value").cast("int").alias("state"))
    many = states.peak_states(average.filter(F.col("num_type") != INT_TYPE).filter("value is not null").select("sensor", "slot", "value"))
    return few.union(many.select(F.col("sensor").alias("name"), "slot", "state"))


def calendar_states(slots: DataFrame, start: int, width: int, site_tz: str = "UTC") -> DataFrame:
    """(name, slot, state) of month, weekday and hour of each slot; fields that never change are left out."""
    cal = scalar.calendar(F.col("slot") * width + start, site_tz)
    one = slots.select("slot").distinct().select("slot", *[c.alias(k) for k, c in cal.items()])
    long = one.select("slot", F.explode(F.create_map(*[x for k in cal for x in (F.lit(k), F.col(k).cast("int"))])).alias("name", "state"))
    return align.varying(long, ["name"], "state").select("name", "slot", "state")


def weather_states(weather: DataFrame, start: int, end: int, width: int, max_gap: int) -> DataFrame:
    """(name, slot, state) of the weather fields of a table with t (microseconds) and columns of text or numbers.

    Numbers outside the bounds of the weather's outlier rule go; the others take the mean of a slot and then the rounded centre of their state; conditions and events take their class and then
    the commonest class of a slot. Gaps are filled as for sensors; fields that never change, and columns that the table lacks,
    are left out. Texts that no class has are missing values.
    """
    spark = weather.sparkSession
    found = {c.replace("_", " "): c for c in weather.columns}
    classes = {"Conditions": CONDITION_CLASSES, "Events": EVENT_CLASSES}
    values = {f: F.expr(f"try_cast(`{found[f]}` as double)") for f in FIELDS if f in found and f not in classes}
    for f, known in classes.items():
        if f in found:
            table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
            values[f] = F.try_element_at(table, F.coalesce(F.trim(F.col(f"`{found[f]}`")), F.lit(""))).cast("double")
    if not values:
        return spark.createDataFrame([], "name string, slot long, state int")
    rows = weather.select("t", F.explode(F.array(*[F.struct(F.lit(f).alias("sensor"), v.alias("value")) for f, v in values.items()])).alias("x"))
    r = rows.select("x.sensor", "t", "x.value").filter("t is not null and value is not null and not isnan(value)")
    is_class = F.col("sensor").isin(list(classes))
    r = r.filter(is_class).unionByName(clean.mark_outliers(r.filter(~is_class), ["sensor"], "value", *clean.OUTLIER_RULES["weather"]).filter("not outlier").select(r.columns))
    types = spark.createDataFrame([(f, INT_TYPE if f in classes else FLOAT_TYPE) for f in values], "sensor string, num_type int")
    slots = align.with_all_slots(features.slot_feature(align.assign_slots(r, start, end, width), types), align.slot_grid(spark, start, end, width))
    filled = settled(clean.fill_gaps(slots, max_gap, nearest=F.col("sensor").isin(list(classes))).filter("filled is not null"))
    symbols = filled.filter(F.col("sensor").isin(list(classes))).select("sensor", "slot", F.col("filled").cast("int").alias("state"))
    numbers = filled.filter(~F.col("sensor").isin(list(classes))).select("sensor", "slot", F.col("filled").alias("value"))
    centres = states.value_states(numbers, ["sensor"], "value", 30).select("sensor", "value", F.round("centre").cast("int").alias("state"))
    both = symbols.union(numbers.join(centres, ["sensor", "value"]).select("sensor", "slot", "state"))
    return align.varying(both.withColumnRenamed("sensor", "name"), ["name"], "state").select("name", "slot", "state")


#: How many causes each network of an effect takes: the likeliest sensors, weather fields and calendar fields; the combined one
#: takes the parents that these three find, with more sensors.
NETWORK_CAUSES = {"sensor": 5, "weather": 10, "time": 10, "all": 20}


def effect_networks(s: DataFrame, effect: str, sensors: Sequence[str], weather: Sequence[str], calendar: Sequence[str]) -> dict[str, list[tuple[str, str]]]:
    """Edges of the four networks of an effect: of its likeliest sensors, of the weather, of the calendar, and of what explains the
    effect in those. The effect causes nothing; in the combined network sensors cause neither weather nor calendar, weather no
    calendar, and calendar fields not each other. s: (name, slot, state); sensors: likeliest first."""

    def climb(causes, layers=(), black=()):
        names = [effect, *causes]
        wide = s.filter(F.col("name").isin(names)).groupBy("slot").pivot("name", names).agg(F.first("state")).na.drop("any")
        return networks.hill_climb(wide, names, [*networks.effect_blacklist(effect, causes, layers), *black])[0]

    def parents(edges):
        return sorted(x for x, y in edges if y == effect)

    found, best = {}, {}
    for net, causes, layers in (("sensor", sensors, ()), ("weather", weather, ()), ("time", calendar, (calendar,))):
        some = list(causes)[: NETWORK_CAUSES[net]]
        found[net] = climb(some, layers) if some else []
        best[net] = parents(found[net])
    if len(sensors) > NETWORK_CAUSES["sensor"]:
        best["sensor"] = parents(climb(list(sensors)[: NETWORK_CAUSES["all"]]))
    a, w, c = best["sensor"], best["weather"], best["time"]
    black = [(x, y) for x in a for y in [*w, *c]] + [(x, y) for x in w for y in c]
    found["all"] = climb([*a, *w, *c], [c], black) if a or w or c else []
    return found


def analyse(
    r: DataFrame,
    start: int,
    end: int,
    width: int,
    effects: Sequence[str],
    n_causes: int = 5,
    gap_share: float = 0.05,
    site_tz: str = "UTC",
    weather: DataFrame | None = None,
    tags: Sequence[str] = ("avg", "diff"),
) -> Analysis:
    """Runs the chain for the readings in [start, end), for the average and the difference feature (tags).

    Sensors with fewer readings than slots are purged. Only exemplars of the clusters of float sensors go on, with all sensors of
    few levels. For each effect the likeliest causes are ranked, and four networks give edges (`effect_networks`); their model_id
    is effect|tag|network. weather: a table of weather rows (`weather_states`), or none. An effect that can't be modelled becomes
    a row of failures, and the others go on.
    """
    spark = r.sparkSession
    grid = align.slot_grid(spark, start, end, width)
    n_slots = max(0, -(-(end - start) // width))
    max_gap = max(1, int(n_slots * gap_share))
    inside = align.in_range(r, start, end)
    kept = align.purge(inside, n_slots)
    calendar = settled(calendar_states(grid, start, width, site_tz))
    fields = settled(weather_states(weather, start, end, width, max_gap)) if weather is not None else calendar.limit(0)
    names_of = lambda df: sorted(x["name"] for x in df.select("name").distinct().collect())  # noqa: E731  a few fields
    calendar_names, weather_names = names_of(calendar), names_of(fields)
    tables: dict[str, list[DataFrame]] = {k: [] for k in ("features", "clusters", "states", "ranked")}
    found, failures = [], []
    for tag in tags:
        make = features.average_features if tag == "avg" else features.difference_features
        # one row a sensor and slot: small beside the readings, and read by all that follows
        columns = settled(make(kept, grid, start, end, width, max_gap))
        floats = columns.filter(F.col("num_type") != INT_TYPE)
        grouped = settled(clusters.cluster(clusters.distances(floats), floats))
        chosen = grouped.filter("is_exemplar").select("sensor").union(columns.filter(F.col("num_type") == INT_TYPE).select("sensor")).distinct()
        wanted = chosen.union(columns.filter(F.col("sensor").isin(list(effects))).select("sensor")).distinct()
        sensors = settled(feature_states(columns.join(wanted, "sensor", "left_semi")))
        s = settled(sensors.union(calendar).union(fields))
        ranked = settled(likelihood.top_causes(likelihood.best_states(likelihood.state_likelihoods(s, effects)), max(n_causes, NETWORK_CAUSES["all"])))
        best: dict[str, list[str]] = {}
        for row in ranked.select("effect", "cause").orderBy("effect", "rank").collect():  # a bounded number of rows an effect
            if row["cause"] not in calendar_names and row["cause"] not in weather_names:
                best.setdefault(row["effect"], []).append(row["cause"])
        there = set(names_of(sensors.filter(F.col("name").isin(list(effects)))))
        for effect in effects:
            if effect not in there:
                failures.append((effect, tag, "it has no states"))
                continue
            try:
                nets = effect_networks(s, effect, best.get(effect, []), weather_names, calendar_names)
            except ValueError as e:
                failures.append((effect, tag, str(e)))
                continue
            found += [(f"{effect}|{tag}|{net}", a, b) for net, edges in nets.items() for a, b in edges]
        told = F.lit(tag).alias("sig_tag")
        for name, df in zip(tables, (columns, grouped, s, ranked.filter(F.col("rank") <= n_causes))):
            tables[name].append(df.select(told, *df.columns))
    union = lambda parts: functools.reduce(DataFrame.union, parts)
    edges = spark.createDataFrame(found, "model_id string, src string, dst string")
    failed = spark.createDataFrame(failures, "effect string, sig_tag string, reason string")
    return Analysis(align.purge_list(inside, n_slots), *[union(parts) for parts in tables.values()], edges, failed)
