"""Runs of configured distillates: each section of a configuration names its streams, and the exit status tells what came of it."""

from __future__ import annotations

import importlib
import traceback
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.model import settled

from . import store, versions

# The exit statuses.
DONE, BAD_CONFIG, SKIPPED, FAILED, NO_CHANGE = 0, 2, 3, 4, 5

def load(name: str):
    """The attribute of a module that a dotted name stands for."""
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def distillates(config: Mapping) -> list[tuple[versions.Distillate, dict[str, str], dict[str, str]]]:
    """(distillate, paths of its input streams, folders of its outputs, both by name) of each section but "global", whose "algorithm"
    is the dotted name of a function (params) -> compute.

    A section has deps (the inputs), outputs, params, paramver, mintime, maxtime (ISO times), and may have runonce, before and after. A
    missing one raises KeyError. compute takes (rows, ranges) and returns rows, as for `versions.Distillate`; with several inputs rows is
    a dict by name, with several outputs it returns one.
    """
    make, found = load(config["global"]["algorithm"]), []
    for name, c in config.items():
        if name == "global":
            continue
        sources, targets = dict(c["deps"]), dict(c["outputs"])
        if not sources or not targets:
            raise ValueError(f"{name} has no input or no output")
        low, high = (int(_nanoseconds(c[k])) for k in ("mintime", "maxtime"))
        params = dict(c["params"])
        d = versions.Distillate(name, make(**params), int(c["paramver"]), int(c.get("before", 0)), int(c.get("after", 0)), low, high, str(c.get("runonce", False)).lower() == "true", params)
        found.append((d, sources, targets))
    return found


def _nanoseconds(text: str) -> int:
    return pd.Timestamp(text, tz="UTC").value


latest = store.latest


def run(spark: SparkSession, config: Mapping) -> int:
    """Brings every distillate of a configuration up to its input's last version; the exit status.

    A run writes the changed slices of an output and then a row of control (`store.replace`), so one that is cut off leaves the last as it
    was and can be repeated. SKIPPED unless global's enabled is true; BAD_CONFIG for missing keys and algorithms that can't be found; FAILED
    when a distillate raises (the error is printed); NO_CHANGE when no input has a new version and no parameter changed.
    """
    try:
        if str(config["global"]["enabled"]).lower() != "true":
            return SKIPPED
        found = distillates(config)
    except (KeyError, ValueError, ImportError, AttributeError) as e:
        print(f"bad configuration: {e!r}")
        return BAD_CONFIG
    try:
        changed = [_refreshed(spark, *x) for x in found]
    except Exception:
        traceback.print_exc()
        return FAILED
    return DONE if any(changed) else NO_CHANGE


def _refreshed(spark: SparkSession, d: versions.Distillate, sources: dict[str, str], targets: dict[str, str]) -> bool:
    """Changed ranges of all inputs are merged; where there are several inputs, over all of their streams."""
    inputs = {name: spark.read.parquet(path) for name, path in sources.items()}
    now = {name: df.agg(F.max("version")).first()[0] for name, df in inputs.items()}
    now = {name: v for name, v in now.items() if v is not None}
    rows = {name: store.last_run(spark, folder) for name, folder in targets.items()}
    row = min(rows.values(), key=lambda r: sum(r["input_versions"].values()) if r else -1)  # an output that a run cut off didn't reach is behind
    params = versions.params_text(d)
    same = row is not None and (row["algorithm"], row["params"]) == (d.version, params)
    seen = dict(row["input_versions"]) if same else {}
    if not now or same and (d.run_once or all(seen.get(name, -1) >= v for name, v in now.items())):
        return False
    several = len(inputs) > 1
    ranges = None
    for name, df in inputs.items():
        if name in now:
            mine = versions.changed_ranges(df, seen.get(name, -1), now[name])
            mine = mine.withColumn("uuid", F.lit("")) if several else mine
            ranges = mine if ranges is None else ranges.unionByName(mine)
    ranges = versions.clamp(versions.merge_ranges(ranges), d.low, d.high)
    ranges = settled(versions.widen(ranges, d.after, d.before) if d.before or d.after else ranges)
    needed = versions.widen(ranges, d.before, d.after)
    read = {name: _inside(versions.snapshot(df, now.get(name, -1)), needed, several) for name, df in inputs.items()}
    asked = ranges.withColumn("uuid", F.lit(None).cast("string")) if several else ranges
    made = d.compute(read if several else next(iter(read.values())), asked)
    made = made if len(targets) > 1 else {next(iter(targets)): made}
    control = {"name": d.name, "algorithm": d.version, "params": params, "input_versions": {**seen, **now}}
    for name, folder in targets.items():
        store.replace(spark, folder, asked, _inside(made[name], ranges, several), control, not same)
    return True


def _inside(rows: DataFrame, ranges: DataFrame, every: bool) -> DataFrame:
    """Rows in ranges, of the same uuid or, with `every`, of any."""
    if not every:
        return versions.rows_in_ranges(rows, ranges)
    plain = rows.select(F.lit("").alias("uuid"), "time_ns", "value", F.col("uuid").alias("u"))
    return versions.rows_in_ranges(plain, ranges).select(F.col("u").alias("uuid"), "time_ns", "value")
