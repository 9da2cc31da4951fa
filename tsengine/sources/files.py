"""Readers and writers: sensor CSV and text, readings JSON, key-value sequence files, weather CSV, metadata; exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.functions import scalar
from tsengine.model import SECOND, micros, readings

SENSOR_CSV = "ts string, value double"
WEATHER_TIME = "DateUTC"


def _name_of_file(suffix: str) -> F.col:
    return F.regexp_extract(F.input_file_name(), rf"([^/]+?)(?:{suffix})?$", 1)


def merge_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of readings, such as one a month, one after the other; columns are matched by name, and missing ones are null."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first


def read_readings(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, sensors: Sequence[str] | None = None) -> DataFrame:
    """Readings stored as Parquet (sensor, t, value); the bounds of [start, end) and the sensors reach the scan."""
    r = spark.read.parquet(path)
    if start is not None:
        r = r.filter(F.col("t") >= start)
    if end is not None:
        r = r.filter(F.col("t") < end)
    return r if sensors is None else r.filter(F.col("sensor").isin(list(sensors)))


def read_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Readings of files '<sensor>.csv' with lines 'yyyy-MM-dd HH:mm:ss,value'; lines that don't fit are left out."""
    raw = spark.read.schema(SENSOR_CSV).option("mode", "DROPMALFORMED").csv(path)
    rows = raw.select(_name_of_file(r"\.csv").alias("sensor"), scalar.parse_time("ts").alias("t"), "value")
    return rows.filter("t is not null and value is not null and not isnan(value)")


def read_query_text(spark: SparkSession, path: str) -> DataFrame:
    """Readings of lines 'metric epoch_seconds value ...'; the mean of values of one metric and time."""
    p = F.split("value", r"\s+")
    raw = spark.read.text(path).select(F.get(p, F.lit(0)).alias("sensor"), (F.get(p, F.lit(1)).try_cast("long") * SECOND).alias("t"), F.get(p, F.lit(2)).try_cast("double").alias("value"))
    return raw.filter("t is not null and value is not null").groupBy("sensor", "t").agg(F.avg("value").alias("value"))


def read_readings_json(spark: SparkSession, path: str) -> DataFrame:
    """Readings of JSON texts '[{"uuid": ..., "Readings": [[ms, value], ...]}]', one a line."""
    each = spark.read.text(path).select(F.explode(scalar.readings_from_json("value")).alias("r"))
    return each.select(F.col("r.uuid").alias("sensor"), "r.t", "r.value").filter("not isnan(value)")


def read_sequence_file(spark: SparkSession, path: str, sensor: str) -> DataFrame:
    """Readings of a legacy key-value file (epoch seconds to value), for taking old files over. The format has no DataFrame reader,
    so rows pass through Python one by one; keep what is read as Parquet (`write_readings`)."""
    pairs = spark.sparkContext.sequenceFile(path).map(lambda kv: (int(kv[0]), float(kv[1])))
    return spark.createDataFrame(pairs, "s long, value double").select(F.lit(sensor).alias("sensor"), (F.col("s") * SECOND).alias("t"), "value")


def write_sequence_file(r: DataFrame, path: str) -> None:
    """Epoch seconds and value of readings as a key-value file, for tools that read nothing else."""
    r.select(F.expr("cast(t div 1000000 as bigint)"), "value").rdd.map(lambda x: (x[0], x[1])).saveAsSequenceFile(path)


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    """Weather rows with all columns as text but t, microseconds of DateUTC (UTC); 'N/A' is null; rows without time go."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.select(*[F.when(F.trim(F.col(f"`{c}`")) != "N/A", F.trim(F.col(f"`{c}`"))).alias(c.strip().replace("/", "-")) for c in raw.columns])
    return named.withColumn("t", scalar.parse_time(WEATHER_TIME)).filter("t is not null")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata fields of JSON files, each one object or a list of them; rows without a usable uuid are left out."""
    text = spark.read.option("wholetext", True).text(path)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    m = text.select(F.explode(listed).alias("value")).select(*[c.alias(k) for k, c in scalar.metadata("value").items()])
    return m.filter("uuid not in ('', '-', '\n')")


def find_files(spark: SparkSession, folder: str, words: Sequence[str]) -> DataFrame:
    """(path): files below a folder whose path has all the words, upper case or not; listed by Spark, contents not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").distinct()
    for w in words:
        listed = listed.filter(F.upper("path").contains(w.upper()))
    return listed


def read_descriptions(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(id, description array): lines 'id word word ...' that match."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(F.get(p, F.lit(0)).alias("id"), F.slice(p, 2, 1_000_000).alias("description"))


def write_readings(r: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Readings as Parquet by day, sorted by sensor and time within files, so that later filters skip row groups."""
    day = F.floor(F.col("t") / F.lit(86400 * SECOND))
    r.withColumn("day", day).repartition("day", F.pmod(F.xxhash64("sensor"), F.lit(16))).sortWithinPartitions("sensor", "t").write.mode(mode).partitionBy("day").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Any table as CSV; nested columns become JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("header", header).csv(path)


def sensor_json(features: DataFrame) -> DataFrame:
    """(sensor, json): each sensor's slots and values as one JSON text; for slot features, a bounded number of rows a sensor."""
    rows = features.groupBy("sensor").agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("x"))
    return rows.select("sensor", F.to_json(F.struct(F.col("x.slot").alias("slot"), F.col("x.value").alias("value"))).alias("json"))


def summary_json(ranked: DataFrame, edges: DataFrame, networks: tuple[str, ...] = ("sensor", "weather", "time", "all")) -> DataFrame:
    """(effect, sig_tag, network, json): each effect's ranked causes with the edges of one of its networks as one JSON text, none
    where nothing was learnt. ranked and edges as `plans.analysis.analyse` gives them; a model_id is effect|tag|network."""
    of = ["effect", "sig_tag"]
    causes = ranked.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("rank", "cause", "opt_state", "opt_prob"))).alias("causes"))
    part = lambda k: F.regexp_extract("model_id", r"^(.*)\|([^|]*)\|([^|]*)$", k)
    nets = edges.groupBy(part(1).alias("effect"), part(2).alias("sig_tag"), part(3).alias("network")).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    every = causes.withColumn("network", F.explode(F.array(*map(F.lit, networks))))
    both = every.join(nets, [*of, "network"], "left")
    return both.select(*of, "network", F.to_json(F.struct("causes", F.coalesce("edges", F.array().cast("array<struct<src:string,dst:string>>")).alias("edges"))).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


__all__ = [n for n in dir() if n.startswith(("read_", "write_", "find_"))] + ["micros", "readings", "sensor_json", "summary_json"]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the first field of every line of a CSV text, without blanks around it; empty ones are left out."""
    first = F.trim(F.split_part("value", F.lit(","), F.lit(1)))
    return spark.read.text(path).select(first.alias("id")).filter("id <> ''")
