"""Output stores of distillates: readings in slices of time, replaced slice by slice, run by run.

A folder holds data/run=N/slice=K (readings), manifest/run=N (the slices that the run wrote) and control/run=N, which is written
last: a run without it doesn't count, and its repetition overwrites what it left. Of each slice the last run that wrote it counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

#: Log2 of nanoseconds of a slice (about 13 days).
POWER = 50
ROWS = "uuid string, time_ns long, value double"
MANIFEST = "slice long, anew boolean, run long"
CONTROL = "name string, algorithm long, params string, input_versions map<string,long>, run long"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last_run(spark: SparkSession, folder: str):
    """The control row of the last run that was finished, or None."""
    return table(spark, f"{folder}/control", CONTROL).orderBy(F.desc("run")).first()


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    """(slice, run): the run that holds each slice's readings."""
    row = last_run(spark, folder)
    written = table(spark, f"{folder}/manifest", MANIFEST).filter(F.col("run") <= (row["run"] if row else -1))
    anew = written.filter("anew").agg(F.coalesce(F.max("run"), F.lit(-1)).alias("since"))
    return written.join(F.broadcast(anew)).filter("run >= since and slice is not null").groupBy("slice").agg(F.max("run").alias("run"))  # one number


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(uuid, time_ns, value) as the last finished run left it; only slices that count are read."""
    return table(spark, f"{folder}/data", f"{ROWS}, run long, slice long").join(_slices(spark, folder), ["run", "slice"], "left_semi").select("uuid", "time_ns", "value")


def slices_of(ranges: DataFrame) -> DataFrame:
    """(slice): the slices that ranges (start_ns, end_ns) touch."""
    first, last = F.shiftright("start_ns", POWER), F.shiftright(F.col("end_ns") - 1, POWER)
    return ranges.filter("end_ns > start_ns").select(F.explode(F.sequence(first, last)).alias("slice")).distinct()


def replace(spark: SparkSession, folder: str, ranges: DataFrame, fresh: DataFrame, control: dict, anew: bool, keep: int = 1) -> int:
    """Puts `fresh` (uuid, time_ns, value) in place of everything in `ranges` (uuid, start_ns, end_ns; a null uuid: of every stream)
    and gives the number of the run.

    Only slices that ranges touch are read and written. anew: everything else goes. Runs more than `keep` before this one lose their
    slices that later ones replaced, after the control row is there.
    """
    row = last_run(spark, folder)
    run = row["run"] + 1 if row else 0
    touched = slices_of(ranges)
    old = latest(spark, folder).withColumn("slice", F.shiftright("time_ns", POWER)).join(touched, "slice", "left_semi")
    if anew:
        old = old.limit(0)
    gone = versions.rows_in_ranges(old, ranges.filter("uuid is not null")).select("uuid", "time_ns")
    every = ranges.filter("uuid is null").select(F.lit("").alias("uuid"), "start_ns", "end_ns")
    gone = gone.union(versions.rows_in_ranges(old.select(F.lit("").alias("uuid"), "time_ns", F.col("uuid").alias("u")), every).select("u", "time_ns"))
    rest = old.join(gone.distinct(), ["uuid", "time_ns"], "left_anti").select("uuid", "time_ns", "value")
    rows = rest.unionByName(fresh.select("uuid", "time_ns", "value")).withColumn("slice", F.shiftright("time_ns", POWER))
    rows.repartition("slice", F.pmod(F.xxhash64("uuid"), F.lit(8))).sortWithinPartitions("uuid", "time_ns").write.mode("overwrite").partitionBy("slice").parquet(f"{folder}/data/run={run}")
    listed = touched.select("slice", F.lit(anew).alias("anew"))
    if anew:  # also where nothing is left
        listed = listed.union(spark.createDataFrame([(None, True)], "slice long, anew boolean"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/run={run}")
    spark.createDataFrame([control], CONTROL.removesuffix(", run long")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/control/run={run}")
    drop_replaced(spark, folder, run - keep - 1)
    return run


def drop_replaced(spark: SparkSession, folder: str, before: int) -> None:
    """Deletes the slices of runs up to `before` that no longer count."""
    written = table(spark, f"{folder}/manifest", MANIFEST).filter((F.col("run") <= before) & F.col("slice").isNotNull()).select("run", "slice")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in written.join(_slices(spark, folder), ["run", "slice"], "left_anti").collect():  # a row a slice of the last runs
        p = path(f"{folder}/data/run={r['run']}/slice={r['slice']}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
