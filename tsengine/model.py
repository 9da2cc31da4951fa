"""The data model: readings in long form, times as integers.

readings: sensor string, t long (microseconds since 1970 in UTC), value double. A missing value is null, never NaN or infinity.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND
#: Types of a sensor's values, inferred from their number.
INT_TYPE, FLOAT_TYPE = 0, 1

READINGS = T.StructType([T.StructField("sensor", T.StringType()), T.StructField("t", T.LongType()), T.StructField("value", T.DoubleType())])


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone (without: read as UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def readings(df: DataFrame, sensor: str | Column, ts: str | Column, value: str | Column) -> DataFrame:
    """Any table as readings. NaN and null values and null times are left out, as everything downstream expects."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select(as_col(sensor).cast("string").alias("sensor"), micros(ts).alias("t"), as_col(value).cast("double").alias("value"))
    return out.filter("t is not null and value is not null and not isnan(value)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, its lineage cut: plans after it stay small and lost executors cost nothing before it.

    Spark deletes the files when the table is no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where a session names none, one on a single machine gets
    a local folder; on a cluster that is an error."""
    context = spark.sparkContext
    used = context._jsc.sc().getCheckpointDir()
    if not used.isEmpty():
        return used.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tsengine-")
    context.setCheckpointDir(folder)
    return folder
