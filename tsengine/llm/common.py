"""Shared pieces: table access, shared-folder paths, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch; with 2,000 texts a batch stays in the tens of MB.
ROWS_PER_BATCH = 2000
#: Bytes in one Arrow batch, for tables with very long texts.
BYTES_PER_BATCH = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the memory of Python workers: smaller Arrow batches than Spark's default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name inside the cluster's shared folder.

    That folder is `spark.checkpoint.dir`. Where the session has none, a session on one machine gets a local folder, which is
    set as the checkpoint folder; on a cluster that is an error, as executors and driver would not see the same files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        used = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not used.isEmpty():
            root = used.get()
        elif spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            root = tempfile.mkdtemp(prefix="tsengine-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tsengine-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing before it.

    The shuffle files of the write go when it has ended (Spark's setting for that is on meanwhile), as the table takes their place.
    options: of the Parquet writer.
    """
    spark = df.sparkSession
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df.write.mode("overwrite").options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that `saved` wrote. No DataFrame may need them any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`df` without the columns that an operator is about to add (names compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def release() -> None:
    """Gives memory that a task has freed back to the system: workers stay for the tasks that follow, of other stages too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def append_columns(
    df: DataFrame,
    make: Callable[[pa.RecordBatch], list],
    fields: list[T.StructField],
    keep: Sequence[str] | None = None,
    parts: Callable[[pa.RecordBatch], list] | None = None,
    end: Callable[[], None] | None = None,
) -> DataFrame:
    """Adds columns computed per Arrow batch, without a shuffle.

    make: gets a batch of `df`, returns one Arrow array for each of `fields`. keep: input columns to return (default: all).
    parts: cuts a batch into smaller ones, each of which is made and returned before the next. end: what a task does when it is
    done, such as emptying what it has remembered.
    An input column named like one of `fields` is replaced by it.
    """
    tune(df.sparkSession)
    new = [f.name for f in fields]
    taken = {n.lower() for n in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches):
        for whole in batches:
            for rb in (parts(whole) if parts else [whole]) if whole.num_rows else []:
                cols = make(rb)
                yield pa.RecordBatch.from_arrays([rb.column(rb.schema.get_field_index(c)) for c in kept] + list(cols), names=kept + new)
                del rb, cols
        if end:
            end()
        release()

    return df.mapInArrow(run, schema)


def strings(rb: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return pc.fill_null(rb.column(rb.schema.get_field_index(name)), "").to_pylist()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the offsets of its rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def text_chunks(rb: pa.RecordBatch, name: str, most: int = 2 << 20):
    """(first row, row after the last, UTF-8 bytes, offsets) for runs of rows with about `most` bytes of text together, so that
    arrays with a word for each byte stay small."""
    data, at = utf8(rb.column(rb.schema.get_field_index(name)))
    row = 0
    while row < rb.num_rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def bloom(keys: DataFrame, column: str, bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of fixed size over a column of well-mixed 64-bit hashes, as 64-bit words for `in_bloom`.

    Its size doesn't grow with the data (2^26 bits: 8 MB); with more keys it only lets more through.
    """
    h = F.col(column)
    at = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("i")
    words = keys.select(at).groupBy(F.shiftright("i", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def in_bloom(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be among the keys."""
    mask = np.uint64(len(words) * 64 - 1)
    found = np.ones(len(h), bool)
    for i in (h & mask, (h >> np.uint64(32)) & mask):
        found &= (words[i >> np.uint64(6)] >> (i & np.uint64(63)) & np.uint64(1)) > 0
    return found


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))
