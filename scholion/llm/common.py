"""What the operators share: scratch tables, row keys and Arrow helpers."""

from __future__ import annotations

import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Freed buffers go back to the system: a worker that waits for its next task keeps none.
pa.set_memory_pool(pa.system_memory_pool())

CHECKPOINT_CONF = "spark.checkpoint.dir"


@functools.cache
def _private(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="scholion-")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one that the cluster names.

    Where none is named, a machine's own folder does only if all of Spark runs on
    that machine.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        root = _private(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/scholion-{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession) -> None:
    """For queries and stages, not operators: batches for Python of 8 MB at most, where the session has Spark's own 64 MB, as several copies of one are alive at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "8m")


#: Scratch tables that each open call of ``settled`` in this thread has written.
_making = threading.local()


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """``materialize`` of what ``make`` gives; the scratch tables written on the way there are deleted."""
    open_ = _making.__dict__.setdefault("paths", [])
    depth = len(open_)
    open_.append([])
    try:
        df, passed = make(), open_[depth]
    finally:
        del open_[depth:]
    out = materialize(df, tag)
    for path in passed:
        _delete(df.sparkSession, path)
    return out


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there, so a lost executor costs the tasks it ran and not
    the stages before, and what is read twice is computed once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if open_ := getattr(_making, "paths", None):
        open_[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, which operators leave for their results to read; none of these may be read after it."""
    _delete(spark, scratch_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str) -> Column:
    """A text column as its UTF-8 bytes: Python then never decodes it."""
    return F.col(column).cast("string").cast("binary")


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` by a function of one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def once(column: Column) -> Column:
    """Computed once a row: what isn't deterministic is never copied into the lambdas that read it."""
    return F.when(F.spark_partition_id() >= 0, column)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array and its n + 1 offsets; nulls are empty."""
    texts = texts.fill_null(b"") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values)
    pad = -n % width
    block = np.append(values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])
