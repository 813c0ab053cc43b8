"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a narrow id table (16 bytes a row) that a join may broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

_own_dirs: dict[str, str] = {}
#: Where the tables that materialize wrote lie, by a table's DataFrame.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset and all run in one process, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own_dirs[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the shared folder is then cleaned by its owner
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The table is deleted by discard, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing will read again, and the shuffle files of finished jobs.

    Spark keeps shuffle files until the driver collects the plans that made them, by itself only every half hour.
    """
    for table in tables:
        spark = table.sparkSession
        _delete(spark, _paths.pop(table))
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that is free back to the system, as a worker lives on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in copied slices, so that few texts at a time become Python strings, and a batch is free before the next comes."""
    while (batch := next(batches, None)) is not None:
        for lo in range(0, batch.num_rows, rows):
            part = batch.take(pa.array(np.arange(lo, min(lo + rows, batch.num_rows))))
            if lo + rows >= batch.num_rows:
                batch = pa.record_batch([], names=[])
            yield part
            if not batch.num_rows:
                break
    trim()


def join_small(left: DataFrame, ids: DataFrame, on: str | list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join left with a materialized narrow table; the table is broadcast only if its counted rows are within limit."""
    small = ids.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(ids) if small else ids, on, how)


def one_row_per_id(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """df(id, value) with one row per id, that with the smallest value; only rows that repeat an id are shuffled."""
    repeated = materialize(df.groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    if not repeated.limit(1).count():
        return df
    once = join_small(df, repeated, id_col, "left_anti")
    return once.union(join_small(df, repeated, id_col, "left_semi").groupBy(id_col).agg(F.min(value_col).alias(value_col)))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def computed_once(df: DataFrame, condition: Column) -> DataFrame:
    """df where condition holds, with the columns that df computes evaluated before the filter and only once.

    Else the optimizer pushes the filter below them with a copy of their expressions, which a lambda function then
    evaluates for each element.
    """
    barrier = "__barrier"
    return df.withColumn(barrier, F.monotonically_increasing_id()).where(condition & (F.col(barrier) >= 0)).drop(barrier)
