"""Shared plumbing of the training-data operators: inputs, staged tables, batches."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    A temporary folder stands in only in local mode with the setting unset (tests).
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_cadence_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="cadence-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._cadence_dir = found = f"file://{own}"
    return found.rstrip("/")


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def carried(docs: DataFrame, *own: str) -> DataFrame:
    """The columns `own`, and all others in one struct, out of the way of an operator's names."""
    rest = [_named(c).alias(c) for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(rest or [F.lit(0).alias("none")])).alias("carried"))


def restored(df: DataFrame, columns: list[str], *own: str, results: list[str] = ()) -> DataFrame:
    """The `columns` that `carried` packed, then the results; a column named like one gives way."""
    back = [_named(c) if c in own else F.col("carried").getField(c).alias(c) for c in columns if c not in results]
    return df.select(*back, *results)


def kept_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which `release` deletes."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    spark._cadence_staged = [*getattr(spark, "_cadence_staged", []), path]
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = kept_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables and files that this session keeps in the shared folder; for when all results have been read."""
    for path in getattr(spark, "_cadence_staged", []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    spark._cadence_staged = []


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of `df`; only sizes partitions, never changes results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, mb: float) -> int:
    """Partitions of about `mb` MB of (compressed) input each, at least the session's number."""
    est = size_in_bytes(df)
    if est > 1 << 50:  # unknown statistics
        est = 0
    return max(shuffle_partitions(df.sparkSession), math.ceil(est / (mb * 1e6)))


def _give_back() -> None:
    """Hand freed memory to the system: idle Python workers stay for a minute and keep theirs else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f: Callable) -> Callable:
    """`f` for mapInArrow or a grouped applyInArrow, which gives freed memory back at its end."""
    if inspect.isgeneratorfunction(f):

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(batches)
            _give_back()

        return stream

    if len(inspect.signature(f).parameters) == 1:

        def one(rows: pa.Table) -> pa.Table:
            out = f(rows)
            _give_back()
            return out

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        _give_back()
        return out

    return two


def slices(batch: pa.RecordBatch, column: str, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about `limit` bytes of `column`, one row at least."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
    cum = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        base = cum[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(cum, base + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def sha(column: str):
    return F.sha2(F.col(column), 256)
