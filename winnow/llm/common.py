"""What the operators of this subpackage share: the folder all executors see, and tables kept in it."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.shared import shared_root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: its lineage ends there. A slim table, of a few bytes a
    row and much fewer rows than those that it comes from, is an eighth of the files."""
    path = shared_path(df.sparkSession, name)
    if slim:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete the table that materialize wrote. Nothing may need its rows any more."""
    jvm, files = written.sparkSession.sparkContext._jvm, written.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text"):
    """The column's text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def tidy(each):
    """each, a function over Arrow batches; at a task's end what it freed goes back to the system, as a worker
    that waits for its next task would keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


def modest_batches(df: DataFrame, size: str = "16m") -> DataFrame:
    """df, its session handing Python batches of 16 MB instead of Spark's 64: a batch is held several times over, in
    each of an executor's tasks. A size that the session was given stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).lower() in ("67108864b", "64mb", "64m"):
        conf.set(key, size)
    return df


def held_out(id_col: Column) -> Column:
    """Whether a row is in the fold kept from learning: crc32 of its id as text leaves 2 by 4. Null ids are not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of one slice hold about limit bytes (one text at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(at, end - at)
        done, at = int(sizes[end - 1]), end
