"""Session helpers shared by the operators: tables, shared-folder cuts, Arrow text access."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch for operators that read whole texts; long texts make batches heavy.
TEXT_ROWS = 1000
#: Texts are handled in chunks of about so many bytes inside a task, so that work arrays stay small.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Holds the session's rows per Arrow batch at `rows` (None: as it is) while a plan runs, then puts back what was there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if rows is not None:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(name, before)
        elif rows is not None:
            spark.conf.unset(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests); elsewhere an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proofloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and survives lost executors.

    rows: rows per Arrow batch while it is written; None leaves the session's number.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/proofloom/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote, once nothing reads them any more."""
    for table in tables:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans whose results are written: Spark removes them when the driver collects its garbage, which a driver with little to do puts off while executors' disks fill.

    What a plan leaves is garbage to the end only some time after it ended, so the driver collects twice.
    """
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving what a task has freed back to the machine when it ends: workers live on and wait beside those of the next stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc alone has it
                trim(0)

    return wrapped


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Select only the named input columns under fixed names, so other columns cannot clash."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(k) for k, (c, t) in wanted.items()))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about `most` bytes; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
