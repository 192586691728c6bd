"""Lineage cuts for loops of joins: tables written in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written under spark.checkpoint.dir and read back; rows: rows per Arrow batch meanwhile, where they are heavy. Where that is unset, a temporary folder serves local mode (tests); elsewhere it is an error."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="proofloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/proofloom/{name}-{uuid.uuid4().hex}"
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        if rows is not None:
            spark.conf.set(batch, str(rows))
        df.write.parquet(path)
    finally:
        if rows is not None:
            spark.conf.set(batch, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the bitmap that keeps most rows without a wanted key from moving, in words of 64; when it fills up more rows move, and results stay.
MARKS_LOG2 = 26


def _mark(key: str) -> tuple[Column, Column]:
    """A key's word and its bit there."""
    at = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << MARKS_LOG2))
    return F.shiftright(at, 6), (at % 64).cast("int")


def marks(keys: DataFrame) -> DataFrame:
    """(word, bits) of the bitmap that every key of the one-column frame hits: at most 2**20 rows, however many keys there are."""
    word, bit = _mark(keys.columns[0])
    hits = keys.select(word.alias("word"), bit.alias("bit")).selectExpr("word", "shiftleft(1L, bit) as bit")
    return cut(hits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")


def having(df: DataFrame, keys: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of df whose key is one of keys (a column of whole numbers): most others fall to the keys' bitmap, a table of bounded size, before the exact join moves rows."""
    word, bit = _mark(keys.columns[0])
    return df.join(F.broadcast(marked), (word == F.col("word")) & (F.getbit("bits", bit) == 1), "left_semi").join(keys, keys.columns[0], "left_semi")
