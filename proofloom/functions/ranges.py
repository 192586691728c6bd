"""Ranges of dates or numbers: half open, from lo up to but without hi; a null end is open, and a range without a member is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_empty(lo: Column, hi: Column) -> Column:
    return F.coalesce(lo >= hi, F.lit(False))


def contains(lo: Column, hi: Column, at: Column) -> Column:
    """Whether a member lies in the range; null members lie in none."""
    return F.coalesce(at.isNotNull() & F.coalesce(at >= lo, F.lit(True)) & F.coalesce(at < hi, F.lit(True)), F.lit(False))


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two ranges share a member; empty ones share none."""
    return ~is_empty(a_lo, a_hi) & ~is_empty(b_lo, b_hi) & F.coalesce(a_lo < b_hi, F.lit(True)) & F.coalesce(b_lo < a_hi, F.lit(True))


def shared(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> tuple[Column, Column]:
    """The range of the members that two ranges share: the later beginning and the earlier end, of which an open one gives way."""
    return F.greatest(a_lo, b_lo), F.least(a_hi, b_hi)


def islands(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """keys, lo, hi, parts: the ranges of each key melted into those that neither overlap nor touch; empty ones are left out.

    One sort by key and beginning: an island begins where a range begins after all before it have ended.
    """
    filled = rows.where(~is_empty(F.col(lo), F.col(hi))).select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    by = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("lo"), F.asc_nulls_last("hi"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # an open end before keeps every later range in its island
    ended = filled.withColumn("upto", F.max("hi").over(before)).withColumn("endless", F.coalesce(F.bool_or(F.col("hi").isNull()).over(before), F.lit(False)))
    begins = ~F.col("endless") & (F.col("upto").isNull() | F.coalesce(F.col("lo") > F.col("upto"), F.lit(False)))
    numbered = ended.withColumn("island", F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "island").agg(F.min_by("lo", F.struct(F.col("lo").isNotNull(), "lo")).alias("lo"), F.max("hi").alias("last"), F.bool_or(F.col("hi").isNull()).alias("open"), F.count("*").alias("parts"))
    return out.select(*keys, "lo", F.when(~F.col("open"), F.col("last")).alias("hi"), "parts")
