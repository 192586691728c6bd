"""Violation reports: every rule of a table in one pass, and audits between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, tab: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(tab, rule, key) for every rule that a row breaks; a rule that comes out null is not broken. One scan whatever the number of rules."""
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return rows.select(F.explode(broken).alias("rule"), key.cast("string").alias("key")).select(F.lit(tab).alias("tab"), "rule", "key")


def repeated(rows: DataFrame, tab: str, rule: str, keys: list[str]) -> DataFrame:
    """(tab, rule, key) of keys that stand in several rows; nulls are equal."""
    several = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return several.select(F.lit(tab).alias("tab"), F.lit(rule).alias("rule"), F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys)).alias("key"))


def log_audit(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, finding) where a log that may only grow lost or changed a row."""
    digest = lambda df, name: df.select(key, F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias(name))
    both = digest(old, "a").join(digest(new, "b"), key, "left")
    return both.where(F.col("b").isNull() | (F.col("a") != F.col("b"))).select(key, F.when(F.col("b").isNull(), "lost").otherwise("changed").alias("finding"))


def grammar(identifiers: DataFrame, patterns: DataFrame) -> DataFrame:
    """identifiers (class, value) that do not match their class's anchored pattern (class, pattern: a registry of few rows)."""
    return identifiers.join(patterns, "class").where(~F.regexp_like("value", F.col("pattern"))).select("class", "value")


def present(rows: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """(expected value, how many rows have it, ok): every value of a vocabulary should occur."""
    found = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    wanted = found.sparkSession.createDataFrame([(v,) for v in expected], "value string")
    return wanted.join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("ok"))
