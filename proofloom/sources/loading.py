"""Loading helpers: surrogate keys, idempotent loads, upserts, rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uuid5(namespace: Column, name: Column) -> Column:
    """The name-based UUID (version 5) of a namespace UUID and a name, by built-in functions."""
    raw = F.concat(F.unhex(F.regexp_replace(namespace, "-", "")), F.encode(name, "UTF-8"))
    h = F.sha1(raw)
    # the variant's two top bits are 10: the digit keeps its two low bits
    low = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), low + 1)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows of the same key replaced by those of changes; keys of changes must be unique."""
    rows = base.withColumn("__version", F.lit(0)).unionByName(changes.withColumn("__version", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("__version"))
    return rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "__version")


def insert_new(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base with those rows whose key it lacks; repeated keys of rows count once."""
    return base.unionByName(rows.dropDuplicates(keys).join(base, keys, "left_anti").select(*base.columns))


def split_rejects(rows: DataFrame, accepted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is accepted, the others)."""
    return rows.join(accepted, key, "left_semi"), rows.join(accepted, key, "left_anti")


def align(a: Column, b: Column) -> Column:
    """Two parallel arrays as one of pairs; null where their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a, b))


def fetch_outcome(status: Column, content_type: Column, expected: Column) -> Column:
    """VERIFIED, UNRESOLVED, DEAD or NEGATIVE by HTTP status and type."""
    return F.when(status.isNull(), "UNRESOLVED").when(status.between(200, 299) & content_type.startswith(expected), "VERIFIED").when(status.isin(404, 410), "DEAD").when(status.isin(401, 403), "UNRESOLVED").otherwise("NEGATIVE")


def host_rule(url: Column, rules: dict[str, str]) -> Column:
    """The value of the first suffix rule that the URL's host ends with; null if none does."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    hits = (F.when((host == k) | host.endswith("." + k), F.lit(v)) for k, v in rules.items())
    return reduce(lambda a, b: F.coalesce(a, b), hits)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def register_sql(spark, frames: dict[str, DataFrame]) -> None:
    """Temporary views register_<name> and functions norm_token, grade_rank and grade_min for users of SQL; they end with the session."""
    from ..functions import vocab

    for name, frame in frames.items():
        frame.createOrReplaceTempView(f"register_{name}")
    ranks = " ".join(f"when '{g}' then {n}" for g, n in vocab.RANKED.items())
    grades = " ".join(f"when {n} then '{g}'" for g, n in vocab.RANKED.items())
    functions = {
        "norm_token(t string) returns string return": f"nullif(trim(regexp_replace(lower(translate(t, '{vocab.FOLD_FROM}', '{vocab.FOLD_TO}')), '[^a-z0-9]+', ' ')), '')",
        "grade_rank(g string) returns int return": f"case g {ranks} end",
        "grade_min(a string, b string) returns string return": f"case when a is null then b when b is null then a when grade_rank(a) is null then a when grade_rank(b) is null then b else case least(grade_rank(a), grade_rank(b)) {grades} end end",
    }
    for head, body in functions.items():
        spark.sql(f"create or replace temporary function {head} {body}")
