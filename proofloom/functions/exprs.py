"""Column functions: normalisation, grades, membership. Built-in expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def norm_token(text: Column) -> Column:
    """Accents folded, lower case, other characters to single spaces, trimmed; empty to null."""
    folded = F.lower(F.translate(text, vocab.FOLD_FROM, vocab.FOLD_TO))
    return F.nullif(F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " ")), F.lit(""))


def choose(key: Column, table: dict, default: Column | None = None) -> Column:
    """A when-chain over a small fixed table."""
    chain = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(key == next(iter(table)), F.lit(next(iter(table.values())))))
    return chain if default is None else chain.otherwise(default)


def grade_rank(grade: Column) -> Column:
    """A 7 ... F 2; R, X and null have no rank."""
    return choose(grade, vocab.RANKED)


def rank_grade(rank: Column) -> Column:
    return choose(rank, {v: k for k, v in vocab.RANKED.items()})


def grade_min(a: Column, b: Column) -> Column:
    """The lower grade; null yields to the other, an unranked grade dominates."""
    return (
        F.when(a.isNull(), b).when(b.isNull(), a).when(grade_rank(a).isNull(), a).when(grade_rank(b).isNull(), b).otherwise(rank_grade(F.least(grade_rank(a), grade_rank(b))))
    )


def _matrix(e: Column, a: Column, k: int) -> Column:
    """Sign (k = 0) or magnitude (1) by expectedness, then alternative: a few comparisons a row and no joined text."""
    rows: dict[str, dict] = {}
    for (x, y), v in vocab.MATRIX.items():
        rows.setdefault(x, {})[y] = v[k]
    return choose(e, {x: choose(a, row) for x, row in rows.items()})


def matrix_sign(e: Column, a: Column) -> Column:
    return _matrix(e, a, 0)


def matrix_magnitude(e: Column, a: Column) -> Column:
    return _matrix(e, a, 1)


def x_magnitude(level: Column) -> Column:
    return choose(level, {"X3": 3, "X2": 2, "X1": 1}, F.lit(0))


def signed_weight(sign: Column, magnitude: Column) -> Column:
    return choose(sign, {"SUPPORTS": 1, "UNDERCUTS": -1}, F.lit(0)) * magnitude


def exclusions() -> list[tuple[Column, str, str]]:
    """(condition, reason, membership) in order; the first that holds decides."""
    c = F.col
    return [
        (c("superseded"), "superseded", "INERT"),
        (c("receipt_state") != "VERIFIED", "receipt not verified", "V0"),
        (c("scope") != "INSTANCE", "scope is not the instance", "INERT"),
        (c("prov_channel") == "ADVERSARY-WRITABLE", "writable channel", "INERT"),
        (~c("prov_causal").isin(vocab.COUNTED_CAUSES), "solicited or self-published", "INERT"),
        (c("prov_era") == "POST-2022-UNATTRIBUTED", "unattributed era", "INERT"),
        (c("self_attesting"), "self-attesting", "INERT"),
        (c("echo"), "echo of the register", "INERT"),
        (c("sign") == "NEUTRAL", "neutral", "INERT"),
    ]


def membership() -> Column:
    """V, U, INERT or V0 of an observation row."""
    first, *rest = exclusions()
    chain = F.when(first[0], first[2])
    for condition, _, member in rest:
        chain = chain.when(condition, member)
    return chain.when(F.col("sign") == "SUPPORTS", "V").otherwise("U")


def exclusion_reason() -> Column:
    first, *rest = exclusions()
    chain = F.when(first[0], first[1])
    for condition, reason, _ in rest:
        chain = chain.when(condition, reason)
    return chain


def key_digest(key: Column) -> Column:
    """An aggregate that tells sets of keys apart without an order: the sum of the first 32 bits of each key's md5."""
    return F.sum(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"))
