"""Every registered query of the evidence engine, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The same as functions of a Register, for callers who run several over one.
FUNCTIONS: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, upto: str = "fixture"):
    """Registers a function of a Register under its name; sql is the oracle's own part (see oracle.sql)."""
    from .oracle import sql as whole
    from .register import Register

    def add(f: Callable[[Register], DataFrame]):
        FUNCTIONS[f.__name__] = f
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Register(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = whole(sql, upto)
        return f

    return add


from . import checks, derived, grading, history, loads, matching, published, spans_of_time, states, telemetry, texts, wider  # noqa: E402, F401
