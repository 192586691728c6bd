"""Every registered query of the evidence engine against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from proofloom.plans import registry
from proofloom.plans.register import Register

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or x is pd.NaT or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x.item() if hasattr(x, "item") else x
    # pandas makes whole numbers beside nulls floats
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted((tuple(whole(clean(x)) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def register(spark):
    """One for all queries, so that lineages and grades are made once."""
    return Register(spark, SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(register, duck, name):
    got = registry.FUNCTIONS[name](register).toPandas()
    if name not in registry.ORACLE:
        assert len(got)
        return
    want = duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


def test_surrogates_are_uuid5(spark):
    import uuid

    for r in registry.QUERIES["surrogate_keys"](spark, SF).limit(20).collect():
        assert r.surrogate == str(uuid.uuid5(uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), f"entity:{r.entity_id}"))
