"""Merges of entities: what is graded for them, against both worlds graded whole and against SQL on tables with gaps."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from proofloom.operators import evidence, regrade, shared
from proofloom.operators.shared import cut
from proofloom.plans import registry
from proofloom.plans.register import Register

SF = "/root/testdata/sf0.001"
IDENTITY = ["class", "function_set", "null_id"]


@pytest.fixture(scope="module")
def register(spark):
    return Register(spark, SF)


@pytest.fixture()
def counted(monkeypatch):
    """Numbers of rows that passes over the evidence are given."""
    rows, real = [], evidence.all_counts
    monkeypatch.setattr(evidence, "all_counts", lambda raw, *more: rows.append(raw.count()) or real(raw, *more))
    return rows


def test_a_merge_reads_rows_of_what_it_pools(register, counted):
    got = registry.FUNCTIONS["merge_guard"](register).collect()
    assert got and 0 < sum(counted) < register.evidence.raw.count() / 2


@pytest.mark.parametrize("identity", [IDENTITY, ["class"]])
def test_grades_of_a_merge_are_those_of_both_worlds(spark, register, counted, identity):
    """Chains, circles and an entity by itself; by class alone most propositions are pooled and all rows are read."""
    e = register.evidence
    pairs = [(1, 2), (2, 5), (5, 10), (10, 1), (20, 20), (34, 31), (50, 49), (49, 52)] + ([(k, k + 1) for k in range(60, 149)] if identity == ["class"] else [])
    merges = spark.createDataFrame(pairs, "a long, b long")
    graded, named = regrade.grade_merged(e, register.roots, merges, identity)
    graded, targets = cut(graded, "graded"), {r.proposition_id: r.target for r in named.collect()}
    some = len(counted)
    world, every = regrade.merged(e, regrade._into(merges), identity)
    moved = {r.proposition_id: r.target for r in every.where("proposition_id <> target").collect()}
    assert {k: t for k, t in targets.items() if k != t} == moved and set(targets) == set(moved) | set(moved.values()) and moved
    for name, w, keys in (("now", e, set(targets)), ("merged", world, set(targets.values()))):
        want = {r.proposition_id: (r.entity_id, r["class"], r.candidate_set_id, r.grade) for r in regrade.grade_own(w, register.roots).collect() if r.proposition_id in keys}
        got = {r.proposition_id: (r.entity_id, r["class"], r.candidate_set_id, r.grade) for r in graded.where(F.col("world") == name).collect() if r.proposition_id in keys}
        assert got == want and len(got) == len(keys)
    whole = register.evidence.raw.count()
    assert some == 1 and (counted[0] < whole / 2) == (identity == IDENTITY)


def test_merges_of_entities_with_gaps(spark, tmp_path):
    """Of the entities of a block any may be missing, and one by itself pools its own propositions."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    here = "c_custkey % 20 not in (2, 3) and not (c_custkey < 60 and c_custkey % 20 = 1) and not (c_custkey > 100 and c_custkey % 20 in (2, 3, 4))"
    for f in os.listdir(SF):
        kept = {"customer.parquet": f"where {here}", "orders.parquet": f"where {here.replace('c_custkey', 'o_custkey')}", "lineitem.parquet": f"where l_orderkey in (select o_orderkey from '{SF}/orders.parquet' where {here.replace('c_custkey', 'o_custkey')})"}.get(f, "")
        # orders made alike, so that there are many to be pooled
        alike = "* replace (o_orderkey * 12 as o_orderkey)" if f == "orders.parquet" else "* replace (l_orderkey * 12 as l_orderkey)" if f == "lineitem.parquet" else "*"
        con.execute(f"copy (select {alike} from '{SF}/{f}' {kept}) to '{tmp_path}/{f}' (format parquet)")
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tmp_path}/{f}'")
    got = registry.FUNCTIONS["merge_guard"](Register(spark, str(tmp_path)))
    want = con.execute(registry.ORACLE["merge_guard"]).df()
    assert len(want) >= 20 and sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, (tuple(x.item() if hasattr(x, "item") else x for x in r) for r in want.itertuples(index=False))))


@pytest.mark.parametrize("log2", [6, 9, 26])
def test_rows_of_keys_whatever_the_bitmap_holds(spark, monkeypatch, log2):
    monkeypatch.setattr(shared, "MARKS_LOG2", log2)
    df = spark.createDataFrame([(k if k % 50 else None, k % 7) for k in range(2000)], "proposition_id int, x int")
    keys = spark.createDataFrame([(k,) for k in range(-30, 3000, 3)] + [(None,)], "proposition_id long")
    got = sorted(r.proposition_id for r in shared.having(df, keys, shared.marks(keys)).collect())
    assert got == [k for k in range(0, 2000, 3) if k % 50]
    assert shared.having(df, keys.where("false"), shared.marks(keys.where("false"))).isEmpty()
