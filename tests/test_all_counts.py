"""Counts of all kinds in one pass against each kind by itself, and how often it moves the rows."""

import re

import pytest
from pyspark.sql import functions as F

from proofloom.operators import evidence
from proofloom.plans.register import Register

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    r = Register(spark, SF)
    raw = r.table("raw_observation").withColumns({
        # rows without document, fact, magnitude or direction; facts that several rows of both directions share
        "document_id": F.when(F.pmod(F.xxhash64("observation_id"), F.lit(7)) > 0, F.col("document_id")), "fact_key": F.when(F.pmod(F.xxhash64("observation_id", F.lit(1)), F.lit(5)) > 0, F.concat(F.lit("f"), (F.xxhash64("observation_id", F.lit(2)) % 2).cast("string"))),
        "raw_magnitude": F.when(F.pmod(F.xxhash64("observation_id", F.lit(3)), F.lit(9)) > 0, F.col("raw_magnitude")), "proposition_id": F.col("proposition_id") % 100,
    })
    return raw, r.table("document"), r.table("proposition"), r.roots, r.table("witness")


def test_one_pass_equals_the_parts(tables):
    raw, documents, propositions, roots, witnesses = tables
    got = evidence.all_counts(*tables)
    obs = evidence.build_observations(raw, documents, propositions)
    parts = [evidence.counts(obs), evidence.lineage_counts(obs, roots), evidence.undercut_flags(obs, roots), evidence.refuting_rows(obs), evidence.direct_witnesses(obs, witnesses)]
    want = parts[0]
    for p in parts[1:]:
        want = want.join(p, "proposition_id", "left")
    flag = lambda df: {tuple(bool(r[k]) if isinstance(r[k], bool) or r[k] is None and t == "boolean" else r[k] or 0 for k, t in sorted(want.dtypes)) for r in df.collect()}
    assert set(got.columns) == set(want.columns) and flag(got) == flag(want) and got.count() > 50


def test_rows_move_to_documents_and_to_propositions_only(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = evidence.all_counts(*tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moves = re.findall(r"Exchange hashpartitioning\((.*?)\)", plan)
    # each of the three tables beside the rows moves once; the rows move to documents, to witnesses and to propositions
    assert sum("proposition_id" in m for m in moves) == 2 and sum("document_id" in m or m.startswith("at#") for m in moves) == 3
