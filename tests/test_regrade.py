"""The drain against a rebuild, clamps of long chains, and origins of large components."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from proofloom.operators import graph, regrade, score
from proofloom.operators.shared import cut
from proofloom.plans.register import Register

SF = "/root/testdata/sf0.001"
CLAMP = "proposition_id long, class string, parent_id long, grade string"


@pytest.fixture(scope="module")
def register(spark):
    return Register(spark, SF)


@pytest.fixture(scope="module")
def graded(register):
    return cut(regrade.grade_all(register.evidence, register.roots), "all")


def rows(df):
    return {tuple(r) for r in df.select(*regrade.ROLLUP).collect()}


def test_grades_of_keys_are_those_of_all(spark, register, graded):
    keys = spark.createDataFrame([(r.proposition_id,) for r in graded.where("proposition_id % 23 = 1").collect()], "proposition_id long")
    got = regrade.grade_keys(register.evidence, register.roots, keys)
    want = graded.join(keys, "proposition_id", "left_semi")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(*regrade.ROLLUP[:-1]).collect()} and want.count() > 20


@pytest.mark.parametrize("change", ["rows come", "rows go", "tiers change", "citations come"])
def test_drain_equals_rebuild(spark, register, graded, change):
    """Whatever changed, the drained rollup has the rows of a rebuild, and only a part of it was graded again."""
    now, e = register.evidence, register.evidence
    if change == "rows come":
        was = replace(e, raw=e.raw.where("proposition_id % 10 <> 3 or asserted_on < date '1996-01-01'"))
        dirty = e.raw.where("proposition_id % 10 = 3 and asserted_on >= date '1996-01-01'")
        parts = {"rows": dirty}
    elif change == "rows go":
        extra = e.raw.where("proposition_id % 40 < 3").withColumn("proposition_id", F.col("proposition_id") + F.lit(0)).withColumn("sign", F.lit("SUPPORTS")).withColumn("observation_id", F.concat("observation_id", F.lit("x")))
        was, parts = replace(e, raw=e.raw.unionByName(extra)), {"rows": extra}
    elif change == "tiers change":
        was = replace(e, documents=e.documents.withColumn("tier", F.when(F.col("document_id") % 20 == 1, "T1").otherwise(F.col("tier"))))
        parts = {"documents": e.documents.where("document_id % 20 = 1 and tier <> 'T1'")}
    else:
        was = replace(e, citations=e.citations.where("citing % 40 > 30"))
        parts = {"roots": (was.roots(), register.roots)}
    before = was.roots() if change == "citations come" else register.roots
    stored = cut(regrade.grade_all(was, before), "stored")
    dirty = regrade.dirty_keys(now, **parts)
    rollup, regraded = regrade.drain(stored, now, register.roots, dirty)
    assert rows(rollup) == rows(graded)
    assert rows(stored) != rows(graded)
    assert dirty.groupBy("proposition_id").count().where("count > 1").isEmpty()
    if change != "citations come":
        assert 0 < regraded.count() < 0.6 * graded.count()


def test_nothing_dirty_leaves_the_rollup(spark, register, graded):
    rollup, regraded = regrade.drain(graded, register.evidence, register.roots, graded.where("false"))
    assert rows(rollup) == rows(graded) and regraded.count() == 0


def plain_clamp(table, unranked_parent):
    rank = {"A": 7, "B": 6, "C": 5, "D": 4, "E": 3, "F": 2}
    out = {}

    def final(k):
        if k not in out:
            kind, parent, grade = table[k]
            out[k] = grade
            if kind not in ("EXIST", "PROGRAM", "ORIGIN") and parent in table:
                up = final(parent)
                if grade in rank and up not in rank:
                    out[k] = up if unranked_parent else grade
                elif grade in rank:
                    out[k] = min(grade, up, key=rank.get)
        return out[k]

    for k in sorted(table):
        final(k)
    return out


@pytest.mark.parametrize("unranked_parent", [False, True])
def test_clamp_equals_level_by_level(spark, unranked_parent):
    rng = random.Random(8)
    table = {k: (rng.choice(["STATUS", "STATUS", "STATUS", "EXIST", "PROGRAM"]), rng.choice([None, 9999, *range(max(0, k - 5), k)]) if k else None, rng.choice("AABBCDEFXR")) for k in range(400)}
    df = spark.createDataFrame([(k, c, p, g) for k, (c, p, g) in table.items()], CLAMP)
    assert {r.proposition_id: r.final for r in score.clamp(df, unranked_parent).collect()} == plain_clamp(table, unranked_parent)


def test_clamp_of_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    rounds, real = [], score.cut
    monkeypatch.setattr(score, "cut", lambda df, name: rounds.append(name) or real(df, name))
    rows = [(k, "STATUS" if k else "EXIST", k - 1 if k else None, "E" if k == 5000 else "B") for k in range(10_000)]
    out = score.clamp(spark.createDataFrame(rows, CLAMP))
    assert out.where("final = 'E'").count() == 5000 and rounds.count("ways") <= 16


def test_origins_of_a_large_component(spark):
    """20,000 nodes in one component, half of them in one circle: one value a part, no table of seeds and nodes."""
    rng = random.Random(2)
    ring = [(i, (i + 1) % 10_000) for i in range(10_000)] + [(rng.randrange(10_000), rng.randrange(10_000)) for _ in range(15_000)]
    tail = [(i, rng.randrange(10_000)) for i in range(10_000, 19_990)] + [(rng.randrange(10_000), i) for i in range(19_990, 20_000)]
    edges = spark.createDataFrame([(a, b, "cites") for a, b in ring + tail if a != b], "citing long, cited long, kind string")
    docs = spark.range(20_001).select(F.col("id").alias("document_id"), F.when(F.col("id") % 3 != 0, F.col("id") * 7 % 1000).alias("dated"), F.lit("document").alias("basis"))
    first, every = graph.origins(edges, docs)
    ends = sorted((k * 7 % 1000, k) for k in range(19_990, 20_000) if k % 3)
    got = first.groupBy(F.col("first.node").alias("node")).count().collect()
    assert sum(r["count"] for r in got if r.node == ends[0][1]) >= 19_990
    assert every.where("document_id = 12345").count() == 10 and every.where("document_id = 20000").collect()[0].node == 20_000


def test_what_lies_ahead_on_small_graphs(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    reach = {n: {n} for n in range(40)}
    for _ in range(40):
        for a, b in pairs:
            reach[a] |= reach[b]
    edges = spark.createDataFrame([(a, b, "cites") for a, b in pairs], "citing long, cited long, kind string")
    docs = spark.range(40).select(F.col("id").alias("document_id"), (F.col("id") * 11 % 17).alias("dated"), F.lit("document").alias("basis"))
    sinks = {n for n in range(40) if all(a != n or a == b for a, b in pairs)}
    first, every = graph.origins(edges, docs)
    assert {(r.document_id, r.node) for r in every.collect()} == {(n, s) for n in range(40) for s in reach[n] & sinks}
    assert {r.document_id: r["first"].node for r in first.collect()} == {n: min((s * 11 % 17, s) for s in reach[n] & sinks)[1] for n in range(40) if reach[n] & sinks}
    near = {r.node: r.steps for r in graph.steps_to(edges, spark.createDataFrame([(s,) for s in (3, 8)], "node long")).collect()}
    steps = {3: 0, 8: 0}
    for _ in range(40):
        for a, b in pairs:
            if b in steps and a != b and steps[b] + 1 < steps.get(a, 99):
                steps[a] = steps[b] + 1
    assert near == steps
