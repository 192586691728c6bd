"""What moves of a row, and how large the methods are that grade it: the JVM leaves methods above 8,000 bytes untranslated."""

import re

import pytest

from proofloom.operators import evidence, score
from proofloom.plans.register import Register

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def register(spark):
    return Register(spark, SF)


def _largest(df) -> int:
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.fixture
def plain(spark):
    """Plans as they are for large tables: no broadcasts, and code shown before a run."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_go_to_their_documents_narrow(register, plain):
    counts = evidence.all_counts(register.table("raw_observation"), register.table("document"), register.table("proposition"), register.roots, register.table("witness"))
    text = counts.sparkSession._jvm.PythonSQLUtils.explainString(counts._jdf.queryExecution(), "formatted")
    moved = [x for x in re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(at#", text) if "proposition_id" in x]
    assert len(moved) == 1 and len(moved[0].split(", ")) <= 8
    assert _largest(counts) <= 8000


def test_grades_are_translated(register, plain):
    assert _largest(score.evaluate(register.wide).select("proposition_id", "grade")) <= 8000
    assert _largest(register.graded.select("proposition_id", "grade")) <= 8000
