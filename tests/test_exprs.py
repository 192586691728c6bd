import pytest
from pyspark.sql import functions as F

from proofloom.functions import exprs, vocab


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("Ünïted  Kingdom!", "united kingdom"), ("--", None), ("", None), (None, None), ("a_b", "a b"), ("ß", None)])
def test_norm_token(spark, text, want):
    assert one(spark, exprs.norm_token(F.lit(text).cast("string"))) == want


def test_folds_are_one_to_one(spark):
    assert len(vocab.FOLD_FROM) == len(vocab.FOLD_TO) == 53


@pytest.mark.parametrize("a, b, want", [("A", "C", "C"), ("R", "A", "R"), ("A", "X", "X"), (None, "B", "B"), ("B", None, "B"), ("F", "E", "F")])
def test_grade_min(spark, a, b, want):
    assert one(spark, exprs.grade_min(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


def test_matrix_has_sixteen_cells_and_no_four(spark):
    rows = spark.createDataFrame([(e, a) for e, a in vocab.MATRIX], "e string, a string").select("e", "a", exprs.matrix_sign(F.col("e"), F.col("a")).alias("s"), exprs.matrix_magnitude(F.col("e"), F.col("a")).alias("m")).collect()
    assert len(rows) == 16 and max(r.m for r in rows) == 3
    assert {(r.e, r.a): (r.s, r.m) for r in rows} == vocab.MATRIX


def test_membership_takes_the_first_exclusion(spark):
    base = dict(superseded=False, receipt_state="VERIFIED", scope="INSTANCE", prov_channel="ORIGIN-HOST", prov_causal="UNSOLICITED", prov_era="PRE-2022", self_attesting=False, echo=False, sign="SUPPORTS")
    cases = [({}, "V"), ({"sign": "UNDERCUTS"}, "U"), ({"sign": "NEUTRAL"}, "INERT"), ({"superseded": True, "receipt_state": "DEAD"}, "INERT"), ({"receipt_state": "DEAD", "scope": "CLASS"}, "V0"), ({"echo": True}, "INERT"), ({"prov_causal": "CROWD-EDITED"}, "INERT")]
    rows = spark.createDataFrame([tuple({**base, **c}.values()) + (i,) for i, (c, _) in enumerate(cases)], [*base, "i"]).select("i", exprs.membership().alias("m")).collect()
    assert {r.i: r.m for r in rows} == {i: m for i, (_, m) in enumerate(cases)}
