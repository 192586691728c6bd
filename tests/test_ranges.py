"""Ranges against sets of whole numbers."""

import random

from pyspark.sql import functions as F

from proofloom.functions import ranges

OPEN = 40


def members(lo, hi):
    return set(range(0 if lo is None else lo, OPEN if hi is None else hi))


def test_relations_are_those_of_the_sets(spark):
    rng = random.Random(1)
    end = lambda: rng.choice([None, *range(1, 30)])
    rows = [(end(), end(), end(), end(), rng.choice([None, *range(31)])) for _ in range(400)]
    c = F.col
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, x long")
    lo, hi = ranges.shared(c("a"), c("b"), c("c"), c("d"))
    got = df.select("*", ranges.is_empty(c("a"), c("b")), ranges.contains(c("a"), c("b"), c("x")), ranges.overlaps(c("a"), c("b"), c("c"), c("d")), lo, hi).collect()
    for a, b, p, q, x, empty, inside, over, lo, hi in got:
        one, two = members(a, b), members(p, q)
        assert empty == (not one) and inside == (x in one) and over == bool(one & two)
        if over:
            assert members(lo, hi) == one & two


def test_islands(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(25), lo := rng.choice([None, *range(1, 30)]), rng.choice([None, *([1, 2, 5] if lo is None else [lo - 1, lo, lo + 1, lo + 4])] if rng.random() < 0.2 else [(lo or 1) + rng.randrange(4)])) for _ in range(160)]
    got = ranges.islands(spark.createDataFrame(rows, "k long, lo long, hi long"), ["k"]).collect()
    for k in range(25):
        mine = [members(lo, hi) for key, lo, hi in rows if key == k and members(lo, hi)]
        found = [members(r.lo, r.hi) for r in got if r.k == k]
        assert set().union(*mine) == set().union(*found) and sum(r.parts for r in got if r.k == k) == len(mine)
        every = sorted(min(f) for f in found)
        assert all(not (f & g) and max(f) + 1 != min(g) for f in found for g in found if f is not g) and len(every) == len(found)
