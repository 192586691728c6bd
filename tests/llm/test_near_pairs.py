"""Long lines that share a run of words but are not similar never become pairs that are compared, and those that are similar stay linked."""

import random

from proofloom.llm import common, lines


def _texts():
    rng = random.Random(5)
    shared = "considerations notwithstanding aforementioned responsibilities"
    words = lambda: ["".join(rng.choices("abcdefghij", k=7)) for _ in range(250)]
    out = [" ".join([*words(), shared, *words()]) for _ in range(50)]
    for k in (3, 7):  # near copies, 40 words of 504 changed
        some = out[k].split(" ")
        for i in range(0, 480, 12):
            some[i] = "changed"
        out.append(" ".join(some))
    return out


def test_unlike_long_lines_are_not_paired(spark, monkeypatch):
    made, real = [], common.cut

    def cut(df, name, rows=None):
        out = real(df, name, rows)
        if name == "candidates":
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "cut", cut)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.removed for r in lines.repeated_lines(docs).collect()}
    assert got == {50: [0], 51: [0]}
    assert sum(made) < 3 * len(texts)  # not all of the 1,326 pairs


def test_wide_parities_differ_by_edits_at_most():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(0, 30, rng.integers(1, 80)).astype(np.uint64)
        y = rng.integers(0, 30, rng.integers(1, 80)).astype(np.uint64)
        apart = int(np.bitwise_count((lines.bag_parities(x) ^ lines.bag_parities(y)).view(np.uint64)).sum())
        assert apart <= 2 * lines.bag_distance(x, y) - abs(len(x) - len(y))
