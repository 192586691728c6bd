"""Contracts of the earlier operators that wide or odd input puts to the test."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import language, licenses, lines, pseudonyms, vectors


def test_letters_are_those_of_all_planes():
    table = language.letters()
    want = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    assert want.max() < len(table) and (np.flatnonzero(table) == want).all()


@pytest.mark.parametrize(("text", "letters"), [("\U00020000\U0002a6d0 \U00030010", 3), ("\U000f0000\U00100001", 0), ("1 \U0001d400é", 2)])
def test_letters_beyond_the_first_plane_count(text, letters):
    data = np.frombuffer(text.encode(), np.uint8)
    assert language.trigrams(data, np.array([0, len(data)]))[2].tolist() == [letters]


def test_exceptions_help_known_licences_alone():
    assert licenses.evaluate(["nonsense", "classpath-exception-2.0", "with"]) == 0 if "with" in licenses._STRENGTH else True
    known = licenses.family_grade("gpl-2.0")
    assert known > 0 and licenses.family_grade("nonsense") == 0


def feistel(value, key, what, left, right, rounds):
    a, b = divmod(value, right)
    for turn in range(rounds):
        other = b if turn % 2 == 0 else a
        n = int(sha256(f"{key}|{what}|{turn}|{other}".encode()).hexdigest()[:8], 16)
        a, b = ((a + n) % left, b) if turn % 2 == 0 else (a, (b + n) % right)
    return a * right + b


def plain_ssn(text, key, rounds):
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    n = feistel(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, key, "ssn", 898 * 99, 9999, rounds)
    place, rest = divmod(n, 99 * 9999)
    area = place + 1 + (place + 1 >= 666)
    return f"{area:03}-{rest // 9999 + 1:02}-{rest % 9999 + 1:04}"


def test_social_security_numbers_stay_valid_and_apart(spark):
    rng = np.random.default_rng(4)
    valid = {f"{a:03}-{g:02}-{s:04}" for a, g, s in zip(rng.choice([*range(1, 666), *range(667, 900)], 3000), rng.integers(1, 100, 3000), rng.integers(1, 10000, 3000), strict=True)}
    edges = {"001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999"}
    odd = {"000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"}
    df = spark.createDataFrame([(x,) for x in sorted(valid | edges | odd)], "m string")
    got = {r.m: r.p for r in df.select("m", pseudonyms.pseudonym(F.col("m"), "k", ["ssn"]).alias("p")).collect()}
    assert all(got[x] == x for x in odd)
    for x in valid | edges:
        assert got[x] == plain_ssn(x, "k", pseudonyms.ROUNDS)
        area, group, serial = (int(p) for p in got[x].split("-"))
        assert 0 < area < 900 and area != 666 and group > 0 and serial > 0
    assert len({got[x] for x in valid | edges}) == len(valid | edges)


def test_one_query_id_with_different_vectors_asks_for_the_least(spark):
    rows = [(50, [9.0, 0.0]), (50, [1.0, 5.0]), (50, [3.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [4.0])] * 2
    for _ in range(3):
        got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") == 50, 2, scale=1)
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == {(50, 1, 3, 12), (50, 2, 3, 12)}


def test_many_cells_hold_every_link(spark):
    """20,000 vectors in 78 cells: all columns against brute force in blocks."""
    rng = np.random.default_rng(7)
    heads = rng.normal(size=(4000, 24))
    x = np.concatenate([heads, heads[:2000].repeat(4, axis=0) + rng.normal(size=(8000, 24)) * 0.12, rng.normal(size=(8000, 24))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label, n_links = np.arange(len(x)), np.zeros(len(x), int)
    pairs = []
    for i in range(0, len(x), 1000):
        a, b = np.nonzero(unit[i : i + 1000] @ unit.T >= 0.9)
        a, b = a[a + i != b] + i, b[a + i != b]
        n_links += np.bincount(a, minlength=len(x))
        pairs.append(np.stack([a, b]))
    a, b = np.concatenate(pairs, axis=1)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        if (low == label).all():
            break
        label = low
    assert max(1, len(x) // vectors.CELL_ROWS) >= 60
    got = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    found = got.n_links.to_numpy()
    assert (found <= n_links).all() and found.sum() >= 0.99 * n_links.sum() > 20_000
    same = got.component_id.to_numpy() == label
    assert same.mean() >= 0.999 and (got.component_id.to_numpy() >= label).all()
    assert (got.kept.to_numpy() == (got.component_id.to_numpy() == np.arange(len(x)))).all()


def test_long_lines_are_compared_exactly():
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 80, rng.integers(150, 420)).astype(np.uint64) for _ in range(12)]
    xs, ys = [], []
    for k in range(60):
        x = base[k % 12]
        y = np.delete(x, rng.integers(0, len(x), rng.integers(0, 90))) if k % 3 else rng.permutation(x) if k % 2 else base[(k + 1) % 12]
        xs.append(x)
        ys.append(y)
    most = np.array([max(len(x), len(y)) // 5 for x, y in zip(xs, ys, strict=True)])
    true = [lines.edit_distance(x.tolist(), y.tolist()) for x, y in zip(xs, ys, strict=True)]
    assert all(lines.bag_distance(x, y) <= d for x, y, d in zip(xs, ys, true, strict=True))
    got = lines.within(xs, ys, most)
    assert got.tolist() == [d <= m for d, m in zip(true, most, strict=True)] and 5 < got.sum() < 55
