"""Exact dedup and the Merkle manifest against plain Python, on small and odd tables."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import exact, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [f"text {k % 40}\nline {k % 7}" for k in range(160)] + ["", None, "\n", "é😀", "a;b,c"] * 4 + ["long " * 20000] * 3
    out = [(rng.randrange(120) if k % 17 else None, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "web", "", None, "zß"]), len(t) if t and k % 5 else None) for k, t in enumerate(texts)]
    return out + out[:9]  # repeated rows


# ---- quotient filters


@pytest.mark.parametrize("bits", [6, 20, 60])
def test_filter_round_trip_and_merge(bits):
    rng = np.random.default_rng(bits)
    parts = [np.unique(rng.integers(0, 1 << bits, 500, dtype=np.uint64), return_counts=True) for _ in range(4)]
    packed = [exact.encode(v, c * (1 + k), bits) for k, (v, c) in enumerate(parts)]
    for p, (k, (v, c)) in zip(packed, enumerate(parts)):
        got = exact.decode(p)
        assert (got[0] == v).all() and (got[1] == c * (1 + k)).all()
    want = Counter()
    for k, (v, c) in enumerate(parts):
        want.update(dict(zip(v.tolist(), (c * (1 + k)).tolist())))
    values, counts = exact.decode(exact.merge(packed, bits))
    assert dict(zip(values.tolist(), counts.tolist())) == want and (np.diff(values.astype(float)) >= 0).all()


def test_empty_filter():
    values, counts = exact.decode(exact.encode(np.zeros(0, np.uint64), np.zeros(0, np.int64), 60))
    assert len(values) == len(counts) == 0


def test_filter_counts_every_fingerprint(spark):
    prints = spark.range(30000).select((F.col("id") % 7000 * 1000003).alias("print")).repartition(7)
    slices, own = exact.quotient_filter(prints, 30000)
    got = {r.print: r.n for r in exact.repeated(slices, own).collect()}
    assert got == Counter(k % 7000 * 1000003 for k in range(30000))


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            one = i == keep and not kept
            kept |= one
            out[i, keep, len(ids), one, h(text)] += 1
    return out


@pytest.mark.parametrize("bits", [60, 3, 8])  # few bits: fingerprints that stand for many texts
def test_exact_groups(spark, rows, bits):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("print", F.lit(1)).withColumn("keep_id", F.lit("x")).repartition(5)
    got = exact.exact_groups(docs, bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_groups(rows)


def test_exact_groups_without_rows(spark):
    assert exact.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in exact.exact_groups(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).collect()] == [(None, None, 1, True, h(""))]


# ---- Merkle


def leaf(row, text):
    doc, _, lang, source, n = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(nodes):
    """Root and, for each node, its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append((nodes[run:i], nodes[i + 1 : run + 3]))
            at[k] = i // 3
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    root, tops = tree([subs[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops):
        for (known, doc, own, changed), path in zip(sorted(by[s]), subs[s][1]):
            steps, node = path + top, changed
            for left, right in steps:
                node = h("".join(left) + node + "".join(right))
            out[doc if known else None, own, subs[s][0], root, h("".join(x for left, right in steps for x in left + right)), node, node == root] += 1
    return out


@pytest.mark.parametrize("depth", [1, 2, 8])  # shallow superblocks: several rows of them
def test_manifest(spark, rows, depth):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("idx", F.lit("x")).repartition(6)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    got = merkle.manifest(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")), depth)
    assert Counter(tuple(r) for r in got.collect()) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 28])
def test_manifest_of_single_rows_and_many_sources(spark, n):
    rows = [(k, f"t{k}\n", "en", f"s{k:02}", k) for k in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.col("text"), 1)
    found = got.collect()
    assert len({r.root for r in found}) == 1 and all(r.verified and r.leaf == r.subroot for r in found)
    assert {r.root for r in found} == {k[3] for k in brute_manifest(rows)}


def test_manifest_without_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), F.col("text")).collect() == []
