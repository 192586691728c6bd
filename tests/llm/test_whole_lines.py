"""Operator 5 against the edit similarity of all pairs of lines, with no other filter."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from proofloom.llm import lines

SF = "/root/testdata/sf0.001"


def removed(texts):
    """Numbers of removed lines by document, from all pairs of lines."""
    normal = lambda t: b" ".join(bytes(lines._NORMAL[b] for b in t.encode()).split()).decode()
    places = defaultdict(list)
    for doc, text in texts.items():
        for k, line in enumerate((text or "").split("\n")):
            if len(normal(line).split(" ")) >= lines.MIN_WORDS:
                places[normal(line)].append((doc, k))
    names = list(places)
    bags = [Counter(n.split(" ")) for n in names]
    size = np.array([b.total() for b in bags])
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(names)):
        long = np.maximum(size[i + 1 :], size[i])
        for j in i + 1 + np.flatnonzero(np.minimum(size[i + 1 :], size[i]) >= lines.SIMILARITY * long):
            # words in common bound the similarity from above
            if (bags[i] & bags[j]).total() >= lines.SIMILARITY * max(size[i], size[j]) and lines.similar(names[i], names[j], lines.SIMILARITY):
                parent[find(int(j))] = find(i)
    groups = defaultdict(list)
    for i, name in enumerate(names):
        groups[find(i)] += places[name]
    return dict(Counter(doc for g in groups.values() for doc, _ in sorted(g)[1:]))


def got(df):
    return {r.doc_id: len(r.removed) for r in lines.repeated_lines(df).collect()}


def test_all_similar_lines_are_found(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall())
    assert got(spark.read.parquet(f"{SF}/documents.parquet")) == removed(texts)


@pytest.mark.parametrize("vocabulary", [6, 3000])
def test_edited_lines_of_every_length(spark, vocabulary):
    rng = random.Random(vocabulary)
    texts = {}
    for n in [*range(4, 45), 60, 99, 100, 101, 300]:
        line = [f"w{chr(97 + rng.randrange(26))}x{'y' * rng.randrange(4)}{chr(97 + rng.randrange(26))}" if vocabulary > 99 else "abcdef"[rng.randrange(6)] for _ in range(n)]
        for _ in range(3):
            other = list(line)
            for _ in range(n // 5):
                at, kind = rng.randrange(len(other)), rng.randrange(4)
                other[at : at + (kind != 1)] = [] if kind == 0 else ["new" + chr(97 + rng.randrange(26))]
            texts[len(texts)] = " ".join(line) + "\n" + " ".join(other)
    assert got(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == removed(texts)
