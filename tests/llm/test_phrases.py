"""Collocations against plain Python on small and odd tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, first=2000, longest=4):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            s, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((s, a, " ".join(p), left, right))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(rows[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = ["New", "york", "city", "the", "of", "state", "é", "😀x", "a b", "x-y", "ﬁ"]
    out = []
    for k in range(150):
        body = " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", "\n", "\t", "!?"]) for _ in range(rng.randrange(60)))
        out.append((k, body, rng.choice(["en", "en", "de", None, ""])))
    out += [(200, None, "en"), (201, "", None), (202, "..., \n", "de"), (None, "the city", "fr"), (203, "new york city " * 3000, "en"), (204, "one", "nl")]
    return out + out[:20]


@pytest.mark.parametrize("chunk", [1 << 20, 50])  # small chunks: groups met in many of them
def test_collocations(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"chunk": F.lit("x"), "code": F.lit(1), "n": F.lit(2)}).repartition(3)
    got = phrases.collocations(docs, least=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_first_of_each_language(spark, rows):
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), first=3, least=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, 3)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b c", "en")]])
def test_without_candidates(spark, rows):
    assert phrases.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**17, 3 * 10**17 + 1, 5 * 10**17
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 2000000 * a // (left + right)


def test_places_close_pieces():
    text = b"Ab cd, ef  gh\tij\nkl. mn"
    one, _, words, _, places = phrases._words_of(np.frombuffer(text, np.uint8), np.array([0, 5, len(text)]), np.array([0, 1]))
    said = ["|" if p < 0 else words[p].as_py() for p in places]
    assert said == ["ab", "cd", "|", "ef", "gh", "ij", "|", "kl", "|", "mn", "|"] and len(one) == 7


def test_packing_round_trips():
    for v in ([], [0], [-1, 5, 2**60, -(2**60)]):
        assert phrases._unpacked(phrases._packed(np.array(v, np.int64))).tolist() == v
    import pyarrow as pa

    for w in ([], ["a"], ["é", "", "😀x", "b\ten"]):
        assert phrases._unpack_words(phrases._pack_words(pa.array(w, pa.large_string()))).to_pylist() == w
