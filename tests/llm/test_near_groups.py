"""Operator 7 against all pairs on groups of near copies whose links are sparse and on passages that many texts share."""

import random

import pytest

from proofloom.llm import jaccard


def brute(texts):
    sets = {}
    for doc, text in texts.items():
        w = text.split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("stars", [jaccard.STARS, (1, 1)])
def test_sparse_groups(spark, monkeypatch, stars):
    monkeypatch.setattr(jaccard, "STARS", stars)
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = {}
    for size in (20, 60, 150):
        base = [word() for _ in range(size)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                at = rng.randrange(len(copy))
                copy[at:at] = [word() for _ in range(rng.randrange(1, size // 5))]
            texts[len(texts)] = " ".join(copy)
    for _ in range(30):
        texts[len(texts)] = " ".join([word() for _ in range(rng.randrange(5, 40))] + passage + [word() for _ in range(rng.randrange(5, 40))])
    want = brute(texts)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.component_table(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and len({c for _, _, c in want}) > 40
