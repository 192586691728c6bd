"""Spans with edits, and near places, against brute force over everything."""

import random

import pytest

from proofloom.operators import geo, text


def best(body, span):
    """Fewest edits between span and any stretch of body, by the whole table."""
    row = [0] * (len(body) + 1)
    for i, c in enumerate(span, 1):
        new = [i]
        for j, d in enumerate(body, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, span, n):
    for _ in range(n):
        k = rng.randrange(len(span))
        span = rng.choice([span[:k] + rng.choice("abx 7") + span[k + 1 :], span[:k] + span[k + 1 :], span[:k] + rng.choice("qz ") + span[k:]])
    return " ".join(span.split())


@pytest.mark.parametrize("seed", range(3))
def test_alignment_is_the_least_over_all_stretches(seed):
    rng = random.Random(seed)
    for _ in range(120):
        span = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 40)))
        body = "".join(rng.choice("ab c") for _ in range(rng.randrange(60)))
        most, want = rng.randrange(6), best(body, span)
        got = text.span_edits(body, span, most)
        assert (got and got[0]) == (want if want <= most else None)
        near = [e[0] for a, b in text.windows(body, span, most) if (e := text.span_edits(body[a:b], span, most))] if len(span) > most else [want]
        assert min(near, default=None) == (want if want <= most else None) or want > most


def test_every_span_is_found_with_edits_at_every_place(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    long_words = ["".join(rng.choice("klmnop") for _ in range(40)) for _ in range(9)]
    spans = {1: " ".join(rng.choices(words, k=50)), 2: " ".join(rng.choices(words, k=30)), 3: "ab cd", 4: " ".join(long_words), 5: " ".join(rng.choices(words, k=7)), 6: "x" * 230}
    filler = lambda n: " ".join(rng.choices(words, k=n))
    docs, n = {}, 0
    for item, span in spans.items():
        for place in range(0, len(span), 5):  # one letter changed at every fifth place
            docs[n] = f"{filler(4)} {span[:place]}9{span[place + 1 :]} {filler(3)}"
            n += 1
        for edits in range(6):
            docs[n] = edited(rng, f"{span[: len(span) // 2]} {filler(9)} {span}", edits)  # the beginning stands there twice
            n += 1
    docs[n], docs[n + 1], docs[n + 2] = None, "", spans[2]
    got = text.fuzzy_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([*spans.items(), (7, None), (8, "")], "item_id long, text string"), 2)
    norm = lambda s: " ".join((s or "").split())
    want = {(d, i, e, e == 0) for d, body in docs.items() for i, span in spans.items() if (e := best(norm(body), norm(span))) * 100 <= 2 * len(span)}
    # a span without edits must stand as words of its own where it is short; all others are found wherever they are
    found = {tuple(r) for r in got.collect()}
    assert found <= want and {w for w in want if w not in found} <= {w for w in want if len(spans[w[1]]) < 50}
    assert {w for w in want if len(spans[w[1]]) >= 50} == {f for f in found if len(spans[f[1]]) >= 50} and len(found) > 100


def test_places_of_spans(spark):
    docs = [(1, "The red fox. the red fox ran, the red fox"), (2, "red"), (3, None), (4, "a redfox red fox")]
    got = text.locate_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "Red fox"), (2, "THE red fox ran the")], "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 5), (1, 1, 17), (1, 1, 33), (4, 1, 10), (1, 2, 13)}


@pytest.mark.parametrize("metres", [20_000, 900_000, 9_000_000])
def test_near_pairs_are_all_pairs(spark, metres):
    import math

    rng = random.Random(metres)
    at = [(rng.randrange(-18000, 18001), rng.randrange(-9000, 9001)) for _ in range(220)]
    at += [(rng.choice([-18000, 18000, -17995, 17993]), rng.randrange(-100, 100)) for _ in range(30)] + [(rng.randrange(-18000, 18000), rng.choice([8999, 9000, -9000, 8990])) for _ in range(30)]
    at += [(x + rng.randrange(-15, 15), max(-9000, min(9000, y + rng.randrange(-15, 15)))) for x, y in at[:80]]

    def ground(a, b):
        (x, y), (u, v) = [[math.radians(c / 100) for c in p] for p in (a, b)]
        return 2 * geo.EARTH * math.asin(math.sqrt(min(1, math.sin((y - v) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((x - u) / 2) ** 2)))

    want = {(i, j) for i in range(len(at)) for j in range(i + 1, len(at)) if ground(at[i], at[j]) <= metres}
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id long, lon_c long, lat_c long")
    got = [tuple(r) for r in geo.near_pairs(points, metres).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
