import random

import pytest

from proofloom.operators import evidence, graph, score
from proofloom.plans.register import Register

SF = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "cites") for a, b in pairs], "citing long, cited long, kind string")


def test_components_match_union_find_and_ignore_order(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.root for r in graph.components(edges(spark, pairs)).collect()}
    turned = {r.node: r.root for r in graph.components(edges(spark, [(b, a) for a, b in reversed(pairs)])).collect()}
    assert got == turned == want


def test_no_edges_give_no_components(spark):
    assert graph.components(edges(spark, []).where("false")).count() == 0


def test_dense_cycle_terminates_with_every_node_once(spark):
    pairs = [(i, (i * k + s) % 40) for i in range(40) for k, s in ((3, 1), (7, 5), (1, 1), (11, 2))]
    trace = graph.trace_origin(edges(spark, pairs), spark.createDataFrame([(0,)], "seed long"), 25)
    rows = trace.collect()
    assert len(rows) == len({r.node for r in rows}) and max(r.depth for r in rows) <= 25


def test_flags_and_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)])
    trace = graph.trace_origin(e, spark.createDataFrame([(5,)], "seed long"))
    flags = {r.node: (r.is_terminus, r.closes_cycle) for r in graph.with_flags(trace, e).collect()}
    assert flags[4] == (True, False) and flags[5] == (False, True)
    assert {r.node for r in graph.on_cycle(e).collect()} == {1, 2, 3}
    paths = {r.node: r.path for r in graph.origin_paths(trace, spark.createDataFrame([(5, 4)], "seed long, node long")).collect()}
    assert paths[4] == [5, 1, 2, 3, 4]


def test_copies_of_one_root_are_one_lineage(spark):
    """One root and forty paraphrases count once; independent rows count each."""
    obs = spark.createDataFrame(
        [(1, f"o{i}", i, 3, "V", None, f"f{i}", "CLAIM", False, False, "2000-01-01") for i in range(41)],
        "proposition_id long, observation_id string, document_id long, magnitude int, membership string, model_family string, fact_key string, locus string, null_excluding boolean, negative_search boolean, asserted_on string",
    )
    roots = graph.components(edges(spark, [(i, 0) for i in range(1, 41)]))
    assert evidence.lineage_counts(obs, roots).first().l_d3 == 1
    assert evidence.lineage_counts(obs, roots.where("false")).first().l_d3 == 41


def test_caps_only_lower_and_clamp_is_idempotent(spark):
    rank = {"A": 7, "B": 6, "C": 5, "D": 4, "E": 3, "F": 2}
    r = Register(spark, SF)
    for x in r.graded.select("awarded", "capped", "grade").collect():
        if x.awarded != "R":
            assert rank[x.capped] <= rank[x.awarded]
    once = r.final
    again = score.clamp(once.withColumn("grade", once.final).drop("final", "clamped"))
    assert again.where("clamped").count() == 0


def test_ring_of_sixty_and_a_chain_on_it(spark):
    ring = [(i, (i + 1) % 60) for i in range(60)] + [(500 + i, 501 + i) for i in range(20)] + [(520, 3), (7, 700)]
    assert {r.node for r in graph.on_cycle(edges(spark, ring)).collect()} == set(range(60))
    two = graph.strong_parts(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5)])).collect()
    assert {(r.node, r.part) for r in two} == {(1, 2), (2, 2), (3, 4), (4, 4)}


def test_clamp_reaches_the_end_of_a_long_chain(spark):
    rows = [(k, "EXIST" if k == 0 else "STATUS", None if k == 0 else k - 1, "E" if k == 0 else "A") for k in range(25)] + [(100, "STATUS", 999, "B")]
    out = {r.proposition_id: r.final for r in score.clamp(spark.createDataFrame(rows, "proposition_id long, class string, parent_id long, grade string")).collect()}
    assert out == {k: "E" for k in range(25)} | {100: "B"}
    circle = spark.createDataFrame([(1, "STATUS", 2, "A"), (2, "STATUS", 1, "B")], "proposition_id long, class string, parent_id long, grade string")
    with pytest.raises(ValueError):
        score.clamp(circle)


def reachable(pairs):
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[n] = seen
    return out


@pytest.mark.parametrize("seed", range(12))
def test_circles_are_nodes_that_reach_each_other(seed):
    rng = random.Random(seed)
    n = rng.choice([4, 12, 90])
    pairs = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.3, 2])))) if a != b]
    reach = reachable(pairs)
    want = {x: max(y for y in reach[x] if x in reach[y]) for x in reach if x in reach[x]}
    assert graph.circles([a for a, _ in pairs], [b for _, b in pairs]) == want


@pytest.mark.parametrize("small", [0, 30, 20_000])  # all, some and no components by colours
def test_strong_parts_whatever_the_size(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(small)
    pairs = [(a + 100 * k, b + 100 * k) for k in range(4) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(15 + 9 * k)) if a != b]
    reach = reachable(pairs)
    want = {x: max(y for y in reach[x] if x in reach[y]) for x in reach if x in reach[x]}
    assert {r.node: r.part for r in graph.strong_parts(edges(spark, pairs)).collect()} == want
