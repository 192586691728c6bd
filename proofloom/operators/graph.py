"""Graph operators over a cyclic citation table, for all seeds at once.

Each is a loop of equi-joins with deduplication whose state is written between rounds, so the
work of a round is bounded by its frontier and a lost executor costs one round at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

MAX_DEPTH = 24


def trace_origin(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, extra: str = "kind") -> DataFrame:
    """Breadth-first from every seed: seed, node, depth (shallowest), via (least kind at that depth), parent (least).

    edges: citing, cited, kind. seeds: seed. A seed reaches itself at depth 0.
    """
    steps = edges.select("citing", "cited", F.col(extra).alias("via")).where("citing is not null and cited is not null and citing <> cited")
    frontier = cut(seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("long").alias("parent")), "frontier")
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.select("seed", F.col("node").alias("citing")).join(steps, "citing").groupBy("seed", F.col("cited").alias("node")).agg(F.min("via").alias("via"), F.min("citing").alias("parent"))
        new = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(new.select("seed", "node", F.lit(depth).alias("depth"), "via", "parent"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def with_flags(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """trace with is_terminus (cites nothing) and closes_cycle (cites something that its seed reached)."""
    out = edges.select(F.col("citing").alias("node"), "cited").distinct()
    citing = out.select("node").distinct().withColumn("cites", F.lit(True))
    back = trace.select("seed", "node").join(out, "node").join(trace.select("seed", F.col("node").alias("cited")), ["seed", "cited"], "left_semi")
    back = back.select("seed", "node").distinct().withColumn("closes_cycle", F.lit(True))
    return (
        trace.join(citing, "node", "left").join(back, ["seed", "node"], "left")
        .select("seed", "node", "depth", "via", F.col("cites").isNull().alias("is_terminus"), F.coalesce("closes_cycle", F.lit(False)).alias("closes_cycle"))
    )


def components(edges: DataFrame, a: str = "citing", b: str = "cited") -> DataFrame:
    """(node, root): undirected components, root the least node; alternating large-star and small-star rounds."""
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        ends = now.groupBy("u").agg(F.count("*").alias("n")).select(F.col("u").alias("node"), (F.col("n") > 1).alias("many"), F.lit(True).alias("leaf"), F.lit(False).alias("root"))
        ends = ends.unionByName(now.select(F.col("v").alias("node"), F.lit(False).alias("many"), F.lit(False).alias("leaf"), F.lit(True).alias("root")).distinct())
        if ends.groupBy("node").agg(F.max("many").alias("many"), (F.max("leaf") & F.max("root")).alias("mixed")).where("many or mixed").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _reached(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label: the largest label that comes to each node along edges (a, b), its own included; edges stay within a part."""
    now = cut(labels, "labels")
    while True:
        step = edges.join(now.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("label").alias("come"))
        new = cut(now.join(step, "node", "left").select("node", F.greatest("label", "come").alias("label"), (F.col("come") > F.col("label")).alias("moved")), "labels")
        done = new.where("moved").isEmpty()
        now = new.select("node", "label")
        if done:
            return now


#: Edges of a weakly connected component that a task may take whole, and edges of such components dealt to a task together.
SMALL, DEAL = 20_000, 20_000


def circles(sources: list[int], targets: list[int]) -> dict[int, int]:
    """The part (its largest node) of every node on a circle, by one depth-first walk with a stack of open nodes."""
    ahead: dict[int, list[int]] = {}
    for x, y in zip(sources, targets, strict=True):
        ahead.setdefault(x, []).append(y)
    number, lowest, open_, held, out = {}, {}, set(), [], {}
    for start in ahead:
        if start in number:
            continue
        walk = [(start, iter(ahead[start]))]
        number[start] = lowest[start] = len(number)
        held.append(start)
        open_.add(start)
        while walk:
            node, rest = walk[-1]
            new = next((y for y in rest if y not in number or y in open_ and number[y] < lowest[node]), None)
            if new is None:
                walk.pop()
                if walk:
                    lowest[walk[-1][0]] = min(lowest[walk[-1][0]], lowest[node])
                if lowest[node] == number[node]:
                    part = _above(held, node)
                    del held[len(held) - len(part) :]
                    open_.difference_update(part)
                    if len(part) > 1:
                        out |= dict.fromkeys(part, max(part))
            elif new in number:
                lowest[node] = number[new]
            else:
                number[new] = lowest[new] = len(number)
                held.append(new)
                open_.add(new)
                walk.append((new, iter(ahead.get(new, ()))))
    return out


def _above(held: list[int], node: int) -> list[int]:
    """The end of held from node on."""
    at = len(held) - 1
    while held[at] != node:
        at -= 1
    return held[at:]


def strong_parts(edges: DataFrame, a: str = "citing", b: str = "cited") -> DataFrame:
    """(node, part) of the nodes on circles: nodes that reach each other are one part, whatever the length of the way.

    Circles lie within weakly connected components. Components of at most SMALL edges are walked whole,
    many in a task; larger ones are taken apart by colours, in rounds over all of them at once.
    """
    live = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "live")
    rooted = cut(live.join(components(live, "a", "b").select(F.col("node").alias("a"), "root"), "a"), "rooted")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    lots = max(1, -(-live.count() // DEAL))
    small = rooted.join(sizes.where(F.col("n") <= SMALL).select("root"), "root", "left_semi").withColumn("lot", F.pmod(F.xxhash64("root"), F.lit(lots)))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(circles(frame["a"].tolist(), frame["b"].tolist()).items()), columns=["node", "part"])

    found = cut(small.groupBy("lot").applyInPandas(walk, "node long, part long"), "circles")
    large = cut(rooted.join(sizes.where(F.col("n") > SMALL).select("root"), "root", "left_semi").select("a", "b"), "large")
    return found if large.isEmpty() else found.unionByName(coloured_parts(large))


def coloured_parts(live: DataFrame) -> DataFrame:
    """strong_parts of edges (a, b) of any size: nodes without an edge in or out are peeled off; then the largest node that
    reaches a node colours it, and those that reach back to their colour's node within the colour are a part and leave.

    All colours are worked on at once; rounds are written, so a lost executor costs one round.
    """
    found = None
    while not live.isEmpty():
        n = live.count()
        while True:  # peel
            both = live.select(F.col("a").alias("x")).distinct().join(live.select(F.col("b").alias("x")).distinct(), "x", "left_semi")
            live = cut(live.join(both.withColumnRenamed("x", "a"), "a", "left_semi").join(both.withColumnRenamed("x", "b"), "b", "left_semi").select("a", "b"), "live")
            m = live.count()
            if m * 20 >= n * 19:  # little comes off any more: colours do the rest
                break
            n = m
        if not m:
            break
        nodes = live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node"))).distinct()
        colour = cut(_reached(live, nodes.select("node", F.col("node").alias("label"))), "colour")
        own = live.join(colour.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b").where("ca = cb")
        inside = cut(own.select("a", "b"), "inside")
        # back along the edges from each colour's node
        back = _reached(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.select("node", F.when(F.col("node") == F.col("label"), 1).otherwise(0).alias("label")))
        part = cut(back.where("label = 1").select("node").join(colour, "node").select("node", F.col("label").alias("part")), "part")
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        live = cut(live.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "live")
    if found is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("part"))
    several = found.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    return found.join(several, "part", "left_semi").select("node", "part")


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves by a way of any length over other nodes."""
    return strong_parts(edges).select("node")


def origin_paths(trace: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """seed, node, path (from seed to node) of the (seed, node) targets, by the trace's parent pointers."""
    parents = trace.select("seed", F.col("node").alias("at"), "parent")
    walk = targets.select("seed", "node", F.col("node").alias("at"), F.array("node").alias("path"))
    done = None
    for _ in range(max_depth + 1):
        stepped = walk.join(parents, ["seed", "at"])
        ended = stepped.where("parent is null").select("seed", "node", "path")
        done = ended if done is None else done.unionByName(ended)
        walk = cut(stepped.where("parent is not null").select("seed", "node", F.col("parent").alias("at"), F.concat(F.array("parent"), "path").alias("path")), "walk")
        if walk.isEmpty():
            break
    return done


# ---- what lies ahead of each node, without a table of seeds and nodes


def condensed(edges: DataFrame, a: str = "citing", b: str = "cited") -> tuple[DataFrame, DataFrame]:
    """(node, part) of all nodes of the edges and the edges (a, b) between different parts: nodes that reach each other are one part, so no circle is left."""
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "ways")
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    parts = cut(nodes.join(strong_parts(e, "a", "b"), "node", "left").select("node", F.coalesce("part", "node").alias("part")), "parts")
    ends = e.join(parts.select(F.col("node").alias("a"), F.col("part").alias("x")), "a").join(parts.select(F.col("node").alias("b"), F.col("part").alias("y")), "b")
    return parts, cut(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "part-ways")


def least_ahead(ways: DataFrame, own: DataFrame) -> DataFrame:
    """(part, value): the least value (own: part, value) among a part and all that it leads to along acyclic ways (a, b); parts that lead to none are left out.

    One value a part: each round hands improved values one way back.
    """
    now = cut(own.groupBy("part").agg(F.min("value").alias("value")), "least")
    moved = now
    while not moved.isEmpty():
        come = ways.join(moved.withColumnRenamed("part", "b"), "b").groupBy(F.col("a").alias("part")).agg(F.min("value").alias("come"))
        new = cut(now.join(come, "part", "full_outer").select("part", F.least("value", "come").alias("value"), F.coalesce(F.col("value").isNull() | (F.col("come") < F.col("value")), F.lit(False)).alias("moved")), "least")
        now, moved = new.select("part", "value"), new.where("moved").select("part", "value")
    return now


def targets_ahead(ways: DataFrame, own: DataFrame) -> DataFrame:
    """(part, target): the different targets (own: part, target) in a part and in all that it leads to. Parts stand for all their nodes, so a large circle costs no more than a node."""
    new = seen = cut(own.select("part", "target").distinct(), "targets")
    while True:
        step = ways.join(new.withColumnRenamed("part", "b"), "b").select(F.col("a").alias("part"), "target").distinct()
        new = cut(step.join(seen, ["part", "target"], "left_anti"), "targets")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def steps_to(edges: DataFrame, targets: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """(node, steps): fewest edges from a node to the nearest target (node), by a search from all targets at once against the edges; nodes farther than `most` are left out."""
    back = edges.select(F.col("cited").alias("b"), F.col("citing").alias("a")).where("a is not null and b is not null and a <> b").distinct()
    new = seen = cut(targets.select("node").distinct().withColumn("steps", F.lit(0)), "steps")
    for k in range(1, most + 1):
        step = back.join(new.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node")).distinct()
        new = cut(step.join(seen, "node", "left_anti").withColumn("steps", F.lit(k)), "steps")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def origins(edges: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the citations of each document go back to in the end, at any distance.

    documents: document_id, dated (the effective date, null if none), basis (what it is taken from).
    (document_id, first) with first = (dated, node, basis) of the earliest dated document without
    citations; and (document_id, node), all documents without citations. Documents that cite nothing
    are their own; those that lead into circles alone have none.
    """
    parts, ways = condensed(edges)
    cites = edges.where("citing <> cited").select(F.col("citing").alias("document_id")).distinct()
    ends = cut(documents.join(cites, "document_id", "left_anti"), "ends")
    placed = ends.join(parts.withColumnRenamed("node", "document_id"), "document_id", "left").select(F.coalesce("part", "document_id").alias("part"), "document_id", "dated", "basis")
    value = F.struct("dated", F.col("document_id").alias("node"), "basis")
    least = least_ahead(ways, placed.where("dated is not null").select("part", value.alias("value")))
    every = targets_ahead(ways, placed.select("part", F.col("document_id").alias("target")))
    of = documents.select("document_id").join(parts.withColumnRenamed("node", "document_id"), "document_id", "left").select("document_id", F.coalesce("part", "document_id").alias("part"))
    return of.join(least, "part").select("document_id", F.col("value").alias("first")), of.join(every, "part").select("document_id", F.col("target").alias("node"))
