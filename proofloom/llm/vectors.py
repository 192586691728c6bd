"""Operators 9 and 10 on embeddings: exact top-k search and near-duplicate removal.

Vectors that are null or hold null or non-finite components take no part; vectors of different
lengths are never compared. Repeated rows and equal vectors are allowed; of different vectors under one
query id the least, shorter ones first, is asked for. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

# ---- operator 9: impact-ordered score-at-a-time search

#: Rows of an index block and queries of a query block.
INDEX_ROWS, QUERY_ROWS = 8192, 512
#: Impact levels a component is quantised to within a block.
LEVELS = 16
#: Parts of the segments after which the bound is looked at.
STOPS = (0.5, 0.7, 0.8, 0.88, 0.94, 0.97)


def finite(vector: Column) -> Column:
    """True for vectors that are not null, have components, and hold finite ones alone."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


class ImpactIndex:
    """Posting segments of a block of integer vectors: for each dimension and level the rows that stand there."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, dims = rows.shape
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)
        step = (self.high - self.low) // LEVELS + 1
        level = (rows - self.low) // step
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        bounds = np.arange(LEVELS + 1)
        self.at = np.stack([np.searchsorted(level[self.order[d], d], bounds) for d in range(dims)])
        # a segment's least and largest component; empty segments hold nothing
        self.seg_low = self.low[:, None] + step[:, None] * np.arange(LEVELS)
        self.seg_high = np.minimum(self.seg_low + step[:, None] - 1, self.high[:, None])

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own, ties to the smaller id."""
        weight = np.abs(query)[:, None]
        plus = (query >= 0)[:, None]
        # gains over the least that a dimension can give; never negative
        least = weight * np.where(plus, self.seg_low - self.low[:, None], self.high[:, None] - self.seg_high)
        most = weight * np.where(plus, self.seg_high - self.low[:, None], self.high[:, None] - self.seg_low)
        full = (self.at[:, 1:] > self.at[:, :-1]) & (weight > 0)
        dim, lev = np.nonzero(full)
        impact = most[dim, lev]
        order = np.argsort(-impact, kind="stable")
        dim, lev, impact = dim[order], lev[order], impact[order]
        gain = np.zeros(len(self.ids), np.int64)
        slack = (most - least).max(axis=1)
        others = self.ids != own
        want = min(k, int(others.sum()))
        if not want:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = [int(s * len(dim)) for s in STOPS] + [len(dim)]
        done, some = 0, np.flatnonzero(others)
        for stop in left:
            for s in range(done, stop):
                d, v = dim[s], lev[s]
                gain[self.order[d, self.at[d, v] : self.at[d, v + 1]]] += least[d, v]
            done = stop
            # what a row may still get: in each dimension the slack of its segment or the best segment that is left
            rest = np.zeros(len(query), np.int64)
            np.maximum.at(rest, dim[done:], impact[done:])
            bound = int(np.maximum(rest, slack).sum())
            sure = np.partition(gain[some], len(some) - want)[len(some) - want]
            some = some[gain[some] + bound >= sure]  # proof: the others cannot reach the k-th best
            if len(some) <= max(4 * want, len(self.ids) // 64):
                break
        score = self.rows[some] @ query
        best = np.lexsort((self.ids[some], -score))[:want]
        return self.ids[some][best], score[best]


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by the inner product of floor(scale * x)."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"), is_query.alias("q")).where(finite(F.col("v")) & F.col("vec_id").isNotNull())
    rows = common.cut(rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), "q", F.size("v").alias("dims")), "integers")
    n, nq = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = max(1, -(-n // INDEX_ROWS)), max(1, -(-nq // QUERY_ROWS))
    # every block of rows meets every block of queries
    index = rows.select("dims", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), "vec_id", "v")
    # of different vectors of one query id the least is asked for
    once = rows.where("q").groupBy("vec_id").agg(F.min(F.struct("dims", "v")).alias("least")).select("vec_id", "least.dims", "least.v")
    asked = once.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("part"), "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            block, queries = ImpactIndex(left.column("vec_id").to_numpy(), matrix(left)), matrix(right)
            for own, query in zip(right.column("vec_id").to_pylist(), queries, strict=True):
                ids, scores = block.top(query, own, k)
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    keys = ["dims", "block", "part"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


# ---- operator 10: spherical k-means cells

#: Vectors that the cells are fitted on at most, taken in the order of a hash; all are then indexed.
FIT_ROWS = 20_000
#: Vectors a cell should hold, and the most cells there are (so the centres' size is bounded).
CELL_ROWS, MOST_CELLS = 256, 4096
#: Each vector stands in its nearest cells, so many of them.
PROBES = 6
ROUNDS = 8
#: A tile part holds so many vectors.
PART = 1024
#: Pairs of parts in an Arrow batch.
TILE_ROWS = 16


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres of length 1."""
    unit = _unit(sample)
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:cells]].copy()
    for _ in range(rounds):
        near = np.concatenate([(unit[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        moved = np.linalg.norm(sums, axis=1) > 1e-9
        centres[moved] = _unit(sums[moved])
    return centres


def _assign(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            cells = np.zeros((len(lists), probes), np.int32)
            fits = dims == centres.shape[1]
            if fits.any() and len(centres):
                x = np.stack([np.asarray(v.as_py(), np.float64) for v, ok in zip(lists, fits, strict=True) if ok])
                near = _unit(x) @ centres.T
                p = min(probes, len(centres))
                best = np.sort(np.argpartition(-near, p - 1, axis=1)[:, :p], axis=1)
                cells[fits, :p] = best
                cells[fits, p:] = best[:, -1:]
            arrays = [batch.column("id"), batch.column("m"), lists, pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), probes).cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "m", "v", "cells"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component under the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, i, j, rows in zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j")), batch.column("rows"), strict=True):
                values = rows.values
                part = values.field("part").to_numpy()
                order = np.lexsort((values.field("id").to_numpy(), part))
                part, ids, m = part[order], values.field("id").to_numpy()[order], values.field("m").to_numpy()[order]
                unit = _unit(values.field("v").flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)[order])
                cells = values.field("cells").flatten().to_numpy().reshape(len(ids), -1)[order]
                ones, others = np.flatnonzero(part == i), np.flatnonzero(part == j)
                if not len(ones) or not len(others):
                    continue
                links = np.zeros(len(ids), np.int64)
                pairs: list[np.ndarray] = []
                for k in range(0, len(ones), 256):
                    x, y = np.nonzero(unit[ones[k : k + 256]] @ unit[others].T >= threshold)
                    x, y = ones[k : k + 256][x], others[y]
                    if i == j:
                        x, y = x[x < y], y[x < y]
                    # a pair counts in the first of its common cells
                    same = cells[x][:, :, None] == cells[y][:, None, :]
                    first = np.where(same, cells[x][:, :, None], np.iinfo(np.int32).max).min(axis=(1, 2)) if len(x) else np.zeros(0, int)
                    x, y = x[first == cell], y[first == cell]
                    np.add.at(links, x, m[y])
                    np.add.at(links, y, m[x])
                    # within the part the pairs' components are enough
                    pairs.append(np.stack([x, y]))
                    if sum(p.shape[1] for p in pairs) > 1_000_000:
                        pairs = [_tree(len(ids), pairs)]
                root = _roots(len(ids), *np.concatenate(pairs, axis=1))
                has = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has]), pa.array(ids[root[has]])], names=["id", "links", "root"])

    return run


def _tree(n: int, pairs: list[np.ndarray]) -> np.ndarray:
    root = _roots(n, *np.concatenate(pairs, axis=1))
    return np.stack([np.arange(n), root])[:, root != np.arange(n)]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: cosine links within cells, one vector kept of each component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    usable = finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit("second"), "v")))
    # equal vectors are one class; m counts them
    classes = common.cut(rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.min_by("v", "vec_id").alias("v")), "vectors")
    n = classes.count()
    sizes = classes.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = sizes[0].dims if sizes else 1
    cells = max(1, min(MOST_CELLS, n // CELL_ROWS))
    sample = classes.where(F.size("v") == dims).orderBy(F.xxhash64("id")).limit(FIT_ROWS).select("v").toPandas()
    centres = spherical_kmeans(np.array(sample.v.tolist(), np.float64).reshape(len(sample), -1), min(cells, len(sample))) if len(sample) else np.zeros((0, dims))
    placed = common.cut(classes.select("id", "m", "v").mapInArrow(_assign(centres, probes), "id long, m long, v array<double>, cells array<int>"), "placed")
    in_cells = placed.withColumn("cell", F.explode(F.array_distinct("cells"))).withColumn("dims", F.size("v"))
    counts = in_cells.groupBy("dims", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = in_cells.join(counts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    spread = dealt.withColumn("meet", F.explode(meets)).select("dims", "cell", "meet.i", "meet.j", F.struct("part", "id", "m", "v", "cells").alias("row"))
    tiles = spread.groupBy("dims", "cell", "i", "j").agg(F.collect_list("row").alias("rows"))
    found = common.cut(tiles.select("cell", "i", "j", "rows").mapInArrow(_compare(threshold), "id long, links long, root long"), "vector-links", TILE_ROWS)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.select("h1", "h2", "id", "m").join(links, "id", "left").join(roots, "id", "left")
    of_class = of_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = rows.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))
