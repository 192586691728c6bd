"""Operator 6, packing by cutting-stock column generation.

A document's ids are cut into full pieces of SEQUENCE tokens and a rest. Lengths are counted in a
histogram of SEQUENCE / GRAIN classes (a fixed size, whatever the input). The driver solves the
linear program over filling patterns of that histogram: a knapsack dynamic programme prices new
patterns until none improves the relaxation. Patterns are rounded down, what is left is filled
greedily, and the pieces of each class, ranked by salt and doc_id, take the patterns' places in turn.

Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no
rows; other columns are ignored. Ranks are made within (class, salt) and a class's salts grow with
its size, so a length that most documents have is spread over many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, vocabulary_path

SEQUENCE = 2048
#: Lengths are counted in steps of so many tokens, rounded up.
GRAIN = 8
END_ID = 1
#: Column generation ends when the relaxation is proven to be within this of its optimum.
GAP = 0.001
#: Pieces of a class that one salt should hold.
SALT_ROWS = 4_000


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit) of every piece."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).ids
        for batch in batches:
            ids, start, total, out = [], [], [], []
            for key, raw in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, sequence):
                    ids.append(key)
                    start.append(at)
                    total.append(n)
                    out.append(raw[4 * at : 4 * (at + sequence)])
            arrays = [pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(total, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    found = common.columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return common.cut(found, "pieces", common.TEXT_ROWS)


def price(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern (copies of each size, at most counts) of largest value that fits: a knapsack by dynamic programming over binary lots of copies."""
    best = np.zeros(capacity + 1)
    lots: list[tuple[int, int, np.ndarray]] = []
    for k in np.flatnonzero(values > 1e-12):
        size, copies, lot = int(sizes[k]), min(int(counts[k]), capacity // int(sizes[k])), 1
        while copies > 0:
            n = min(lot, copies)
            w = n * size
            with_lot = best[: capacity + 1 - w] + n * values[k]
            better = np.zeros(capacity + 1, bool)
            better[w:] = with_lot > best[w:] + 1e-12
            best[w:] = np.where(better[w:], with_lot, best[w:])
            lots.append((int(k), n, better))
            copies, lot = copies - n, lot * 2
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    for k, n, better in reversed(lots):
        if better[c]:
            pattern[k] += n
            c -= n * int(sizes[k])
    return pattern


def patterns(counts: dict[int, int], capacity: int, most_rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Filling patterns (size -> copies) and how often each is used; together they hold each size exactly counts times.

    Column generation with the revised simplex method on min sum(x), A x = counts, x >= 0.
    """
    sizes = np.array(sorted(s for s, n in counts.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    demand = np.array([counts[int(s)] for s in sizes], np.int64)
    m = len(sizes)
    basis = np.diag(np.minimum(capacity // sizes, demand)).astype(float)  # one pattern a size to start with
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    for _ in range(most_rounds):
        dual = inverse.sum(axis=0)
        new = price(np.maximum(dual, 0), sizes, demand, capacity)
        # the relaxation's optimum is at least its value now / the best price, and at least what fills every sequence
        if dual @ new <= 1 + GAP or x.sum() <= (1 + GAP) * (sizes @ demand) / capacity:
            break
        step = inverse @ new
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        basis[:, out] = new
    left = demand.copy()
    found: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-x, kind="stable"):
        column = basis[:, k].astype(np.int64)
        has = column > 0
        times = min(int(np.floor(max(x[k], 0) + 1e-6)), int((left[has] // column[has]).min()))
        if times > 0:
            found.append((column, times))
            left = left - column * times
    while left.any():  # what rounding left over: the largest that fits, again and again
        column, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            take = min(int(left[k]), room // int(sizes[k]))
            column[k], room = take, room - take * int(sizes[k])
        has = column > 0
        times = int((left[has] // column[has]).min())
        found.append((column, times))
        left = left - column * times
    return [({int(sizes[k]): int(c[k]) for k in np.flatnonzero(c)}, n) for c, n in found]


def place(found: DataFrame, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """found (pieces, with any further columns) with sequence_id and offset."""
    size = F.floor((F.col("length") + grain - 1) / grain).cast("long")
    sized = found.withColumn("size", size)
    counts = {r["size"]: r["count"] for r in sized.groupBy("size").count().collect()}  # sequence / grain rows at most
    # for each size the runs of ranks that a pattern takes: first rank, copies a sequence, first sequence, slot
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in patterns(counts, sequence // grain):
        slot = 0
        for s in sorted(pattern, reverse=True):
            runs.setdefault(s, []).append((taken.get(s, 0), pattern[s], base, slot))
            taken[s] = taken.get(s, 0) + pattern[s] * times
            slot += pattern[s]
        base += times
    tables = {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}

    salts = F.lit(1)
    for s, n in counts.items():
        if n > SALT_ROWS:
            salts = F.when(F.col("size") == s, -(-n // SALT_ROWS)).otherwise(salts)
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), salts).cast("int"))
    per_salt = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # total but for rows that are equal in all of this
    told = [c for c in ("ids_crc32", "ids") if c in found.columns]
    own = F.row_number().over(Window.partitionBy("size", "salt").orderBy(F.asc_nulls_first("doc_id"), "start", "length", "doc_tokens", *told))
    ranked = salted.withColumn("rank", own).join(offsets, ["size", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("first")).drop("salt", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            seq, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                mine = size == s
                first, copies, start, at = tables[int(s)]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                into = rank[mine] - first[k]
                seq[mine], slot[mine] = start[k] + into // copies[k], at[k] + into % copies[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(slot)], names=[*batch.schema.names, "sequence_id", "slot"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    put = ranked.mapInArrow(run, f"{columns}, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("size", "rank", "slot")


def sequences(found: DataFrame, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids and ids of their pieces in order."""
    put = place(found, sequence, grain).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return put.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def packed(docs: DataFrame) -> DataFrame:
    """Every piece of docs with its place; ids_crc32 is made from the stored ids."""
    found = pieces(docs, vocabulary_path("byte_bpe_50k.json"))
    return place(found.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.read(spark, sf_dir, "documents"))
