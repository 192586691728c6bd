"""Operator 11, exact dedup by counting quotient filters.

Each text has a fingerprint, the first BITS bits of its SHA-256. Every task of the scan builds one
counting quotient filter over the fingerprints it meets: the high bits of a fingerprint, its
quotient, are one bit in `occupied`; the low bits, its remainder, stand sorted within the quotient's
run, whose last slot has a bit in `runend`; slots that were met more than once have a bit in `many`
and their count in a list beside. Quotient and remainder together are the fingerprint, so a filter
loses nothing. Filters are cut into slices by the first bits of the fingerprint; slices of all
tasks meet by number and are merged by their sorted remainders, counts added up. A fingerprint, however
often it is met, is one slot of each task's filter, so hot texts do not meet in one task.

Fingerprints with a count above one go on to the bytes: their texts, and those alone but for what a
bitmap of fixed size lets through, are grouped by their whole bytes, each task's copies being one row
before they move. A fingerprint that turns out to stand for one text names its group from then on;
rows of a fingerprint that stands for several texts are grouped by the bytes again.

Null texts count as empty. Of equal texts the row with the largest doc_id stays (a null doc_id is
the smallest), and of rows that repeat both, one. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of a fingerprint; at most 60, so that it fits in fifteen hex digits.
BITS = 60
#: Rows that a slice should hold; the number of slices grows with the table.
SLICE_ROWS = 1 << 20
#: Fingerprints that a task gathers before it writes its filter out.
FLUSH = 1 << 21
#: Bits of the bitmap that keeps most texts met once from moving; when it fills up more texts move, and results stay.
SIEVE_LOG2 = 23

_U = np.uint64


def encode(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of sorted, different fingerprints below 2**bits, and how often each was met."""
    q = min(bits, max(3, int(len(values)).bit_length()))
    r = bits - q
    quotient, width = (values >> _U(r)).astype(np.int64), (r + 7) // 8
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    runend = np.append(quotient[1:] != quotient[:-1], True) if len(values) else np.zeros(0, bool)
    remainder = (values & _U((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    many = counts > 1
    head = np.array([bits, q, len(values), int(many.sum())], "<i8")
    return b"".join(x.tobytes() for x in (head, np.packbits(occupied), np.packbits(runend), np.packbits(many), remainder, counts[many].astype("<i8")))


def decode(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter, sorted, and their counts."""
    bits, q, n, several = (int(x) for x in np.frombuffer(packed, "<i8", 4))
    r = bits - q
    width, at = (r + 7) // 8, 32

    def flags(size: int) -> np.ndarray:
        nonlocal at
        raw = np.frombuffer(packed, np.uint8, (size + 7) // 8, at)
        at += len(raw)
        return np.unpackbits(raw, count=size).astype(bool)

    occupied, runend, many = flags(1 << q), flags(n), flags(n)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(packed, np.uint8, n * width, at).reshape(n, width)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(packed, "<i8", several, at + n * width)
    ends = np.flatnonzero(runend) + 1
    quotient = np.repeat(np.flatnonzero(occupied).astype(_U), np.diff(ends, prepend=0))
    return quotient << _U(r) | raw.view("<u8").ravel().astype(_U), counts


def merge(filters: list[bytes], bits: int) -> bytes:
    """One filter for what several hold: sorted by remainder within quotient, counts of equal fingerprints added up."""
    values, counts = (np.concatenate(x) for x in zip(*map(decode, filters), strict=True))
    order = np.argsort(values, kind="stable")  # merges runs that are sorted already
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return encode(values[first], np.add.reduceat(counts, first) if len(first) else counts, bits)


def _filters(bits: int, log2: int):
    """One filter a slice for what a task has met; the slice's own bits are left out of its fingerprints."""
    own = bits - log2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = np.searchsorted(values, np.arange((1 << log2) + 1, dtype=_U) << _U(own))
            for k in np.flatnonzero(np.diff(cuts)):
                i, j = cuts[k], cuts[k + 1]
                packed = encode(values[i:j] & _U((1 << own) - 1), counts[i:j], own)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed], pa.binary())], names=["slice", "packed"])

        for batch in batches:
            held.append(batch.column("print").to_numpy().view(_U))
            if sum(map(len, held)) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def _merged(own: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        packed = merge([x.as_py() for x in table.column("packed")], own)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([packed], pa.binary())})

    return run


def quotient_filter(prints: DataFrame, rows: int, bits: int = BITS) -> tuple[DataFrame, int]:
    """(slice, packed) of the merged filter over the column `print`, and the bits that tell its slices apart; rows: how many there are."""
    log2 = min(bits - 1, max(2, (rows // SLICE_ROWS).bit_length()))
    parts = prints.select("print").mapInArrow(common.tidied(_filters(bits, log2)), "slice long, packed binary")
    return common.cut(parts.groupBy("slice").applyInArrow(_merged(bits - log2), "slice long, packed binary"), "quotient-filter", 4), bits - log2


def repeated(slices: DataFrame, own: int) -> DataFrame:
    """print and n of the fingerprints that a merged filter has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("packed"), strict=True):
                values, counts = decode(packed.as_py())
                several = counts > 1
                found = values[several] | _U(k) << _U(own)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts[several])], names=["print", "n"])

    return slices.mapInArrow(common.tidied(run), "print long, n long")


def _place(prints: np.ndarray) -> np.ndarray:
    return (prints.view(_U) * _U(0x9E3779B97F4A7C15) >> _U(64 - SIEVE_LOG2)).astype(np.int64)


def _sieve(prints: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the column `print`; what it does not hold is surely not among the rows."""
    size = 1 << (SIEVE_LOG2 - 3)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(size, np.uint8)
        for batch in batches:
            bit = _place(batch.column("print").to_numpy())
            np.bitwise_or.at(flags, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
        for k in range(0, size, 1 << 16):
            if flags[k : k + (1 << 16)].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([flags[k : k + (1 << 16)].tobytes()], pa.binary())], names=["k", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("k").to_pylist(), batch.column("part"), strict=True):
                parts[k] = parts.get(k, np.uint8(0)) | np.frombuffer(part.as_py(), np.uint8)
        for k, v in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["k", "part"])

    out = np.zeros(size, np.uint8)
    for row in prints.select("print").mapInArrow(mark, "k long, part binary").repartition(16, "k").mapInArrow(join, "k long, part binary").collect():
        out[row.k : row.k + len(row.part)] = np.frombuffer(row.part, np.uint8)
    return out


def _passing(sieve: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _place(batch.column("print").to_numpy())
            yield batch.filter(pa.array((sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    spark = docs.sparkSession
    named = common.columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("text", F.coalesce("text", F.lit("")))
    sha = F.sha2("text", 256)
    mark = F.shiftrightunsigned(F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"), BITS - bits)
    prints = common.cut(named.select("doc_id", sha.alias("sha")).select("doc_id", "sha", mark.alias("print"), F.monotonically_increasing_id().alias("row")), "prints")
    slices, own = quotient_filter(prints, prints.count(), bits)
    several = common.cut(repeated(slices, own), "repeated")
    texts = named.select(sha.alias("sha"), "doc_id", "text").select(mark.alias("print"), "doc_id", "text")

    def texts_of(some: DataFrame) -> DataFrame:
        return texts.mapInArrow(common.tidied(_passing(_sieve(some))), "print long, doc_id long, text string")

    # the bytes themselves: copies are one row a task before they move
    bodies = texts_of(several).groupBy("print", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    with common.arrow_rows(spark, common.TEXT_ROWS):
        bodies = common.cut(bodies.groupBy("print").agg(F.count("*").alias("texts"), F.sum("n").alias("group_size"), F.max("keep_id").alias("keep_id")).where("group_size > 1"), "bodies")
    torn = bodies.where("texts > 1").select("print")
    # rows that repeat both text and doc_id: the first of them stands for all
    twice = prints.groupBy("print", "doc_id").agg(F.count("*").alias("n"), F.min("row").alias("first_row")).where("n > 1").select("print", "doc_id", "first_row")
    whole = prints.join(torn, "print", "left_anti").join(bodies.where("texts = 1").select("print", "group_size", "keep_id"), "print", "left")
    whole = whole.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    again = twice.select(F.col("print").alias("p"), F.col("doc_id").alias("d"), "first_row")
    whole = whole.join(again, (F.col("print") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.coalesce("first_row", "row") == F.col("row"))
    out = whole.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
    if torn.isEmpty():
        return out
    # fingerprints that stand for several texts: grouped by the bytes
    apart = common.cut(texts_of(torn).join(torn, "print", "left_semi").groupBy("text", "doc_id").agg(F.count("*").alias("m")), "torn", common.TEXT_ROWS)
    groups = apart.groupBy("text").agg(F.sum("m").alias("group_size"), F.max("doc_id").alias("keep_id"))
    each = apart.join(groups, "text").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.unionByName(each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), sha.alias("text_sha256")))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(common.read(spark, sf_dir, "documents"))


OP11_SQL = """with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256
from t window w as (partition by text)"""
