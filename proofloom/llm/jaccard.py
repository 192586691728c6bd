"""Operator 7, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set is the hashes of its different word shingles. Documents with the same set are one
class, named by the smallest doc_id whose shingles were dealt out. Only classes that can have a link
go on, and that is proven, not guessed:

- Each class deals out its first ceil(p n) shingles in one order of all shingles, where p is the
  dissimilarity allowed plus SPARE. Whoever reaches the similarity shares at least ceil(SPARE n) of
  them, so a class of which fewer stand in another class as well has no link and leaves (`peeled`).
- What stays of a class is ordered by how many classes have it, rarest first; all but SPARE n - 1 of
  them, the first ones, open tiles. Linked classes meet in a tile, in the same or in neighbouring
  size bands, and what is still to come after the shingle bounds what they share.
- When most links are found, classes of tiles that are still open are held against other components
  by their whole sets in the same way (`foreign`): who has too little in common with them leaves.

Within a tile sizes and bit counts of bitmap signatures bound the overlap from above, and what passes
is decided by exact intersection of sorted arrays. Tiles are first joined through representatives,
several times by different ones; only pairs of a tile that are still in different components are
then compared. So a group of thousands of near copies costs a few comparisons a copy, and no link
between components is lost.

Null texts and texts without words have an empty set and link with nothing; texts with fewer words
than a shingle are one shingle; repeated rows of a doc_id are in one component; an empty table gives
no rows; a null doc_id links with nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words
from .components import components

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
#: Percent of a set that is dealt out beyond the dissimilarity allowed: similar sets share so much of it.
SPARE = 10
#: Least bits of a bitmap signature; larger sets have at least four bits a member.
LEAST_BITS = 256
#: A tile part holds so many classes at most.
TILE = 256
#: Representatives of a tile and size band in each round that joins tiles before pairs are compared.
STARS = (1, 8, 64)
#: Postings that a bucket should hold, and that a task holds before it packs them.
BUCKET, FLUSH = 100_000, 1_000_000
#: Bytes of keys of a bucket's part.
PART_BYTES = 5_000_000
#: Bytes of text for each posting, about; it decides the number of buckets alone.
POSTING_BYTES = 20
#: Bits of the bitmap that tells in advance which documents' texts are not needed.
WANTED_LOG2 = 23
#: Rows in an Arrow batch of packed postings, and of pairs of sets.
PACKED_ROWS, PAIR_ROWS = 200, 500

_U = np.uint64


def _sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of rows, and row offsets."""
    low = words.lower_table()[data]
    starts, ends, first = words.word_spans(low, at, words.space_separators())
    value, owner = words.shingle_hashes(words.span_hashes(low, starts, ends), first, size)
    return words.distinct_by_row(value, owner, len(at) - 1)


def _nodes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set; equal sets are one node."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(words.mix(values + _U(0x9E3779B97F4A7C15)), out=total[1:])
    return words.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(_U)).view(np.int64)


def _signatures(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Bitmap signatures of rows: a bit for each member's hash, in a power of two of bits."""
    n = np.diff(at)
    width = np.maximum(LEAST_BITS, 4 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(n)), n)
    flags = np.zeros(start[-1], bool)
    flags[start[owner] + (words.mix(values) & (width[owner] - 1).astype(_U)).astype(np.int64)] = True
    raw = np.packbits(flags, bitorder="little").tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(start[:-1], start[1:], strict=True)]


def _fold(marks: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis, 64-bit words) narrowed to size words."""
    while marks.shape[-1] > size:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] | marks[..., half:]
    return marks


def dealt_length(n, percent: int):
    """Members of a set of n that are dealt out."""
    return (n * min(100, 100 - percent + SPARE) + 99) // 100


def _five(values: np.ndarray) -> bytes:
    """The last 40 bits of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that sorts by bucket, and (bucket, from, to) in it."""
    order = np.argsort(bucket, kind="stable")
    there = bucket[order]
    starts = np.flatnonzero(np.diff(there, prepend=-1))
    return order, list(zip(there[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(there)], strict=True))


_FIRST = "doc_id long, n long, node long, node2 long, dealt boolean, bucket long, keys binary, docs binary"


def _first_pass(size: int, percent: int, buckets: int):
    """Rows of two kinds: each document's size and class; and packed postings of dealt shingles by bucket, 40 bits of a shingle and the doc_id of each.

    Within a task one document of a class deals; the others have `dealt` false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held, seen = 0, set()
        press = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, runs = _by_bucket(((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64))
            key, doc = key[order], doc[order]
            # documents stand in the order they were read, so their differences are short
            docs = [press.compress(np.diff(doc[a:b], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()) for _, a, b in runs]
            none = pa.nulls(len(runs), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(runs), pa.bool_()), pa.array([k for k, _, _ in runs], pa.int64()), pa.array([_five(key[a:b]) for _, a, b in runs], pa.binary()), pa.array(docs, pa.binary())], names=names)

        names = [c.split()[0] for c in _FIRST.split(", ")]
        for batch in batches:
            data, at = common.string_buffers(batch.column("text"))
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            doc_ids = batch.column("doc_id").fill_null(0).to_numpy()
            n, node, node2, dealt = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
            for i, j in common.chunks(at):
                value, rows_at = _sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                n[i:j] = np.diff(rows_at)
                node[i:j], node2[i:j] = _nodes(value, rows_at), _nodes(value ^ _U(0x5851F42D4C957F2D), rows_at)
                for k in range(i, j):
                    if known[k] and n[k] and (name := (int(node[k]), int(node2[k]))) not in seen:
                        seen.add(name)
                        dealt[k] = True
                owner = np.repeat(np.arange(j - i), n[i:j])
                place = np.arange(len(value)) - rows_at[owner]
                first = dealt[i:j][owner] & (place < dealt_length(n[i:j], percent)[owner])
                held.append((words.mix(value[first]), doc_ids[i:j][owner[first]]))
                n_held += int(first.sum())
                if n_held >= FLUSH:
                    yield flush()
                    n_held = 0
            nothing = [pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(node), pa.array(node2), pa.array(dealt), *nothing], names=names)
        if n_held:
            yield flush()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket the different keys of a task's postings: those that it holds once, and those it holds several times."""
    held: dict[int, list[np.ndarray]] = {}
    n_held = 0

    def flush() -> pa.RecordBatch:
        once, more = [], []
        for some in held.values():
            keys, count = np.unique(np.concatenate(some), return_counts=True)
            once.append(_five(keys[count == 1]))
            more.append(_five(keys[count > 1]))
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["bucket", "once", "more"])
        held.clear()
        return out

    for batch in batches:
        for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys"), strict=True):
            held.setdefault(bucket, []).append(_wide(keys.as_py()))
            n_held += len(held[bucket][-1])
        if n_held >= FLUSH:
            yield flush()
            n_held = 0
    if held:
        yield flush()


def _several(key: tuple, table: pa.Table) -> pa.Table:
    """The keys of a bucket that stand in several documents; each task sends a key once, so no key is hot here."""
    once = np.sort(np.concatenate([_wide(x.as_py()) for x in table.column("once")]))
    more = np.concatenate([_wide(x.as_py()) for x in table.column("more")])
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "several": pa.array([_five(np.union1d(once[1:][once[1:] == once[:-1]], more))], pa.binary())})


def _kept(postings: pa.Table, table: pa.Table) -> pa.Table:
    """(shingle, doc_id) of a bucket's postings whose key several documents have."""
    press, keys, docs = zstandard.ZstdDecompressor(), [], []
    if postings.num_rows and table.num_rows:
        bucket, wanted = table.column("of_bucket")[0].as_py(), _wide(table.column("several")[0].as_py())
        for packed, held in zip(postings.column("keys"), postings.column("docs"), strict=True) if len(wanted) else ():
            key = _wide(packed.as_py())
            hit = np.flatnonzero(np.isin(key, wanted, kind="sort"))
            doc = np.cumsum(np.frombuffer(press.decompress(held.as_py()), np.uint8).reshape(8, len(key)).T.copy().view("<i8").ravel())
            keys.append((key[hit] | _U(bucket << 40)).view(np.int64))
            docs.append(doc[hit])
    return pa.table({"shingle": pa.array(np.concatenate(keys) if keys else [], pa.int64()), "doc_id": pa.array(np.concatenate(docs) if docs else [], pa.int64())})


def shared_postings(postings: DataFrame, several: DataFrame) -> DataFrame:
    """(shingle, doc_id) of the postings whose keys stand in `several`: a bucket's keys travel once, or once for each part of PART_BYTES where a hot shingle makes a bucket large."""
    sizes = postings.groupBy("bucket").agg(F.sum(F.octet_length("keys")).alias("bytes"))
    of = several.join(sizes, "bucket").select("bucket", "several", F.ceil(F.col("bytes") / PART_BYTES).cast("int").alias("parts"))
    of = common.cut(of, "bucket-parts")
    hot = of.where("parts > 1").select(F.col("bucket").alias("hot"), "parts")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("docs"), F.col("parts"))).cast("int")
    dealt = postings.join(hot, F.col("bucket") == F.col("hot"), "left").select("bucket", part.alias("part"), "keys", "docs")
    each = of.select(F.col("bucket").alias("of_bucket"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("parts") - 1))).alias("of_part"), "several")
    return dealt.groupBy("bucket", "part").cogroup(each.groupBy("of_bucket", "of_part")).applyInArrow(_kept, "shingle long, doc_id long")


def peeled(postings: DataFrame, percent: int) -> DataFrame:
    """shingle, id, n, left: what classes that may have links open tiles with, rarest shingles first.

    postings: shingle, id, n. A class leaves when others have fewer of its shingles than a link needs,
    once before and once after the shingles of classes that left are taken out; `left` tells how many
    shared shingles a class has from this one on.

    Of sets of n and m members with p n and p m dealt out, the one with the lower last shingle shares
    all its dealt members but those that the other lacks, n less the overlap: p n - n + t (n + m) / (1 + t)
    or the same for m. Over all m from t n to n / t that is (p - 1 + t) n at least, the number needed.
    """
    own = Window.partitionBy("id")
    needed = F.ceil(F.col("n") * (min(100, 100 - percent + SPARE) - 100 + percent) / 100)
    some = common.cut(postings.withColumn("have", F.count("*").over(own)).where(F.col("have") >= needed).drop("have"), "peeled")
    several = some.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1")
    again = some.join(common.cut(several, "several"), "shingle").withColumn("have", F.count("*").over(own)).where(F.col("have") >= needed)
    place = F.row_number().over(own.orderBy("classes", "shingle")) - 1
    again = again.withColumn("place", place).where(F.col("place") <= F.col("have") - needed)
    return again.select("shingle", "id", "n", (F.col("have") - F.col("place")).alias("left"))


def _bit(ids: np.ndarray) -> np.ndarray:
    return (words.mix(ids.view(_U)) >> _U(64 - WANTED_LOG2)).astype(np.int64)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**WANTED_LOG2 bits that every id of the one-column frame hits: a filter of fixed size, before an exact one."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << (WANTED_LOG2 - 3), np.uint8)
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy())
            np.bitwise_or.at(flags, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
        step = 1 << (WANTED_LOG2 - 7)
        for k in range(0, len(flags), step):
            if flags[k : k + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([flags[k : k + step].tobytes()], pa.binary())], names=["k", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("k").to_pylist(), batch.column("part"), strict=True):
                parts[k] = parts.get(k, np.uint8(0)) | np.frombuffer(part.as_py(), np.uint8)
        for k, v in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["k", "part"])

    out = np.zeros(1 << (WANTED_LOG2 - 3), np.uint8)
    for row in ids.mapInArrow(mark, "k long, part binary").repartition(16, "k").mapInArrow(join, "k long, part binary").collect():
        out[row.k : row.k + len(row.part)] = np.frombuffer(row.part, np.uint8)
    return out


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) whose doc_id is one of ids (doc_id): most others fall to a bitmap before the join shuffles any text."""
    wanted = id_bitmap(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(batch.column("doc_id").to_numpy())
            yield batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))

    return texts.mapInArrow(run, "doc_id long, text string").join(ids, "doc_id", "left_semi")


def _described(size: int):
    """id, n, marks (the bitmap signature) and members (the sorted set) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.string_buffers(batch.column("text"))
            for i, j in common.chunks(at):
                values, rows_at = _sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                raw = values.tobytes()
                members = [raw[8 * a : 8 * b] for a, b in zip(rows_at[:-1], rows_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(rows_at).astype(np.int64)), pa.array(_signatures(values, rows_at), pa.binary()), pa.array(members, pa.binary())], names=["id", "n", "marks", "members"])

    return run


def overlap_reaches(a: bytes, b: bytes, percent: int) -> bool:
    """Whether the sets (sorted unsigned 64-bit arrays) reach the similarity, by exact intersection."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _bound_reaches(n1: int, n2: int, m1: bytes, m2: bytes, percent: int) -> bool:
    """Whether the bitmaps leave room for the similarity: a bit that only one set has stands for at least one member that the other lacks."""
    x, y = np.frombuffer(m1, _U), np.frombuffer(m2, _U)
    x, y = _fold(x, min(len(x), len(y))), _fold(y, min(len(x), len(y)))
    only1, only2 = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    both = min(n1 - only1, n2 - only2)
    return 100 * both >= percent * (n1 + n2 - both)


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("n1").to_pylist(), batch.column("n2").to_pylist(), batch.column("m1"), batch.column("m2"), strict=True)
            kept = batch.filter(pa.array([_bound_reaches(n1, n2, m1.as_py(), m2.as_py(), percent) for n1, n2, m1, m2 in rows], pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2 = batch.column("s1"), batch.column("s2")
            kept = batch.filter(pa.array([overlap_reaches(s1[k].as_py(), s2[k].as_py(), percent) for k in range(len(batch))], pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return run


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sizes and bitmaps leave room for the similarity and whose exact intersection reaches it."""
    end = lambda e, k, what, to: sets.select(F.col("id").alias(e), F.col("n").alias(f"n{k}"), F.col(what).alias(f"{to}{k}"))
    room = pairs.join(end("a", 1, "marks", "m"), "a").join(end("b", 2, "marks", "m"), "b").select("a", "b", "n1", "n2", "m1", "m2").mapInArrow(common.tidied(_bounded(percent)), "a long, b long")
    room = common.cut(room.distinct(), "pairs", PAIR_ROWS)
    exact = room.join(end("a", 1, "members", "s").drop("n1"), "a").join(end("b", 2, "members", "s").drop("n2"), "b").select("a", "b", "s1", "s2").mapInArrow(common.tidied(_exact(percent)), "a long, b long")
    return common.cut(exact.distinct(), "links", PAIR_ROWS)


def _band(n, percent: int) -> F.Column:
    """Size bands whose bounds grow by the similarity: sets that can link stand in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent))).cast("int")


def _feasible(n1, n2, left1, left2, percent: int, dealt: int):
    """Whether sets of these sizes can reach the similarity if this is the first shingle they share: what both still have must hold what they share at least of the dealt percent of each."""
    lacking = lambda n: F.ceil(n * dealt / 100) - n
    least = F.least(lacking(n1), lacking(n2)) + F.ceil((n1 + n2) * percent / (100 + percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(left1, left2) >= least)


def _roots(ids: DataFrame, found: DataFrame) -> DataFrame:
    """ids (id, ...) with the component of each; alone where it has no link."""
    return ids.join(components(found), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, id, n, root) of all members of each set."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        columns = [np.repeat(batch.column(c).to_numpy(), n) for c in ("id", "n", "root")]
        values = np.frombuffer(b"".join(x.as_py() for x in batch.column("members")), "<i8")
        for k in range(0, len(values), 200_000):
            part = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(values[part]), *(pa.array(c[part]) for c in columns)], names=["shingle", "id", "n", "root"])


def foreign(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Tiles (shingle, id, n, left, root) of the classes that may still have a link to another component, from whole sets.

    A link out of a component takes t n shingles that other components have too; a class with fewer
    leaves, twice over, and all but t n - 1 of the rest, rarest first, open its tiles.
    """
    own = Window.partitionBy("id")
    needed = F.ceil(F.col("n") * percent / 100)
    held = labelled.select("id", "root").distinct().join(sets.select("id", "n", "members").dropDuplicates(["id", "n"]), "id").select("id", "n", "root", "members")
    rows = common.cut(held.mapInArrow(common.tidied(_members), "shingle long, id long, n long, root long"), "members", PAIR_ROWS)
    for _ in range(2):
        shared = rows.groupBy("shingle").agg(F.count("*").alias("classes"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle", "classes")
        kept = rows.drop("classes", "have").join(common.cut(shared, "shared"), "shingle").withColumn("have", F.count("*").over(own)).where(F.col("have") >= needed)
        rows = common.cut(kept, "foreign")
    place = F.row_number().over(own.orderBy("classes", "shingle")) - 1
    tiles = rows.withColumn("place", place).where(F.col("place") <= F.col("have") - needed)
    return common.cut(tiles.select("shingle", "id", "n", (F.col("have") - F.col("place")).alias("left"), "root"), "foreign-tiles")


def class_links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect whatever the tiles (shingle, id, n, left) hold of similar sets."""
    found = tried = None
    labelled, dealt = tiles.withColumn("root", F.col("id")), min(100, 100 - percent + SPARE)
    for turn, stars in enumerate(STARS):
        # representatives of a tile and size band: the least id, then others by a hash, so that tiles of one group have the same; they meet their own band and the next
        by = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        banded = labelled.withColumn("band", _band(F.col("n"), percent))
        heads = banded.withColumn("star", F.row_number().over(Window.partitionBy("shingle", "band").orderBy(by, "id"))).where(F.col("star") <= stars)
        meets = heads.select("shingle", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("left").alias("la"))
        pairs = banded.join(meets, ["shingle", "band"]).where((F.col("ra") != F.col("root")) & _feasible(F.col("na"), F.col("n"), F.col("la"), F.col("left"), percent, dealt))
        pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        pairs = common.cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "met")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = links(pairs, sets, percent)
        found = new if found is None else found.unionByName(new)
        # tiles within one component are done
        labelled = _roots(labelled.drop("root"), found).select("shingle", "id", "n", "left", "root")
        open_ = labelled.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle")
        labelled = common.cut(labelled.join(open_, "shingle", "left_semi"), "open")
        if turn == len(STARS) - 2:
            labelled, dealt = foreign(labelled, sets, percent), 100
        if labelled.isEmpty():
            return found
    # what is left: all pairs of open tiles in different components, in parts of TILE classes
    pairs = common.cut(_open_pairs(labelled, percent).join(tried, ["a", "b"], "left_anti"), "met")
    return found.unionByName(links(pairs, sets, percent))


def _open_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a tile in different components that can reach the similarity by their sizes and places in whole sets.

    A tile's classes are dealt into parts of about TILE; a part meets itself and the others, each pair
    of parts in one row, which holds five numbers a class. Bitmaps are joined to what passes.
    """
    counts = labelled.groupBy("shingle").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / TILE)).cast("int").alias("parts"))
    dealt = labelled.join(counts, "shingle").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    spread = dealt.withColumn("meet", F.explode(meets))
    columns = ["part", "id", "n", "left", "root"]
    tiles = spread.groupBy("shingle", F.col("meet.i").alias("i"), F.col("meet.j").alias("j")).agg(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in columns))).alias("rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            at = lists.offsets.to_numpy()
            part, ids, n, left, root = (lists.values.field(c).to_numpy() for c in columns)
            for i, j, a, b in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), at[:-1], at[1:], strict=True):
                ones, others = a + np.flatnonzero(part[a:b] == i), a + np.flatnonzero(part[a:b] == j)
                found = []
                for k in ones:
                    o = others[(root[others] != root[k]) & (np.minimum(n[others], n[k]) * 100 >= np.maximum(n[others], n[k]) * percent)]
                    o = o[np.minimum(left[o], left[k]) >= -(-(n[o] + n[k]) * percent // (100 + percent))]
                    o = o[o > k] if i == j else o
                    found.append(np.stack([np.minimum(ids[o], ids[k]), np.maximum(ids[o], ids[k])]))
                pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return common.cut(tiles.select("i", "j", "rows").mapInArrow(compare, "a long, b long").distinct(), "open-pairs", PACKED_ROWS)


def component_table(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    texts = common.columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, min(1 << 20, n_bytes // (POSTING_BYTES * BUCKET)))
    first = common.cut(texts.mapInArrow(common.tidied(_first_pass(size, percent, buckets)), _FIRST), "shingles", common.TEXT_ROWS)
    own = first.where("bucket is null").select("doc_id", "n", "node", "node2", "dealt")
    some = own.where("n > 0 and doc_id is not null")
    # classes of equal sets by two hashes; id is the smallest doc_id that dealt for it, first_doc the smallest of all
    classes = some.groupBy("node", "node2").agg(F.min(F.when(F.col("dealt"), F.col("doc_id"))).alias("id"), F.min("doc_id").alias("first_doc"), F.max("n").alias("n"))
    classes = common.cut(classes, "classes")

    postings = first.where("bucket is not null").select("bucket", "keys", "docs")
    counted = common.cut(postings.select("bucket", "keys").mapInArrow(common.tidied(_counted), "bucket long, once binary, more binary"), "counted", PACKED_ROWS)
    several = common.cut(counted.groupBy("bucket").applyInArrow(_several, "bucket long, several binary"), "several")
    shared = shared_postings(postings, several)
    by_class = shared.join(classes.select(F.col("id").alias("doc_id"), "n").distinct(), "doc_id").select("shingle", F.col("doc_id").alias("id"), "n")
    by_class = common.cut(by_class, "postings", PACKED_ROWS)
    common.release(docs.sparkSession)
    tiles = common.cut(peeled(by_class, percent), "tiles")
    common.release(docs.sparkSession)

    alive = texts_of(texts.where("doc_id is not null"), tiles.select(F.col("id").alias("doc_id")).distinct())
    sets = common.cut(alive.mapInArrow(common.tidied(_described(size)), "id long, n long, marks binary, members binary"), "sets", common.TEXT_ROWS)
    found = class_links(tiles, sets, percent)
    # rows of one doc_id are one document, whatever classes they are in
    named = some.select("doc_id", "node", "node2").join(classes, ["node", "node2"])
    same = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("a", "b")
    rooted = common.cut(_roots(classes, found.unionByName(same)).select("node", "node2", "first_doc", "root"), "roots")
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_class = rooted.join(least, "root").select("node", "node2", "component_id")
    keyed = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node")
    return own.select("doc_id", "n", keyed, "node2").join(of_class, ["node", "node2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_table(common.read(spark, sf_dir, "documents"))
