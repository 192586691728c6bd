"""Operator 1, token-ID output: one wavelet matrix a shard.

A shard holds the ids of consecutive documents as succinct bit planes, most significant bit
first; each plane keeps a rank directory, so that single tokens, counts and places of a token
are read from the compressed file without expanding it. Shards are rows of a Parquet table
(first_doc, n_docs, n_tokens, payload), which any shared store can hold.

Nulls and empty texts give the end id alone; a null doc_id sorts first and stays null; repeated
doc_ids stand one after another, ordered by text; an empty table gives no shard. Columns other
than the named ones are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Tokens after which a shard is closed; a document is never split between shards.
SHARD_TOKENS = 1 << 21
#: Shards whose offsets are sent to all executors (about 200 bytes each); those of more shards are joined by a shuffle.
FEW_SHARDS = 50_000
END_ID = 1
_MAGIC, _HEAD, _BLOCK = b"WVM1", struct.Struct("<4sIIQ"), 512
_SHARDS = "first_doc long, last_doc long, n_docs long, n_tokens long, payload binary"
_READ = "doc_id long, start long, n_tokens long, ids binary"


def pack(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, ends: np.ndarray) -> bytes:
    """The shard file: header, documents (id, known, end), then each plane's zeros, rank directory and bits."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    kind = np.uint16 if width <= 16 else np.uint32
    level = ids.astype(kind)
    parts = [_HEAD.pack(_MAGIC, width, len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), ends.astype("<u8").tobytes()]
    for shift in range(width - 1, -1, -1):
        bits = (level >> kind(shift)) & kind(1)
        ones = bits.astype(bool)
        zeros = level[~ones]
        packed = np.packbits(ones, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % (_BLOCK // 8), np.uint8)])
        blocks = np.bitwise_count(packed.view("<u8")).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        parts += [struct.pack("<QI", len(zeros), len(ranks)), ranks.tobytes(), packed.tobytes()]
        level = np.concatenate([zeros, level[ones]])
    return b"".join(parts)


class Shard:
    """Reads a shard file: access(i), count(token), occurrences(token), tokens()."""

    def __init__(self, payload: bytes):
        magic, self.width, n_docs, self.n = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        self.known = np.frombuffer(payload, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.ends = np.frombuffer(payload, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 17 * n_docs
        self.zeros, self.ranks, self.planes = [], [], []
        for _ in range(self.width):
            zeros, n_ranks = struct.unpack_from("<QI", payload, at)
            at += 12
            self.zeros.append(zeros)
            self.ranks.append(np.frombuffer(payload, "<u4", n_ranks, at))
            at += 4 * n_ranks
            size = (n_ranks - 1) * _BLOCK // 8
            self.planes.append(np.frombuffer(payload, np.uint8, size, at))
            at += size

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (i & 7) & 1

    def _rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        block = i // _BLOCK
        first = block * _BLOCK // 8
        inside = self.planes[plane][first : (i + 7) >> 3]
        total = int(self.ranks[plane][block]) + int(np.bitwise_count(inside).sum())
        if i & 7:
            total -= (int(self.planes[plane][i >> 3]) >> (i & 7)).bit_count()
        return total

    def _select(self, plane: int, one: bool, k: int) -> int:
        """Place of the k-th (from 0) one or zero."""
        ranks = self.ranks[plane].astype(np.int64)
        upto = ranks if one else np.arange(len(ranks)) * _BLOCK - ranks
        block = int(np.searchsorted(upto, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == one)[k - int(upto[block])])

    def access(self, i: int) -> int:
        """The token at place i."""
        value = 0
        for plane in range(self.width):
            bit = self._bit(plane, i)
            ones = self._rank(plane, i)
            value, i = value << 1 | bit, (self.zeros[plane] + ones if bit else i - ones)
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.width:
            return 0, 0
        for plane in range(self.width):
            a, b = self._rank(plane, lo), self._rank(plane, hi)
            lo, hi = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.width - 1 - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token stands at places lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """All places of the token, ascending."""
        lo, hi = self._range(token, 0, self.n)
        places = []
        for i in range(lo, hi):
            for plane in range(self.width - 1, -1, -1):
                one = bool(token >> (self.width - 1 - plane) & 1)
                i = self._select(plane, one, i - self.zeros[plane] if one else i)
            places.append(i)
        return places

    def tokens(self) -> np.ndarray:
        """All ids in order: levels are merged from the last plane up."""
        value = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for plane in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self.planes[plane], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(value)
            above[~ones] = value[: self.zeros[plane]]
            above[ones] = value[self.zeros[plane] :] | value.dtype.type(1 << (self.width - 1 - plane))
            value = above
        return value.astype("<u4")


def shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Wavelet shards of all documents in ascending id order, written to the shared folder."""
    end = struct.pack("<I", end_id)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).ids
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in ids])
            known = np.array([k is not None for k in keys])
            payload = pack(np.frombuffer(b"".join(ids), "<u4"), np.array([k or 0 for k in keys], np.int64), known, ends)
            row = {"first_doc": [keys[0]], "last_doc": [keys[-1]], "n_docs": [len(keys)], "n_tokens": [int(ends[-1])], "payload": [payload]}
            ids.clear()
            keys.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for key, one in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids.append(one + end)
                keys.append(key)
                held += len(one) // 4 + 1
                if held >= shard_tokens:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    ordered = common.columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.cut(ordered.mapInArrow(build, _SHARDS), "wavelet", common.TEXT_ROWS)


def documents(shard_table: DataFrame) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit) and the number of ids before it, read from the shard files."""
    before = F.sum("n_tokens").over(Window.orderBy(F.asc_nulls_first("first_doc"), F.asc_nulls_first("last_doc"), "shard").rowsBetween(Window.unboundedPreceding, -1))
    named = shard_table.withColumn("shard", F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))) if "payload" in shard_table.columns else shard_table
    # few small rows, one a shard: their running sum is made without the payloads
    starts = named.select("shard", "first_doc", "last_doc", "n_tokens").withColumn("base", F.coalesce(before, F.lit(0))).select("shard", "base")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                shard = Shard(payload.as_py())
                ids, first = shard.tokens(), np.concatenate([[0], shard.ends[:-1]])
                raw, n = ids.tobytes(), shard.ends - first
                for i in range(0, len(n), 2000):
                    some = slice(i, i + 2000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[some], mask=~shard.known[some]), pa.array(base + first[some]), pa.array(n[some]), pa.array([raw[4 * a : 4 * b] for a, b in zip(first[some], shard.ends[some], strict=True)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    few = named.select("shard").count() <= FEW_SHARDS
    return named.join(F.broadcast(starts) if few else starts, "shard").select("base", "payload").mapInArrow(unpack, _READ)


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids_crc32, from the shard files."""
    from .tokens import vocabulary_path

    table = shards(common.read(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return documents(table).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
