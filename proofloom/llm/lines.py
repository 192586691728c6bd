"""Operator 5, fuzzy line dedup.

Lines of at least MIN_WORDS words are normalised (A-Z lower-cased, digits to 0, ASCII punctuation
dropped). Equal normalised lines are one node. Two nodes are linked when the edit similarity of
their word sequences is at least SIMILARITY, and the search for such pairs is complete: d edits
spoil at most q * d runs of q words, so the first runs of both lines, as many as may be spoilt and
one more, in one order of all runs, have one in common (prefix filter). Long runs come first in that
order, as they are rare. Nodes that meet in a run are candidates when their lengths and the parities
of their word hashes allow d edits, which no linked pair fails. Of each connected group's
occurrences the first by (doc_id, line number) stays, all others are removed.

A bucket first gives a spanning forest of its candidate pairs; only where the edit similarity turns
one of those down are its other pairs compared, those left by wider parities of the words that count a
word's repeats too. Shorter lines are never touched. Null texts stay
null and empty ones empty; rows without doc_id are left as they are; repeated rows of one doc_id
share their lines and are changed alike; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .components import components

MIN_WORDS = 4
SIMILARITY = 0.8
#: Columns of 64 parities each.
SIDES = ["s0", "s1", "s2", "s3"]
#: Columns of 64 parities each of the words with their repeats, where groups are searched again.
BAGS = [f"w{k}" for k in range(16)]
#: Words of a run at most.
RUN = 4
#: Runs that a bucket of candidate search should hold.
BUCKET = 500_000
#: Runs that a task deals out together.
DEAL = 2_000_000
#: Bits of the bitmap that tells which lines' texts are needed.
WANTED_LOG2 = 23
#: Bytes of text for each run that is dealt out, about; it decides the number of buckets alone.
RUN_BYTES = 7
#: Rows in an Arrow batch of candidates, and of pairs of lines.
DEAL_ROWS, PAIR_ROWS = 50_000, 2_000
#: Lines of more words are compared one pair at a time, shorter ones in blocks.
LONG_LINE = 160

_U = np.uint64
# lower-cases A-Z, makes digits 0, keeps letters and bytes of non-ASCII characters; 32 elsewhere
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_NOT_WORD = _NORMAL == 32


def _line_offsets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of lines (the newline belongs to the line before), and each line's row and number within it."""
    breaks = np.flatnonzero(data == 10) + 1
    row_of_break = np.searchsorted(at, breaks - 1, side="right") - 1
    rows = len(at) - 1
    starts = np.concatenate([at[:-1], breaks])
    owner = np.concatenate([np.arange(rows), row_of_break])
    order = np.lexsort((np.concatenate([np.zeros(rows, np.int64), np.ones(len(breaks), np.int64)]), starts, owner))
    starts, owner = starts[order], owner[order]
    number = np.arange(len(owner)) - np.searchsorted(owner, np.arange(rows))[owner]
    return np.append(starts, at[-1]), owner, number


def _line_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each line's words in their order."""
    n = np.diff(first)
    place = np.arange(len(hashes)) - np.repeat(first[:-1] - first[0], n)
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(words.mix(hashes + place.astype(_U) * _U(0x9E3779B97F4A7C15)), out=total[1:])
    return words.mix(total[first[1:]] - total[first[:-1]] + n.astype(_U)).view(np.int64)


def _chunk_lines(batch: pa.RecordBatch, min_words: int) -> Iterator[tuple]:
    """For each chunk of texts: doc_id, number, hash and words of its lines of enough words, with all words' hashes and byte lengths and each line's first word."""
    data, at = common.string_buffers(batch.column("text"))
    ids = batch.column("doc_id").to_numpy()
    for i, j in common.chunks(at):
        part, part_at = data[at[i] : at[j]], at[i : j + 1] - at[i]
        lines, owner, number = _line_offsets(part, part_at)
        low = _NORMAL[part]
        starts, ends, first = words.word_spans(low, lines, _NOT_WORD)
        n = np.diff(first)
        use = np.flatnonzero(n >= min_words)
        if not len(use):
            continue
        hashes = words.span_hashes(low, starts, ends)
        yield ids[i:j][owner[use]], number[use], _line_keys(hashes, first)[use], n[use], hashes, ends - starts, first[use]


def least_words(n: np.ndarray, least: float) -> np.ndarray:
    """Words that stay at least between similar lines, the longer of which has n; n less these are the edits."""
    return np.ceil(least * n).astype(np.int64)


def prefixes(longest: int, least: float) -> dict[int, np.ndarray]:
    """For every run length q: the number of first runs that a line of n words deals out, by n."""
    m = np.arange(int(longest / least) + 8)
    edits = m - least_words(m, least)
    size = np.clip(m // (edits + 1), 1, RUN)  # the longest runs of which edits leave one
    out = {}
    for q in range(1, RUN + 1):
        of = size == q
        # a line of n words and a longer one of m: at most q * edits - (m - n) of its runs are spoilt
        most = np.maximum.accumulate(np.where(of, q * edits - m, -len(m) * RUN)[::-1])[::-1]
        nearest = np.minimum.accumulate(np.where(of, m, len(m) - 1)[::-1])[::-1]
        some = of[nearest] & (least_words(nearest, least) <= m)
        out[q] = np.where(some, np.maximum(most + m + 1, 1), 0)[: longest + 1]
    return out


def _lines(min_words: int):
    """Lines with their hash, number of words and parities: bit k of 256 tells whether an odd number of words have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, number, key, n, hashes, _, first in _chunk_lines(batch, min_words):
                bit = _U(1) << (hashes & _U(63))
                which = hashes >> _U(6) & _U(3)
                # every second stretch lies between two lines
                bounds = np.stack([first, first + n], axis=1).ravel()
                sides = [np.bitwise_xor.reduceat(np.append(np.where(which == _U(k), bit, _U(0)), _U(0)), bounds)[::2].copy().view(np.int64) for k in range(len(SIDES))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, number, key, n.astype(np.int64), *sides)], names=["doc_id", "line", "id", "n", *SIDES])

    return run


def _runs(min_words: int, least: float, buckets: int):
    """By bucket of keys the packed key, id and length of every line's first runs."""

    def packs(some: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        value, ids, n = (np.concatenate(x) for x in zip(*some, strict=True))
        key = words.mix(value)
        bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        rows = np.empty(len(key), _MET)
        rows["value"] = key[order] << _U(40) | ids[order].view(_U) & _U(_ID)
        rows["code"] = np.searchsorted(_CODES, n[order], side="right") - 1
        bucket = bucket[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([rows[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)], pa.binary())], names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        tables, held = prefixes(256, least), 0
        for batch in batches:
            for _, _, key, n, hashes, size, first in _chunk_lines(batch, min_words):
                _, once = np.unique(key, return_index=True)
                if n.max() >= len(tables[1]):
                    tables = prefixes(2 * int(n.max()), least)
                upto = np.concatenate([[0], np.cumsum(size)])
                for k in range(0, len(once), 1 << 17):
                    few = once[k : k + (1 << 17)]
                    for q, table in tables.items():
                        of = few[(table[n[few]] > 0) & (n[few] >= q)]
                        if len(of):
                            some.append(_first_runs(q, table[n[of]], key[of], n[of], first[of], hashes, upto))
                            held += len(some[-1][0])
                if held > DEAL:
                    yield packs(some)
                    some, held = [], 0
        if some:
            yield packs(some)

    return run


#: 24 bits of the key and 40 of the line's id, and the code of its length.
_MET = np.dtype([("value", "<u8"), ("code", "u1")])
_ID = (1 << 40) - 1
#: Least length of each code: exact up to 127, then 16 to an octave; the last one has no upper end.
_CODES = np.concatenate([np.arange(128), np.ceil(127 * 2 ** (np.arange(1, 129) / 16)).astype(np.int64)])
_CODE_ENDS = np.append(_CODES[1:] - 1, 1 << 62)
_FACTORS = [int(words.mix(np.asarray([i + 1], _U) * _U(0xA0761D6478BD642F))[0]) | 1 for i in range(RUN)]


def _first_runs(q: int, wanted: np.ndarray, ids: np.ndarray, n: np.ndarray, first: np.ndarray, hashes: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, line ids and lengths of the wanted number of different runs of q words of each line, long runs first."""
    count = n - q + 1
    line = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
    value = np.full(len(at), q, _U)
    for i in range(q):
        value += hashes[at + i] * _U(_FACTORS[i])
    short = (127 - np.minimum(upto[at + q] - upto[at], 127)).astype(_U)
    # line, shortness and hash in one number, sorted
    ranked = np.sort(line.astype(_U) << _U(47) | short << _U(40) | words.mix(value) >> _U(24))
    ranked = ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])]
    line = (ranked >> _U(47)).astype(np.int64)
    begin = np.searchsorted(line, np.arange(len(n)))
    keep = np.arange(len(line)) - begin[line] < wanted[line]
    return (ranked[keep] & _U((1 << 47) - 1)) + _U(q << 48), ids[line[keep]], n[line[keep]]


def _meet(least: float):
    """(key, short) of the runs that several lines deal out whose lengths allow similarity; short is the last 40 bits of the id."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(p.as_py(), _MET) for p in table.column("packed")])
        of = (rows["value"] >> _U(40)).astype(np.uint32)
        same = np.sort(of)
        again = np.unique(same[1:][same[1:] == same[:-1]])
        if len(again):
            rows = rows[again[np.minimum(np.searchsorted(again, of), len(again) - 1)] == of]
            _, once = np.unique(rows["value"], return_index=True)
            rows = rows[once]
            of = (rows["value"] >> _U(40)).astype(np.int64)
            order = np.lexsort((rows["code"], of))
            rows, of = rows[order], of[order]
            code = rows["code"].astype(np.int64)
            near = (of[1:] == of[:-1]) & (_CODE_ENDS[code[:-1]] >= least_words(_CODES[code[1:]], least))
            some = np.append(near, False) | np.insert(near, 0, False)
            rows, of = rows[some], of[some]
        else:
            rows, of = rows[:0], np.zeros(0, np.int64)
        return pa.table({"key": pa.array(of | int(key[0].as_py()) << 24), "short": pa.array((rows["value"] & _U(_ID)).astype(np.int64))})

    return run


def _deal(buckets: int, columns: list[str]):
    """Packs the columns, the first of which is the key, by bucket of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
            bucket = ((words.mix(np.ascontiguousarray(rows[:, 0]).view(_U)) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], rows[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            if len(starts):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([rows[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)], pa.binary())], names=["bucket", "packed"])

    return run


def _pairs(key: np.ndarray, n: np.ndarray, sides: list[np.ndarray], least: float, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs with equal key, of different parts if these are given, whose lengths and parities allow similarity; rows are sorted by key and n."""
    starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    length = np.diff(np.append(starts, len(key)))
    run_end = np.repeat(starts + length, length)
    stay = least_words(n, least)
    differ = 2 * (n - stay) - n  # an edit changes two words at most, and one that makes up for a difference in length one
    shift, alive = 1, np.flatnonzero(np.repeat(length, length) > 1)
    while len(alive):
        alive = alive[alive + shift < run_end[alive]]
        alive = alive[n[alive] >= stay[alive + shift]]
        near = alive if part is None else alive[part[alive] != part[alive + shift]]
        for table in sides:  # narrow ones first, a stretch at a time
            near = np.concatenate([some[np.bitwise_count(table[some] ^ table[some + shift]).sum(axis=1) <= differ[some + shift] + n[some]] for some in np.split(near, range(1 << 15, len(near), 1 << 15))])
        if len(near):
            yield near, near + shift
        shift += 1


def _candidates(least: float, forest: bool):
    """Pairs of a bucket: a forest of them; or all between different parts, rows of which have their part and bags too."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(p.as_py(), np.int64) for p in table.column("packed")])
        rows = rows.reshape(-1, 3 + len(SIDES) + (0 if forest else 1 + len(BAGS)))
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        node, label = np.unique(rows[:, 1], return_inverse=True)
        root = np.arange(len(node))
        out: list[np.ndarray] = []
        edge = 3 + len(SIDES)
        sides = [np.ascontiguousarray(x).view(_U) for x in ([rows[:, 3:edge]] if forest else [rows[:, 3:edge], rows[:, edge + 1 :]])]
        for a, b in _pairs(np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 2]), sides, least, None if forest else np.ascontiguousarray(rows[:, edge])):
            if forest:  # links between parts that are not joined yet, one for each part that moves
                a, b = label[a], label[b]
                while True:
                    ra, rb = root[a], root[b]
                    apart = ra != rb
                    if not apart.any():
                        break
                    a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                    high, pick = np.unique(np.maximum(ra, rb), return_index=True)
                    out.append(np.stack([node[a[pick]], node[b[pick]]]))
                    root[high] = np.minimum(ra, rb)[pick]
                    while (root[root] != root).any():
                        root = root[root]
            else:
                out.append(np.stack([rows[a, 1], rows[b, 1]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        found = np.unique(np.sort(found, axis=0), axis=1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    return run


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, bit-parallel over whole numbers of any length."""
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    j = 0
    while j < most - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = places.get(x, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(flat | up)), up & flat
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        flat = eq | down
        up, down = left | (full & ~(flat | right)), right & flat
    return score


def similar(a: str, b: str, least: float) -> bool:
    x, y = a.split(" "), b.split(" ")
    most = max(len(x), len(y))
    return min(len(x), len(y)) >= least * most and most - edit_distance(x, y) >= least * most


def bag_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Edits at least between two sequences, by the words that one has and the other lacks, in any order."""
    ux, nx = np.unique(x, return_counts=True)
    uy, ny = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    return max(len(x), len(y)) - int(np.minimum(nx[i], ny[j]).sum())


def within(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each pair of word-hash sequences whether their edit distance is at most `most`; pairs of like length are worked on together in a band of the table."""
    la, lb = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    ok = np.zeros(len(xs), bool)
    near = np.flatnonzero(np.abs(la - lb) <= most)
    longest = np.maximum(la, lb)
    for k in near[longest[near] > LONG_LINE]:
        # in long lines the parities are full and let unlike ones pass; the words themselves do not
        ok[k] = bag_distance(xs[k], ys[k]) <= most[k] and edit_distance(xs[k].tolist(), ys[k].tolist()) <= most[k]
    near = near[longest[near] <= LONG_LINE]
    near = near[np.argsort(longest[near], kind="stable")]
    for at in range(0, len(near), 1024):
        some = near[at : at + 1024]
        d, n, m = int(most[some].max()), int(la[some].max()), int(lb[some].max())
        x = np.zeros((len(some), n), _U)
        y = np.zeros((len(some), n + 2 * d + 1 + m), _U)
        for row, k in enumerate(some):
            x[row, : la[k]] = xs[k]
            y[row, d : d + lb[k]] = ys[k]
        offset = np.arange(2 * d + 1, dtype=np.int32)
        far = np.int32(1 << 20)
        # column k of the band stands for the place i + k - d of y
        row = np.broadcast_to(np.where(offset >= d, offset - d, far), (len(some), 2 * d + 1)).astype(np.int32)
        ends = lb[some] - la[some] + d
        for i in range(1, n + 1):
            below = np.full_like(row, far)
            below[:, :-1] = row[:, 1:] + 1
            row = np.minimum(row + (x[:, i - 1 : i] != y[:, i - 1 : i + 2 * d]), below)
            if i <= d:
                row[:, : d - i] = far
                row[:, d - i] = i
            row = np.minimum.accumulate(row - offset, axis=1) + offset
            last = np.flatnonzero(la[some] == i)
            ok[some[last]] = row[last, ends[last]] <= most[some[last]]
    return ok


def bag_parities(x: np.ndarray) -> np.ndarray:
    """64 parities in each of len(BAGS) numbers, of a line's words; a word's repeats count as further words, so an edit changes two of them at most."""
    x = np.sort(x)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
    nth = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    place = words.mix(x + nth.astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(64 * len(BAGS))
    odd = np.bincount(place.astype(np.int64), minlength=64 * len(BAGS)) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and parities of lines with their word hashes."""
    for batch in batches:
        if len(batch):
            rows = np.stack([bag_parities(np.frombuffer(v.as_py(), _U)) for v in batch.column("words")])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(BAGS)))], names=["id", *BAGS])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = ([np.frombuffer(v.as_py(), _U) for v in batch.column(c)] for c in ("x", "y"))
            longer = np.array([max(len(x), len(y)) for x, y in zip(xs, ys, strict=True)], np.int64)
            ok = within(xs, ys, longer - least_words(longer, least))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def _place_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (words.mix(doc.view(_U) * _U(0x9E3779B97F4A7C15) + line.view(_U)) >> _U(64 - WANTED_LOG2)).astype(np.int64)


def _texts(wanted: np.ndarray):
    """id (the hash of its words) and word hashes of the lines that hit the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.string_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j in common.chunks(at):
                part = data[at[i] : at[j]]
                lines, owner, number = _line_offsets(part, at[i : j + 1] - at[i])
                bit = _place_hash(ids[i:j][owner], number)
                hits = np.flatnonzero(wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                if not len(hits):
                    continue
                # the wanted lines alone, one after another
                size = lines[hits + 1] - lines[hits]
                to = np.concatenate([[0], np.cumsum(size)])
                low = _NORMAL[part[np.arange(to[-1]) + np.repeat(lines[hits] - to[:-1], size)]]
                starts, ends, first = words.word_spans(low, to, _NOT_WORD)
                hashes = words.span_hashes(low, starts, ends)
                raw = hashes.tobytes()
                found = [raw[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_line_keys(hashes, first)), pa.array(found, pa.binary())], names=["id", "words"])

    return run


def _bitmap(places: DataFrame) -> np.ndarray:
    """A fixed-size bitmap of the (doc_id, line) rows."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << (WANTED_LOG2 - 3), np.uint8)
        for batch in batches:
            bit = _place_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            np.bitwise_or.at(flags, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
        for k in range(0, len(flags), 1 << 16):
            if flags[k : k + (1 << 16)].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([flags[k : k + (1 << 16)].tobytes()], pa.binary())], names=["k", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("k").to_pylist(), batch.column("part"), strict=True):
                parts[k] = parts.get(k, np.uint8(0)) | np.frombuffer(part.as_py(), np.uint8)
        for k, v in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["k", "part"])

    out = np.zeros(1 << (WANTED_LOG2 - 3), np.uint8)
    for row in places.mapInArrow(mark, "k long, part binary").repartition(16, "k").mapInArrow(join, "k long, part binary").collect():
        out[row.k : row.k + len(row.part)] = np.frombuffer(row.part, np.uint8)
    return out


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the sorted numbers (from 0) of its lines that are not their group's first occurrence."""
    texts = common.columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).where("doc_id is not null")
    spark = docs.sparkSession
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, min(1 << 16, n_bytes // (RUN_BYTES * BUCKET)))
    lines = common.cut(texts.mapInArrow(common.tidied(_lines(min_words)), ", ".join(f"{c} long" for c in ("doc_id", "line", "id", "n", *SIDES))), "lines", common.TEXT_ROWS)
    nodes = common.cut(lines.groupBy("id").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"), *(F.min(c).alias(k) for c, k in (("n", "words"), *zip(SIDES, SIDES, strict=True)))), "line-nodes")
    # dealt out in a pass of its own: a table of the runs would take more room than reading the texts again takes time
    runs = texts.mapInArrow(common.tidied(_runs(min_words, similarity, buckets)), "bucket long, packed binary")
    met = common.cut(runs.groupBy("bucket").applyInArrow(_meet(similarity), "key long, short long"), "line-runs", common.TEXT_ROWS)
    common.release(spark)
    short = F.col("id").bitwiseAND(F.lit(_ID)).alias("short")
    dealt = met.join(nodes.select(short, "id", "words", *SIDES).hint("shuffle_hash"), "short").mapInArrow(common.tidied(_deal(buckets, ["key", "id", "words", *SIDES])), "bucket long, packed binary")
    tree = common.cut(dealt.groupBy("bucket").applyInArrow(_candidates(similarity, True), "a long, b long").distinct(), "candidates", DEAL_ROWS)
    common.release(spark)
    worded = _worded(tree, nodes, texts)
    checked = _checked(tree, worded, similarity)
    linked = components(checked.where("ok"))
    named = nodes.select("id", "first", "n").join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if not checked.where("not ok").isEmpty():
        # groups in which the edit similarity turned a pair down: all other near pairs between what is still apart, by parities of their words that do not fill up so soon
        near = components(checked)
        torn = checked.where("not ok").select(F.col("a").alias("id")).distinct().join(near, "id").select("root").distinct()
        again = near.join(torn, "root", "left_semi").select("id")
        bags = worded.join(again, "id", "left_semi").mapInArrow(common.tidied(_bags), ", ".join(f"{c} long" for c in ("id", *BAGS)))
        apart = nodes.select("id", "words", *SIDES).join(bags, "id").join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
        apart = common.cut(apart, "apart", DEAL_ROWS)
        columns = ["key", "id", "words", *SIDES, "root", *BAGS]
        rest = met.join(apart.select(short, *columns[1:]), "short").mapInArrow(common.tidied(_deal(buckets, columns)), "bucket long, packed binary")
        rest = rest.groupBy("bucket").applyInArrow(_candidates(similarity, False), "a long, b long").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        rest = common.cut(rest, "candidates", DEAL_ROWS)
        common.release(spark)
        more = _checked(rest, worded, similarity).where("ok").select("a", "b")
        # links between groups that are whole so far, so only these join
        root = apart.select("id", "root")
        more = more.join(root.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").select("ra", "rb")
        joined = components(more, "ra", "rb").select(F.col("id").alias("root"), F.col("root").alias("into"))
        named = named.join(joined, "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into")
    groups = named
    groups = common.cut(groups, "line-groups")
    kept = groups.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("total")).where("total > 1")
    of_line = groups.select("id", "root").join(kept, "root").select("id", "kept")
    gone = lines.select("doc_id", "line", "id").join(of_line, "id").where(F.struct("doc_id", "line") != F.col("kept"))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _worded(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """id and word hashes of the lines in pairs."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    places = common.cut(nodes.join(ends, "id", "left_semi").select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line")), "places")
    found = texts.mapInArrow(common.tidied(_texts(_bitmap(places.select("doc_id", "line")))), "id long, words binary")
    return common.cut(found.join(places.select("id"), "id", "left_semi").dropDuplicates(["id"]), "worded", common.TEXT_ROWS)


def _checked(pairs: DataFrame, worded: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with ok: whether the edit similarity of their normalised lines is enough."""
    x, y = worded.select(F.col("id").alias("a"), F.col("words").alias("x")), worded.select(F.col("id").alias("b"), F.col("words").alias("y"))
    return common.cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(common.tidied(_verify(similarity)), "a long, b long, ok boolean"), "checked", PAIR_ROWS)


def dedup_lines(docs: DataFrame, removed_col: str = "removed_lines", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with repeated lines taken out of the text, and the numbers of the lines that went (null: none); an input column of that name gives way."""
    key, gone, pieces = (next(n for n in (f"__{stem}{i or ''}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for stem in ("key", "gone", "lines"))
    numbers = repeated_lines(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(key), F.col("removed").alias(gone))
    kept = [c for c in docs.columns if c != removed_col]
    joined = docs.join(numbers, docs[id_col].cast("long") == numbers[key], "left").drop(key)
    # split once: used twice below, so the optimiser keeps the projection between
    joined = joined.withColumn(pieces, F.split(F.col(f"`{text_col}`"), "\n", -1))
    left = F.array_except(F.sequence(F.lit(1), F.size(pieces)), F.transform(gone, lambda i: i.cast("int") + 1))
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(pieces, i)), "\n"))
    return joined.select(*((text if c == text_col else F.col(f"`{c}`")).alias(c) for c in kept), F.col(gone).alias(removed_col))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, its numbers of lines and of removed lines, the removed lines, and the text that stays."""
    docs = common.columns(common.read(spark, sf_dir, "documents"), doc_id=("doc_id", "long"), text=("text", "string"))
    n_removed = F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long")
    left = F.when(F.col("text").isNull() | ((F.col("text") == "") & (n_removed > 0)), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return dedup_lines(docs).select("doc_id", (left + n_removed).alias("n_lines"), n_removed.alias("n_removed"), F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",").alias("removed_lines"), "text")
