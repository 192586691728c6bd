"""Operator 3, language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A letter's vector is
permuted by its place in a trigram (rolled by one step a place) and the three are bound by
multiplication; the vectors of all trigrams of a text, added up, are the text's profile, and those
of all texts of a language, each text weighing alike, the language's prototype. A text takes the
language whose prototype has the largest cosine with its profile.

Prototypes are sums over all training documents, made by Spark from trigram counts; only
languages x DIMENSIONS numbers reach the driver. Null texts and texts without a letter are `und`
with score 0; so are texts when nothing could be learned. Equal cosines go to the language that
sorts first. Rows with null lang train nothing; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .words import mix

DIMENSIONS = 1024
SEED = 20_011
#: A text's trigrams weigh this much together in its language's prototype.
UNIT = 1_000_000
#: Least cosine of a recognised text where no labelled texts of its length say more: about what unrelated vectors reach by chance.
LEAST_COSINE = 0.05
#: The part of all labelled texts that may lie below a length's usual cosine, how far below it texts still pass, and the steps that cosines are counted in.
FLOOR_SHARE, FLOOR_PART, FLOOR_STEPS = 0.01, 1 / 3, 10_000
#: Lengths are told apart by powers of two of their letters.
BANDS = 40

_U = np.uint64


def _code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and row offsets into them, from UTF-8."""
    raw = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])
    return points, count[at]


_PLANES = 0x40000  # the four planes that have letters; tests look for others


def _letter_table() -> np.ndarray:
    """Each code point's lower-case letter, or 0 for what is no letter."""
    table = np.zeros(_PLANES, np.uint32)
    for c in range(_PLANES):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = _letter_table()
    return _tables["letters"]


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram codes, row of each, rows' numbers of letters). Words are padded by a blank on both sides; what is no letter is a blank."""
    points, rows_at = _code_points(data, at)
    n = len(rows_at) - 1
    low = letters()[np.where(points < _PLANES, points, 0)] if len(points) else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(n), np.diff(rows_at))
    has = low > 0
    n_letters = np.bincount(owner[has], minlength=n)
    # a blank stands before and after every row; runs of blanks count as one
    spaced = np.zeros(len(low) + n, np.uint32)
    place = np.arange(len(low)) + owner
    spaced[place] = low
    row = np.repeat(np.arange(n), np.diff(rows_at) + 1)
    keep = spaced > 0
    keep[1:] |= spaced[:-1] > 0
    s, r = spaced[keep].astype(_U), row[keep]
    if len(s) < 2:
        return np.zeros(0, _U), np.zeros(0, np.int64), n_letters
    before, own = np.concatenate([[_U(0)], s[:-1]]), s
    after = np.concatenate([s[1:], [_U(0)]])
    # a row's first letter has a blank before it whatever the row before ended with
    first = np.concatenate([[True], r[1:] != r[:-1]])
    before[first] = 0
    use = own > 0
    return (before[use] << _U(42)) | (own[use] << _U(21)) | after[use], r[use], n_letters


def gram_vectors(codes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors (+1 and -1 as int8) of trigram codes."""
    out = np.ones((len(codes), dimensions), np.int8)
    for place, shift in enumerate((42, 21, 0)):
        letter, where = np.unique((codes >> _U(shift)) & _U(0x1FFFFF), return_inverse=True)
        words = mix(mix(letter + _U(seed))[:, None] + np.arange(dimensions // 64, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15))
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        out *= np.roll(bits.astype(np.int8) * 2 - 1, place, axis=1)[where]
    return out


def _counts(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (row, code) pairs with their counts, sorted."""
    order = np.lexsort((codes, row))
    c, r = codes[order], row[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], c[at], np.diff(np.append(at, len(c)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, scaled to length 1. Collects languages x dimensions numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        keys: dict[str, np.ndarray] = {}

        def add(lang: str, codes: np.ndarray, weights: np.ndarray) -> None:
            if lang in keys:
                codes, weights = np.concatenate([keys[lang], codes]), np.concatenate([total[lang], weights])
            found, where = np.unique(codes, return_inverse=True)
            # exact: sums stay below 2**53
            keys[lang], total[lang] = found, np.bincount(where, weights.astype(np.float64), len(found)).astype(np.int64)

        for batch in batches:
            data, at = common.string_buffers(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for i, j in common.chunks(at):
                codes, row, _ = trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if not len(codes):
                    continue
                r, c, n = _counts(codes, row)
                length = np.bincount(row, minlength=j - i)
                weight = n * UNIT // length[r]
                for lang in set(langs[i:j]):
                    mine = (langs[i:j] == lang)[r]
                    if mine.any():
                        add(lang, c[mine], weight[mine])
        for lang, codes in keys.items():
            for k in range(0, len(codes), 50_000):
                some = codes[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.view(np.int64)), pa.array(total[lang][k : k + 50_000])], names=["lang", "code", "weight"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            codes, weight = batch.column("code").to_numpy().view(_U), batch.column("weight").to_numpy()
            for i in range(0, len(codes), 2000):
                vectors = gram_vectors(codes[i : i + 2000], dimensions, seed).astype(np.float64)
                for lang in set(langs[i : i + 2000]):
                    mine = langs[i : i + 2000] == lang
                    # sums of integers below 2**53 are exact, so their order does not matter
                    sums[lang] = sums.get(lang, 0) + (weight[i : i + 2000][mine].astype(np.float64) @ vectors[mine]).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "d", "v"])

    rows = common.columns(docs, text=(text_col, "string"), lang=(lang_col, "string")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(common.tidied(count), "lang string, code long, weight long").groupBy("lang", "code").agg(F.sum("weight").alias("weight"))
    with common.arrow_rows(docs.sparkSession, common.TEXT_ROWS):
        sums = counts.mapInArrow(common.tidied(bundle), "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).toPandas()
    langs = sorted(set(sums.lang))
    prototypes = np.zeros((len(langs), dimensions))
    for k, lang in enumerate(langs):
        mine = sums[sums.lang == lang]
        prototypes[k, mine.d] = mine.v
    return langs, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)


class Profiles:
    """Compares texts with the prototypes; keeps the vectors of up to MOST trigrams, makes the rest again."""

    MOST = 30_000

    def __init__(self, prototypes: np.ndarray, seed: int):
        self.unit, self.seed = prototypes.astype(np.float32), seed
        self._clear()

    def _clear(self) -> None:
        self.codes, self.slots, self.vectors = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros((0, self.unit.shape[1]), np.int8)

    def _slots(self, used: np.ndarray) -> np.ndarray:
        new = np.setdiff1d(used, self.codes, assume_unique=True)
        if len(self.codes) + len(new) > self.MOST:
            self._clear()
            new = used
        if len(new):
            n = len(self.codes)
            if n + len(new) > len(self.vectors):
                grown = np.zeros((2 * (n + len(new)), self.unit.shape[1]), np.int8)
                grown[:n] = self.vectors[:n]
                self.vectors = grown
            self.vectors[n : n + len(new)] = gram_vectors(new, self.unit.shape[1], self.seed)
            codes, slots = np.concatenate([self.codes, new]), np.concatenate([self.slots, np.arange(n, n + len(new))])
            order = np.argsort(codes)
            self.codes, self.slots = codes[order], slots[order]
        return self.slots[np.searchsorted(self.codes, used)]

    def best(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the number of the best language (-1: no letter), its cosine, and the text's band of length."""
        data, at = common.string_buffers(column)
        best, cosine, band = np.full(len(column), -1), np.zeros(len(column)), np.zeros(len(column), np.int64)
        for i, j in common.chunks(at, 1 << 19):
            codes, row, n_letters = trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])
            band[i:j] = np.minimum(np.log2(np.maximum(n_letters, 1)), BANDS - 1)
            if not len(codes) or not len(self.unit):
                continue
            r, c, n = _counts(codes, row)
            used, where = np.unique(c, return_inverse=True)
            spot = self._slots(used)
            profiles = np.zeros((j - i, self.unit.shape[1]), np.float32)
            for k in range(0, len(used), 4096):
                part = (where >= k) & (where < k + 4096)
                counts = np.zeros((j - i, min(4096, len(used) - k)), np.float32)
                counts[r[part], where[part] - k] = n[part]
                profiles += counts @ self.vectors[spot[k : k + 4096]].astype(np.float32)
            scores = (profiles @ self.unit.T) / np.maximum(np.linalg.norm(profiles, axis=1), 1e-30)[:, None]
            ok = n_letters > 0
            best[i:j][ok] = scores.argmax(axis=1)[ok]
            cosine[i:j][ok] = scores.max(axis=1)[ok]
        return best, cosine, band


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred, cosine, and score (the cosine moved from -1..1 to 0..1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(prototypes, seed)
        names = pa.array([*langs, "und"])
        for batch in batches:
            best, cosine, _ = profiles.best(batch.column("text"))
            score = np.where(best >= 0, np.clip((cosine + 1) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names.take(pa.array(np.where(best < 0, len(langs), best))), pa.array(cosine), pa.array(score)], names=["doc_id", "lang_pred", "cosine", "score"])

    return common.columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, lang_pred string, cosine double, score double")


def floors(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text", lang_col: str = "lang", seed: int = SEED) -> np.ndarray:
    """The least cosine for each band of length: FLOOR_PART of what all but FLOOR_SHARE of the labelled texts of this and the two neighbouring bands reach.

    Every labelled text counts: each task adds up how many of its texts have which cosine (in steps of 1 / FLOOR_STEPS, rounded
    down), so at most BANDS x (2 * FLOOR_STEPS + 1) counts a task travel and BANDS rows reach the driver. LEAST_COSINE where no text says more.
    """
    rows = common.columns(docs, text=(text_col, "string"), lang=(lang_col, "string")).where("lang is not null and text is not null").select("text")
    least, wide = np.full(BANDS, LEAST_COSINE), 2 * FLOOR_STEPS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(prototypes, seed), np.zeros(BANDS * wide, np.int64)
        for batch in batches:
            best, cosine, band = profiles.best(batch.column("text"))
            step = np.clip(np.floor(cosine * FLOOR_STEPS).astype(np.int64) + FLOOR_STEPS, 0, wide - 1)
            total += np.bincount((band * wide + step)[best >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // wide), pa.array(at % wide - FLOOR_STEPS), pa.array(total[at])], names=["band", "step", "n"])

    found = rows.mapInArrow(common.tidied(run), "band long, step long, n long")
    around = found.select(F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"), "step", "n").where(F.col("band").between(0, BANDS - 1))
    upto = Window.partitionBy("band").orderBy("step")
    counted = around.groupBy("band", "step").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("band"))})
    with common.arrow_rows(docs.sparkSession, common.TEXT_ROWS):
        for row in counted.where(F.col("upto") >= F.col("all") * FLOOR_SHARE).groupBy("band").agg(F.min("step").alias("low")).collect():
            least[row.band] = max(LEAST_COSINE, FLOOR_PART * row.low / FLOOR_STEPS)
    return least


def recognised(docs: DataFrame, langs: list[str], prototypes: np.ndarray, least: np.ndarray | None = None, text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text has letters and reaches the least cosine of its length with some language."""
    least = np.full(BANDS, LEAST_COSINE) if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(prototypes, seed)
        for batch in batches:
            best, cosine, band = profiles.best(batch.column(text_col))
            yield batch.filter(pa.array((best >= 0) & (cosine >= least[band])))

    return docs.mapInArrow(common.tidied(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents that are not held out; one row per document."""
    docs = common.read(spark, sf_dir, "documents")
    langs, prototypes = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, langs, prototypes).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
