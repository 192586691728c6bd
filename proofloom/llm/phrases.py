"""Operator 12, phrase collocation mining by SETM.

Occurrences are relations that are written sorted by piece and position, one row a chunk of texts:
for every place of the chunk the group (word or phrase) that starts there, and a gap at the end of
each piece. A pass merge-joins a relation with itself at adjacent positions, which in sorted places is
one step to the right: where a frequent phrase of k words starts and another one a word later in the
same piece, there is a phrase of k + 1. Its groups are counted within the chunk; the counts of all
chunks meet by group, those of LEAST occurrences get a code, and the codes go back to the chunks that hold
them: there the relation is semi-joined with them before it is extended again. What travels are the
different groups of each chunk, packed by bucket, never its occurrences; a group, however
frequent, comes once from each chunk.

Words are told apart exactly: by two 64-bit hashes within a chunk and by their bytes between chunks;
a phrase is the pair of the codes of the phrases without its last and its first word. Languages are part of
the group, a null one is `und`; null and empty texts have no words; a long text is one chunk; repeated
rows count each; an empty table gives no rows. Products of counts are whole decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

#: Occurrences that make a phrase a candidate, and words of a phrase at most.
LEAST, LONGEST = 30, 4
#: Phrases that are returned for a language.
FIRST = 2000
#: A candidate gives way to a longer one that has so many percent of its occurrences.
COVERED_PERCENT = 80
#: Places of a chunk at least, where a task has them; a longer text stands alone.
CHUNK = 3 << 19
#: Different groups of chunks that a bucket should hold, and bytes of text for each, about; they decide the number of buckets alone.
BUCKET, GROUP_BYTES = 500_000, 8
#: Rows in an Arrow batch of packed groups.
PACKED_ROWS = 200
#: Parts of a language that are ranked by themselves first.
SALTS = 64

_U = np.uint64
_LOWER = words.lower_table()
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BLANK | _BREAK
#: Rows of a pass: a chunk's places; its groups by bucket, with the number of the first of them in the chunk; words of a language.
_PASS = "chunk long, at binary, bucket long, base long, first binary, second binary, n binary, lang string, total long"
#: What buckets give: for each chunk its frequent groups' numbers with codes, and the groups themselves.
_COUNTED = "chunk long, local binary, codes binary, code long, first long, second long, word string, a long"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, compressed."""
    v = np.ascontiguousarray(values, "<i8")
    return zstandard.ZstdCompressor(level=3).compress(v.view(np.uint8).reshape(-1, 8).T.tobytes()) if len(v) else b""


def _unpacked(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _pack_words(some: pa.StringArray) -> bytes:
    """Strings as their lengths and their bytes."""
    data, at = common.string_buffers(some)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.array([len(some)], "<i4"), np.diff(at).astype("<i4")]).tobytes() + data[at[0] : at[-1]].tobytes())


def _unpack_words(packed: bytes) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    at = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i4", n, 4), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.tobytes()), pa.py_buffer(raw[4 + 4 * n :]))


def _pass_rows(chunk: int, places: np.ndarray, bucket: np.ndarray, pack, n: np.ndarray, more: list[dict] = ()) -> pa.Table:
    """A chunk's rows of a pass; places hold numbers of groups, which are in order of their buckets. pack: first and second of a stretch of groups."""
    rows = [{"chunk": chunk, "at": _packed(places)}]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(bucket)], strict=True):
        first, second = pack(i, j)
        rows.append({"chunk": chunk, "bucket": int(bucket[i]), "base": int(i), "first": first, "second": second, "n": _packed(n[i:j])})
    return pa.Table.from_pylist([*rows, *more], schema=_PASS_SCHEMA)


_PASS_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]) for c in _PASS.split(", ")])
_COUNTED_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]) for c in _COUNTED.split(", ")])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _words_of(part: np.ndarray, at: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Different words of some texts (hash, second hash, bytes, language) and the word of each place, -1 at the end of a piece."""
    low = _LOWER[part]
    starts, ends, first = words.word_spans(low, at, _APART)
    one, two = words.span_hashes(low, starts, ends), words.span_hashes(low ^ np.uint8(0x5A), starts, ends)
    of = lang[np.repeat(np.arange(len(at) - 1), np.diff(first))]
    rep, inverse = _distinct(one, two, of)
    # a piece ends at a break between two words and with its text
    breaks = np.concatenate([[0], np.cumsum(_BREAK[low])])
    apart = np.zeros(len(starts), bool)
    apart[:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
    closing = first[1:][np.diff(first) > 0] - 1
    apart[closing] = True
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(apart)[:-1]]) if len(starts) else np.zeros(0, np.int64)
    places = np.full(len(starts) + int(apart.sum()), -1, np.int64)
    places[place] = inverse
    # the bytes of the different words, one after another
    size = ends[rep] - starts[rep]
    to = np.concatenate([[0], np.cumsum(size)])
    raw = low[np.arange(to[-1]) + np.repeat(starts[rep] - to[:-1], size)]
    texts = pa.LargeStringArray.from_buffers(len(rep), pa.py_buffer(to.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
    return one[rep], two[rep], texts, of[rep], places


def _distinct(one: np.ndarray, two: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different (hash, second hash, language), and which of them each row is."""
    key = words.mix(one + of.astype(_U) * _U(0x9E3779B97F4A7C15))
    _, rep, inverse = np.unique(key, return_index=True, return_inverse=True)
    if not ((two[rep][inverse] == two) & (of[rep][inverse] == of)).all():  # the first hash was not enough
        _, rep, inverse = np.unique(np.stack([one, two, of.astype(_U)], axis=1), axis=0, return_index=True, return_inverse=True)
    return rep, inverse.ravel()


def _tokenised(buckets: int):
    """Chunks of texts: their places, different words with counts by bucket, and the number of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size, langs = 0, {}

        def flush() -> pa.Table:
            one, two, of = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3))
            rep, inverse = _distinct(one, two, of)
            names = list(langs)  # numbered anew in each task, so the bucket goes by the name
            named = np.array([zlib.crc32(x.encode()) for x in names], _U)
            bucket = _bucket(words.mix(one[rep] + words.mix(two[rep] + named[of[rep]])), buckets)
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            inverse, base, out = number[inverse], 0, []
            for h in held:
                own = h[4]
                out.append(np.where(own < 0, -1, inverse[np.maximum(own, 0) + base]) if len(h[0]) else own)
                base += len(h[0])
            places, rep = np.concatenate(out), rep[order]
            counts = np.bincount(places[places >= 0], minlength=len(rep))
            spoken = pa.array(names, pa.large_string()).take(pa.array(of[rep]))
            # a word has no tab, so what stands before the first is the word
            keys = pc.binary_join_element_wise(pa.concat_arrays([h[2] for h in held]).take(pa.array(rep)), spoken, pa.scalar("\t", pa.large_string()))
            total = np.zeros(len(names), np.int64)
            np.add.at(total, of[rep], counts)
            more = [{"lang": x, "total": int(n)} for x, n in zip(names, total, strict=True) if n]
            return _pass_rows(task << 32 | serial, places, bucket[order], lambda i, j: (_pack_words(keys.slice(i, j - i)), None), counts, more)

        for batch in batches:
            data, at = common.string_buffers(batch.column("text"))
            lang = np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], np.int64)
            for i, j in common.chunks(at):
                held.append(_words_of(data[at[i] : at[j]], at[i : j + 1] - at[i], lang[i:j]))
                size += len(held[-1][4])
                if size >= CHUNK:
                    yield from flush().to_batches()
                    held.clear()
                    size, serial = 0, serial + 1
        if size:
            yield from flush().to_batches()

    return run


def _extend(buckets: int):
    """A chunk's relation semi-joined with the frequent groups it has and extended by a word."""

    def run(relation: pa.Table, known: pa.Table) -> pa.Table:
        if not relation.num_rows or not known.num_rows:
            return _PASS_SCHEMA.empty_table()
        local, code = (np.concatenate([_unpacked(x.as_py()) for x in known.column(c)]) for c in ("local", "codes"))
        places = _unpacked(relation.column("at")[0].as_py())
        to = np.full(max(int(places.max(initial=-1)), int(local.max(initial=-1))) + 2, -1, np.int64)
        to[local] = np.arange(len(local))  # the last one stays -1, for gaps
        now = to[places]
        pair = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
        if not len(pair):
            return _PASS_SCHEMA.empty_table()
        found, inverse, counts = np.unique(now[pair] * len(code) + now[pair + 1], return_inverse=True, return_counts=True)
        first, second = code[found // len(code)], code[found % len(code)]
        bucket = _bucket(words.mix(first.view(_U) * _U(0x9E3779B97F4A7C15) + words.mix(second.view(_U))), buckets)
        order = np.lexsort((second, first, bucket))  # like firsts stand together, which packs well
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        first, second = first[order], second[order]
        # only the places that start a phrase, each run of them closed by a gap
        gap = np.append(np.diff(pair) > 1, True)
        out = np.full(len(pair) + int(gap.sum()), -1, np.int64)
        out[np.arange(len(pair)) + np.concatenate([[0], np.cumsum(gap)[:-1]])] = number[inverse]
        pack = lambda i, j: (_packed(np.diff(first[i:j], prepend=0)), _packed(second[i:j]))
        return _pass_rows(relation.column("chunk")[0].as_py(), out, bucket[order], pack, counts[order])

    return run


def _counted(k: int, least: int):
    """Adds the counts of a bucket's groups over all chunks; frequent ones get codes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk, base = table.column("chunk").to_pylist(), table.column("base").to_pylist()
        n = [_unpacked(x.as_py()) for x in table.column("n")]
        every, cuts = np.concatenate(n), np.concatenate([[0], np.cumsum([len(x) for x in n])])
        if k == 1:
            coded = pa.concat_arrays([_unpack_words(x.as_py()) for x in table.column("first")]).dictionary_encode()
            group, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        else:
            first = np.concatenate([np.cumsum(_unpacked(x.as_py())) for x in table.column("first")])
            second = np.concatenate([_unpacked(x.as_py()) for x in table.column("second")])
            order = np.lexsort((second, first))
            new = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0))
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            size, rep = int(new.sum()), order[new]
        total = np.zeros(size, np.int64)
        np.add.at(total, group, every)
        often = np.flatnonzero(total >= least)
        code = np.full(size, -1, np.int64)
        code[often] = (k << 58) + (key[0].as_py() << 34) + np.arange(len(often))
        rows = []
        for i, (c, b) in enumerate(zip(chunk, base, strict=True)):
            own = code[group[cuts[i] : cuts[i + 1]]]
            held = np.flatnonzero(own >= 0)
            if len(held):
                rows.append({"chunk": c, "local": _packed(held + b), "codes": _packed(own[held])})
        back = pa.Table.from_pylist(rows, schema=_COUNTED_SCHEMA)
        what = {"code": pa.array(code[often]), "a": pa.array(total[often])}
        what |= {"word": coded.dictionary.take(pa.array(often)).cast(pa.string())} if k == 1 else {"first": pa.array(first[rep[often]]), "second": pa.array(second[rep[often]])}
        levels = pa.table([what.get(f.name, pa.nulls(len(often), f.type)) for f in _COUNTED_SCHEMA], schema=_COUNTED_SCHEMA)
        return pa.concat_tables([back, levels])

    return run


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, n): words of each language; and the frequent phrases of one to `longest` words: code, lang, k, phrase, a, heads and tails (counts of its first and last 1 to k words), first and second (codes of the phrases without its last and its first word)."""
    spark = docs.sparkSession
    texts = common.columns(docs, text=(text_col, "string"), lang=(lang_col, "string")).select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, min((1 << 24) - 1, n_bytes // (GROUP_BYTES * BUCKET)))
    step = common.cut(texts.mapInArrow(common.tidied(_tokenised(buckets)), _PASS), "phrase-words", common.TEXT_ROWS)
    total = common.cut(step.where("lang is not null").groupBy("lang").agg(F.sum("total").alias("n")), "words-of-languages")
    level = found = None
    for k in range(1, longest + 1):
        groups = step.where("bucket is not null").select("bucket", "chunk", "base", "first", "second", "n")
        counted = common.cut(groups.groupBy("bucket").applyInArrow(_counted(k, least), _COUNTED), f"groups-{k}", PACKED_ROWS)
        common.release(spark)
        rows = counted.where("code is not null")
        if k == 1:
            tab = F.instr("word", "\t")
            grown = rows.select("code", F.substring("word", tab + 1, F.length("word")).alias("lang"), F.lit(1).alias("k"), F.substring("word", F.lit(1), tab - 1).alias("phrase"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"), "first", "second", F.substring("word", F.lit(1), tab - 1).alias("last"))
        else:
            head = level.select(F.col("code").alias("first"), "lang", F.col("phrase").alias("before"), "heads")
            tail = level.select(F.col("code").alias("second"), "tails", "last")
            grown = rows.select("code", "a", "first", "second").join(head, "first").join(tail, "second").select(
                "code", "lang", F.lit(k).alias("k"), F.concat("before", F.lit(" "), "last").alias("phrase"), "a", F.array_append("heads", F.col("a")).alias("heads"), F.array_append("tails", F.col("a")).alias("tails"), "first", "second", "last"
            )
        level = common.cut(grown, f"phrases-{k}")
        found = level if found is None else found.unionByName(level)
        if k < longest:
            known = counted.where("chunk is not null").select(F.col("chunk").alias("of_chunk"), "local", "codes")
            grown = step.where("at is not null").select("chunk", "at").groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_extend(buckets), _PASS)
            before, step = step, common.cut(grown, f"occurrences-{k + 1}", PACKED_ROWS)
            common.discard(before, counted)
            common.release(spark)
    common.discard(step, counted)
    return total, found.drop("last")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (l + r)), in whole decimals."""
    whole = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", whole(a) * F.lit(2000000), whole(left) + whole(right))


def _cut(j: Column) -> Column:
    """The cut of a phrase after its word j, to be ordered by score and then place."""
    left, right = F.get("heads", j - 1), F.get("tails", F.col("k") - j - 1)
    return F.struct(score(F.col("a"), left, right).alias("s"), j.alias("j"), left.alias("l"), right.alias("r"))


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST, longest: int = LONGEST, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two words or more, phrases that a longer one covers left out."""
    total, found = phrases(docs, least=least, longest=longest)
    several = found.where("k > 1")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), _cut)
    scored = several.withColumn("cut", F.array_min(cuts))
    # a longer phrase contains a shorter one of one word less, if it contains it at all
    longer = several.select(F.explode(F.array("first", "second")).alias("code"), F.col("a").alias("over")).groupBy("code").agg(F.max("over").alias("over"))
    big = lambda c, by: F.col(c).cast("decimal(38,0)") * by
    left = scored.join(longer, "code", "left").where(F.col("over").isNull() | (big("over", 100) < big("a", covered_percent)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.s").alias("score"))
    some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations(common.read(spark, sf_dir, "documents"))


OP12_SQL = r"""with d as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
n as (select lang, sum(len(w))::bigint as n from p group by 1),
g as (select lang, k, array_to_string(w[i::bigint : (i + k - 1)::bigint], ' ') as phrase from p, range(1, 5) ks(k), lateral (select unnest(range(1, len(w) - k + 2)) as i) s),
f as (select lang, k, phrase, count(*) as a from g group by all),
c as (select * from f where k > 1 and a >= 30),
cuts as (select c.lang, c.k, c.phrase, c.a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') as x, array_to_string(string_split(c.phrase, ' ')[(j + 1)::bigint:], ' ') as y from c, range(1, 4) js(j) where j < c.k),
s as (select cuts.*, l.a as l, r.a as r, (2000000::hugeint * cuts.a) // (l.a + r.a) as score from cuts join f l on l.lang = cuts.lang and l.k = j and l.phrase = x join f r on r.lang = cuts.lang and r.k = cuts.k - j and r.phrase = y),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
left_ as (select b.* from best b where not exists (select 1 from c where c.lang = b.lang and c.k > b.k and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') and 100::hugeint * c.a >= 80::hugeint * b.a))
select lang, row_number() over w as rank, phrase, a, l, r, n, score::bigint as score from left_ join n using (lang) window w as (partition by lang order by score desc, a desc, phrase) qualify rank <= 2000"""
