"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import datetime
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofloom.llm import components, jaccard, language, licenses, lines, mixing, packing, pseudonyms, tokens, vectors, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, root string"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
ROWS = [
    (1, None, "en", "src1", None, 0.5, 7, "x"), (2, "", "en", "src1", 0, 0.5, 7, "x"), (3, LONG, "en", "src0", 1, 0.5, 7, "x"), (4, LONG, None, None, 1, 0.5, 7, "x"),
    (5, "Ein kurzer Satz, all rights reserved.", "de", "src2", 1, None, None, None), (5, "Ein kurzer Satz, all rights reserved.", "de", "src2", 1, None, None, None),
    (None, "no id here at all", "en", "src3", 1, 0.1, 1, "y"), (6, "  \n\n \t ", "fr", "src3", 1, 0.1, 1, "y"), (7, "12345 !!!", "fr", "src3", 1, 0.1, 1, "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_licences(docs, none):
    rows = licenses.license_scan(docs).orderBy("doc_id").collect()
    assert len(rows) == len(ROWS) and licenses.license_scan(none).count() == 0
    five = [r for r in rows if r.doc_id == 5]
    assert five[0] == five[1] and five[0].base_labels == "reserved" and five[0].first_word == 3
    assert next(r for r in rows if r.doc_id == 1).n_words == 0


@pytest.mark.parametrize("text, postfix, grade", [("MIT OR GPL-2.0-only", "mit gpl-2.0-only or", 3), ("MIT AND GPL-2.0", "mit gpl-2.0 and", 1), ("(MIT OR Apache-2.0) AND GPL-3.0 WITH Classpath-exception-2.0", "mit apache-2.0 or gpl-3.0 classpath-exception-2.0 with and", 2), ("OR MIT", "", 0), ("MIT OR", "mit", 3), ("CC0-1.0", "cc0-1.0", 3), ("CC-BY-4.0", "cc-by-4.0", 2)])
def test_licence_expressions(text, postfix, grade):
    got = licenses.parse(text)
    assert " ".join(got) == postfix and licenses.evaluate(got) == grade


def test_languages(docs, none):
    langs, prototypes = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs, langs, prototypes).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[6].lang_pred == got[7].lang_pred == "und" and got[1].score == 0
    assert got[5].lang_pred == "de" and 0 <= got[5].score <= 1
    assert language.train(none) [0] == [] and language.predict(docs, *language.train(none)).where("lang_pred <> 'und'").count() == 0
    kept = language.recognised(docs, langs, prototypes)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, None}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark, docs, none):
    texts = ["card 4111 1111 1111 1111, again 4111-1111-1111-1111", "4111111111111112", "10.0.0.255 and 10.0.0.256", "born 1999-02-28, not 1999-02-30", "x.y12@mail.example.com", "+1 (212) 555-0123", "DE89370400440532013000", "plain", "DE89 3704 0044 0532 0130 00.", "call +49 30 12345678 or +44 20 7946 0958", "due 12/31/1999, not 13/31/1999", "api_key=sk_live_" + "a1B2" * 80 + " end", "token=ghp_abc-DEF.123456"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    a, b = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[0].text)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "4111111111111111" and luhn(re.sub(r"\D", "", a)) and got[0].n_replaced == 2
    assert got[1].text == texts[1] and got[7].text == "plain" and got[7].n_replaced == 0
    assert "10.0.0.255" not in got[2].text and "10.0.0.256" in got[2].text
    new = re.search(r"born (\S+),", got[3].text)[1]
    assert new != "1999-02-28" and datetime.date.fromisoformat(new) and "1999-02-30" in got[3].text
    assert got[4].text.endswith("@mail.example.com") and got[4].text != texts[4] and len(got[4].text) == len(texts[4])
    assert got[5].text.startswith("+1 (") and got[5].text != texts[5]
    moved = got[6].text[4:] + "1314" + got[6].text[2:4]
    assert got[6].text != texts[6] and int(moved) % 97 == 1
    spaced = got[8].text.replace(" ", "").rstrip(".")
    assert len(got[8].text) == len(texts[8]) and spaced != "DE89370400440532013000" and int(spaced[4:] + "1314" + spaced[2:4]) % 97 == 1
    assert "12345678" not in got[9].text and "7946 0958" not in got[9].text and got[9].n_replaced == 2 and got[9].text.startswith("call +49 ")
    assert "12/31/1999" not in got[10].text and "13/31/1999" in got[10].text and datetime.datetime.strptime(got[10].text[4:14], "%m/%d/%Y")
    assert "a1B2a1B2" not in got[11].text and got[11].text.startswith("api_key=") and got[11].text.endswith(" end") and len(got[11].text) == len(texts[11])
    assert "123456" not in got[12].text and got[12].text.startswith("token=")
    out = pseudonyms.pseudonymise(docs.withColumn("__old", F.lit("kept")), "k")
    assert out.select("__old").distinct().collect()[0][0] == "kept"
    out = pseudonyms.pseudonymise(docs, "k")
    assert set(docs.columns) < set(out.columns) and out.where("doc_id = 1").first().text is None and pseudonyms.pseudonymise(none, "k").count() == 0


def test_number_permutation_is_a_bijection(spark):
    got = spark.range(189 * 3).select(pseudonyms.permute_number(F.col("id"), "k", "date", 189, 3).alias("x")).collect()
    assert {r.x for r in got} == set(range(189 * 3))


def test_lines(docs, none, spark):
    out = lines.dedup_lines(docs)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, None) in got and (2, "") in got and (3, LONG) in got and (4, "") in got and out.count() == len(ROWS)
    assert sum(r.doc_id == 5 and r.text == ROWS[4][1] for r in out.collect()) == 2  # repeated rows are changed alike
    assert lines.dedup_lines(none).count() == 0
    near = "the quick brown fox jumps over the lazy dog while seven wizards box the jug of liquor in the yard and nobody else ever comes to look at it again before the long night falls"
    df = spark.createDataFrame([(1, near + "\nkeep me"), (2, "other words stand here\n" + near.upper() + "!"), (3, near.replace("nobody else ever comes", "nobody else ever came")), (4, "short one\nshort one")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert kept[1] == near + "\nkeep me" and kept[2] == "other words stand here" and kept[4] == "short one\nshort one"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.lists(st.integers(0, 3), max_size=70))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert lines.edit_distance(a, b) == row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(0, 9)), min_size=1, max_size=20))
def test_edits_in_blocks(pairs):
    most = np.array([m for _, _, m in pairs])
    xs, ys = ([np.array(p[k], np.uint64) for p in pairs] for k in (0, 1))
    assert lines.within(xs, ys, most).tolist() == [lines.edit_distance(a, b) <= m for a, b, m in pairs]


def test_jaccard(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.component_table(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (5, 2, 5), (6, 0, 6), (7, 1, 7)} < got and (None, 1, None) in got
    assert {c for d, _, c in got if d in (3, 4)} == {3} and jaccard.component_table(none).count() == 0


def test_mixing(docs, none):
    got = mixing.plan(docs, budget=F.lit(10_000).cast("long"), max_epochs=1)
    assert got.agg(F.sum("taken_tokens")).first()[0] == 10_000 and got.where("doc_id in (1, 2, 6)").count() == 0
    whole = mixing.plan(docs, budget=F.lit(10**9).cast("long"), max_epochs=2)
    assert whole.where("taken_tokens <> 2 * tokens").count() == 0 and mixing.plan(none).count() == 0


def test_shares_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 1000), ("d1", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.leaf_budget for r in mixing.budgets(leaves, F.lit(400).cast("long"), 1, {}, {}, {}).collect()}
    assert got == {"a": 10, "b": 90, "c": 100, "d": 200}


def test_packing(docs, none, spark):
    out = packing.packed(docs)
    pdf = out.toPandas().sort_values(["sequence_id", "offset"])
    for _, s in pdf.groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= packing.SEQUENCE
    assert packing.packed(none).count() == 0 and pdf[pdf.doc_id == 1].doc_tokens.tolist() == [1]
    ids = packing.sequences(packing.pieces(docs, tokens.vocabulary_path("byte_bpe_50k.json"))).agg(F.sum("n_tokens").alias("n"), F.sum(F.length("ids")).alias("b")).first()
    assert ids.b == 4 * ids.n == 4 * pdf.length.sum()


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(3)
    counts = {int(s): int(rng.integers(1, 40)) for s in rng.choice(np.arange(1, 257), 90, replace=False)}
    found = packing.patterns(counts, 256)
    assert all(sum(p.get(s, 0) * n for p, n in found) == c for s, c in counts.items())
    assert all(sum(s * c for s, c in p.items()) <= 256 for p, _ in found)
    assert sum(n for _, n in found) <= 1.03 * sum(s * c for s, c in counts.items()) / 256 + 2


def test_wavelet(docs, none):
    path = tokens.vocabulary_path("word_bpe_49k.json")
    table = wavelet.shards(docs, path, shard_tokens=5_000)
    rows = wavelet.documents(table).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]] and rows[0].doc_id is None
    assert wavelet.documents(wavelet.shards(none, path)).count() == 0


def test_wavelet_answers():
    ids = np.random.default_rng(2).integers(0, 300, 5000).astype(np.uint32)
    shard = wavelet.Shard(wavelet.pack(ids, np.array([1, 2]), np.array([True, True]), np.array([2000, 5000])))
    assert (shard.tokens() == ids).all() and [shard.access(i) for i in (0, 511, 512, 4999)] == ids[[0, 511, 512, 4999]].tolist()
    for token in (0, 7, 299, 511, 5000):
        assert shard.count(token) == (ids == token).sum() and shard.occurrences(token) == np.flatnonzero(ids == token).tolist()
        assert shard.count(token, 100, 1700) == (ids[100:1700] == token).sum()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aA bB.,'s\n\t éİΣσ12²)-\x85\x1c中ͅẞ", max_size=40))
def test_pieces_encode_like_whole_texts(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.encoder(tokens.vocabulary_path(name))
        assert e.ids([text]) == e._encode([text])


VECTORS = "vec_id long, embedding array<float>, label int, rank int"
INF, NAN = float("inf"), float("nan")


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], 1, 1), (50, [1.0, 0.0], 1, 1), (3, [0.99, 0.01], 1, 1), (4, None, 1, 1), (5, [0.0, 0.0], 1, 1), (6, [NAN, 1.0], 1, 1), (7, [INF, 1.0], 1, 1), (8, [None, 1.0], 1, 1), (9, [0.0, 1.0], 1, 1), (10, [1.0, 0.0, 0.0], 1, 1), (11, [], 1, 1)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got[0] == (2, 0, True) and got[50] == (2, 0, False) and got[3] == (2, 0, False) and got[9] == (0, 9, True) and got[10] == (0, 10, True)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 11))
    top = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.top_k(df, F.col("vec_id") % 50 == 0, 2).orderBy("query_id", "rank").collect()]
    assert top == [(0, 1, 50, 65536), (0, 2, 3, 64768), (50, 1, 0, 65536), (50, 2, 3, 64768)]
    empty = spark.createDataFrame([], VECTORS)
    assert vectors.near_duplicates(empty).count() == 0 and vectors.top_k(empty, F.lit(True), 5).count() == 0


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([(1, 1), (2, None)], "a long, b long")).count() == 0


def test_arrow_settings_stay_as_they_were(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    jaccard.component_table(docs).count()
    vectors.near_duplicates(spark.createDataFrame([(0, [1.0, 0.0], 1, 1)], VECTORS)).count()
    assert spark.conf.get(name) == before
