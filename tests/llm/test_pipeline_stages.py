"""Stages of the pipeline on planted rows, small cases, and plain rebuilds of their decisions."""

import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from proofloom.llm import language, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, size long, __gone string"
WORDS = "the small river runs past an old mill where nobody has lived since the long winter of that year and the road".split()
GERMAN = "der kleine Fluss läuft an einer alten Mühle vorbei in der seit dem langen Winter niemand mehr wohnt und die Straße".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def rows():
    rng = random.Random(5)
    out = [(k, prose(rng, GERMAN if k % 2 else WORDS, 20 + 3 * k) + f" number {k}", "de" if k % 2 else "en", f"src{k % 5}", 1, "r", 7, "g") for k in range(60)]
    gibberish = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(n)) for n in (20, 100, 500)]
    foreign = prose(rng, "Tämä on suomenkielinen lause jossa kerrotaan että talvella sataa lunta ja kesällä aurinko paistaa".split(), 200)
    out += [(100 + k, t, None, "src1", 1, "r", 7, "g") for k, t in enumerate([*gibberish, foreign, "", None, "12345"])]
    out += [(200, out[0][1], "en", "src0", 1, "r", 7, "g"), (None, "no id but words of the old mill and the river", "en", None, None, None, None, None), (0, out[0][1], "en", "src0", 1, "r", 7, "g")]
    return out


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(rows(), DOCS)


def test_language_rejects_gibberish_and_foreign_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, prototypes = language.train(docs)
    least = language.floors(docs, langs, prototypes)
    mixed = spark.createDataFrame([(d, t) for d, t, *_ in rows() if d is not None and 100 <= d < 200], "doc_id long, text string")
    assert language.recognised(mixed, langs, prototypes, least).count() == 0
    # whatever is labelled and of some length stays
    kept = {r.doc_id for r in language.recognised(docs, langs, prototypes, least).select("doc_id").collect()}
    long = {d for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall() if t and sum(map(str.isalpha, t)) > 200 and len(set(t.split())) > 30}
    assert long <= kept


def test_prototypes_are_the_sums_they_say(spark):
    """Trigrams cut, weighed and bundled by plain loops."""
    texts = [("one old mill", "en"), ("two old mills", "en"), ("eine alte Mühle", "de")]
    langs, got = language.train(spark.createDataFrame(texts, "text string, lang string"), dimensions=128)
    want = {}
    for text, lang in texts:
        grams = [g for w in text.lower().split() for g in zip(" " + w, w, w[1:] + " ", strict=False)]
        codes = np.array([((0 if a == " " else ord(a)) << 42) | (ord(b) << 21) | (0 if c == " " else ord(c)) for a, b, c in grams], np.uint64)
        total = sum(language.gram_vectors(np.array([c], np.uint64), 128, language.SEED)[0].astype(int) for c in codes)
        want[lang] = want.get(lang, 0) + total / len(codes)
    for k, lang in enumerate(langs):
        assert np.allclose(got[k], want[lang] / np.linalg.norm(want[lang]), atol=1e-5)


def test_every_stage_on_small_cases(spark, planted):
    docs, seen = planted, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        none = stage(spark, spark.createDataFrame([], docs.schema), SF)
        assert none.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            seen.append((name, [r.doc_id for r in docs.collect()]))
    ids = dict(seen)
    # 102 is longer than any labelled text here, so only the general least cosine holds for it
    assert not {100, 101, 104, 105, 106} & set(ids["language_id"]) and set(range(60)) <= set(ids["language_id"])
    assert ids["language_id"].count(0) == 2 and 200 in ids["language_id"] and None in ids["language_id"]
    assert sorted(x for x in ids["jaccard_join"] if x is not None) == sorted(set(x for x in ids["jaccard_join"] if x is not None)) and None in ids["jaccard_join"]


def test_unlabelled_documents(spark, planted):
    bare = planted.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert corpus_pipeline.language_id(spark, bare, SF).count() == 0


def test_packed_pieces_cover_what_is_left(spark):
    rows = queries.QUERIES["pipeline"](spark, SF).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in by_doc.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()] and sum(p[1] for p in pieces) == pieces[0][2]
