"""Readers on files that were not written by this library."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from proofloom.functions import derived
from proofloom.sources import readers


def test_payloads_over_lines_and_broken_ones(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "entity": 1,\n "claims": [\n  {"id": 10,\n   "priority": "a,\\n b"}, {"id": 11}\n ]\n}\n')
    (tmp_path / "many.json").write_text('[ {"entity": 2, "claims": []},\n\n {"entity": 3, "claims": [{"id": 30, "priority": "x"}], "more": {"y": 1}} ]')
    (tmp_path / "broken.json").write_text('{"entity": 4, "claims": [{"id": 40}')
    rows, rejects = readers.payloads(spark, str(tmp_path))
    assert {tuple(r) for r in rows.collect()} == {(1, 10, "a,\n b"), (1, 11, None), (2, None, None), (3, 30, "x")}
    assert [r.path.rsplit("/", 1)[1] for r in rejects.collect()] == ["broken.json"]


def test_blobs_are_hashed_as_they_are(spark, tmp_path):
    ledger = []
    for k, body in enumerate([b"no newline at the end", b"one\n", b"two\r\n\r\n", b"\xff\xfe\x00binary", b"tampered"]):
        name = sha256(body).hexdigest() if body != b"tampered" else sha256(b"other").hexdigest()
        (tmp_path / f"sha={name}").mkdir()
        (tmp_path / f"sha={name}" / "blob.txt").write_bytes(body)
        ledger += [(name,)] * (k % 2 + 1) if k < 4 else []
    got = readers.blobs(spark, str(tmp_path), spark.createDataFrame(ledger, "sha string")).collect()
    assert len(got) == 5 and sum(r.intact for r in got) == 4 and sum(r.in_ledger for r in got) == 4
    assert [r.in_ledger for r in got if not r.intact] == [False]


@pytest.mark.parametrize(("magnitude", "sign", "label", "want"), [
    (4, "SUPPORTS", "STATES-ON-FACE", (4, "SUPPORTS")), (4, "NEUTRAL", "ENTAILS", (3, "NEUTRAL")), (2, "UNDERCUTS", "ENTAILS", (2, "UNDERCUTS")),
    (3, "SUPPORTS", "UNDERCUTS", (3, "UNDERCUTS")), (3, "UNDERCUTS", "CONSISTENT-WITH-BOTH", (0, "UNDERCUTS")), (3, "SUPPORTS", None, (0, "SUPPORTS")),
])
def test_labels_only_lower_and_only_one_turns_the_sign(spark, magnitude, sign, label, want):
    df = spark.createDataFrame([(magnitude, sign, label)], "m int, s string, l string")
    assert tuple(df.select(*derived.demoted(F.col("m"), F.col("s"), F.col("l"))).first()) == want


def test_packed_blobs_are_hashed_as_they_are(spark, tmp_path):
    bodies = [b"no newline at the end", b"one\n", b"", b"\xff\xfe\x00binary", b"tampered"]
    packs = [(sha256(b if b != b"tampered" else b"other").hexdigest(), bytearray(b)) for b in bodies]
    spark.createDataFrame(packs, "name string, content binary").repartition(2).write.parquet(str(tmp_path / "packs"))
    got = {r.name_of_blob: (r.intact, r.in_ledger) for r in readers.packed_blobs(spark, str(tmp_path / "packs"), spark.createDataFrame([(packs[1][0],), (packs[1][0],)], "sha string")).collect()}
    assert got == {name: (bytes(b) != b"tampered", k == 1) for k, (name, b) in enumerate(packs)}


def test_blob_scan_writes_few_files(spark, tmp_path, monkeypatch):
    from proofloom.plans import loads
    from proofloom.plans.register import Register

    monkeypatch.setattr(loads, "_folder", lambda r: str(tmp_path / "blobs"))
    assert loads.blob_scan(Register(spark, "/root/testdata/sf0.001")).where("intact").count() > 50
    assert len(list((tmp_path / "blobs").rglob("*.parquet"))) <= spark.sparkContext.defaultParallelism
