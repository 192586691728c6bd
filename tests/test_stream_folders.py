"""Streams over a table that is a folder of several files, in several batches, with late rows."""

import pytest
from pyspark.sql import functions as F

from proofloom.streaming import windows

ROWS = [(k, f"2024-01-{1 + k // 24:02} {k % 24:02}:00:00", k % 3, "view" if k % 4 else "click", float(k), '{"k": "%d"}' % (k % 5)) for k in range(90)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files; the second holds rows that are older than some of the first."""
    import os
    import time

    base = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame(ROWS, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    target = base / "events.parquet"
    for n, cond in enumerate(["event_id < 40 and event_id % 10 <> 7 or event_id between 50 and 55", "event_id % 10 = 7 and event_id < 40 or event_id between 40 and 49", "event_id > 55"]):
        df.where(cond).coalesce(1).write.mode("append").parquet(str(target))
        now = time.time() + n * 10
        for f in target.glob("*.parquet"):
            if f.stat().st_mtime > time.time() - 5 and not (base / f"seen-{f.name}").exists():
                os.utime(f, (now, now))
                (base / f"seen-{f.name}").touch()
    return str(base)


def test_every_row_is_read_from_a_folder(spark, folder):
    got = {r.user_id: r.events for r in windows.latest_state(spark, folder).collect()}
    assert got == {0: 30, 1: 30, 2: 30}


def test_late_rows_are_told_and_move_nothing(spark, folder):
    """Batch twin: rows in the order of the files; within a file by number."""
    first = {e for e in range(90) if e < 40 and e % 10 != 7 or 50 <= e <= 55}
    second = {e for e in range(90) if e % 10 == 7 and e < 40 or 40 <= e <= 49}
    want, last = set(), {}
    for batch in (sorted(first), sorted(second), range(56, 90)):
        for e in batch:
            late = e % 3 in last and e < last[e % 3][0]
            value = "view" if e % 4 else "click"
            want.add((e % 3, e, None if late else last.get(e % 3, (0, None))[1], value, late))
            if not late:
                last[e % 3] = (e, value)
    stream = windows.events(spark, folder, 1).select(F.col("user_id").alias("key"), F.col("event_id").alias("number"), "ts", F.col("event_type").alias("value"))
    got = {tuple(r) for r in windows.followed(stream, "twin").select("key", "number", "before", "value", "late").collect()}
    assert got == want and any(r[-1] for r in got)
