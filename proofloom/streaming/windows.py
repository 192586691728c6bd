"""Structured Streaming jobs over the events folder, run to the end of the available data.

Each writes its result to the shared folder with a checkpoint beside it, so a restarted job goes on
where it stopped, and returns the written table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators.shared import cut

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _base(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        cut(spark.range(0), "base")  # makes and names a folder where none is set
        base = spark.conf.get("spark.checkpoint.dir")
    return f"{base}/proofloom/stream-{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str, schema, files: int | None = None) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them; files: how many a batch takes at most."""
    reader = spark.readStream.schema(schema) if files is None else spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may stand for a file, a plain path only for a folder


def events(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    return stream(spark, sf_dir, "events", SCHEMA, files)


def newest(out: DataFrame, keys: list[str]) -> DataFrame:
    """What update mode wrote batch by batch, each key as its last batch left it."""
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return last.select(*keys, "s.*")


def run(stream: DataFrame, base: str, mode: str = "update") -> DataFrame:
    """The stream, run over what is there; a batch goes to a folder of its number, so one that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{base}/out")


def daily_counts(spark: SparkSession, sf_dir: str, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts per event type and window; update mode, so windows that the watermark has passed leave the state."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    n = events(spark, sf_dir).withWatermark("ts", "1 day").groupBy(at, "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    out = newest(run(n.select("window.start", "event_type", "n", "cents"), _base(spark, "daily")), ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and how many there were: state as of the greatest event id, whatever the order of arrival. One row a user is state."""
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_event"), F.count("*").alias("events"))
    return newest(run(last, _base(spark, "latest")), ["user_id"])


def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's kind of event was first seen."""
    first = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))
    return newest(run(first, _base(spark, "first")), ["user_id", "event_type"])


def sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes", late: str = "1 day", files: int | None = None) -> DataFrame:
    """Sessions of users by the gap between their events. Append mode: a session is written once, when the watermark has passed it, and leaves the state.

    Those that the watermark has not passed when the data end are closed from the rows that no written session holds.
    """
    rows = events(spark, sf_dir, files)
    by = lambda df: df.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", "session_window.start", "session_window.end", "n")
    closed = run(by(rows.withWatermark("ts", late)), _base(spark, "sessions"), "append").drop("batch")
    held = closed.select(F.col("user_id").alias("u"), F.col("start").alias("from"), F.col("end").alias("to"))
    open_ = spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet").join(held, F.expr("user_id = u and ts >= `from` and ts < `to`"), "left_anti")
    return closed.unionByName(by(open_)).drop("end")


#: Days without an event after which a key's state is let go.
IDLE_DAYS = 400


class _Follower:
    """Keeps the last (number, value) of a key and tells each row apart: the first, a change, none, or late.

    A row whose number is below the last one seen comes late: it is told as such and moves nothing.
    An event-time timer lets the state go when nothing has come for IDLE_DAYS.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "number long, value string")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802
        import pandas as pd

        number, value = self.last.get() if self.last.exists() else (None, None)
        new = pd.concat(list(rows)).sort_values(["number", "value"], kind="stable")
        out = []
        for n, v in zip(new["number"].tolist(), new["value"].tolist(), strict=True):
            late = number is not None and n < number
            out.append((int(key[0]), n, None if late else value, v, late))
            if not late:
                number, value = n, v
        self.last.update((number, value))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(max(timer_values.getCurrentWatermarkInMs(), int(new["ts"].max().timestamp() * 1000)) + IDLE_DAYS * 86_400_000)
        yield pd.DataFrame(out, columns=["key", "number", "before", "value", "late"])

    def handleExpiredTimer(self, key, timer_values, expired):  # noqa: N802
        import pandas as pd

        self.last.clear()
        yield pd.DataFrame(columns=["key", "number", "before", "value", "late"])

    def close(self) -> None:
        pass


def followed(stream_: DataFrame, name: str) -> DataFrame:
    """Every row (key, number, ts, value) of a stream as key, number, before, value, late: what the key's value was before, nulls for its first row and for late ones.

    State is one number and value a key, with a timer; its store is RocksDB, which such state needs.
    """
    from pyspark.sql.streaming import StatefulProcessor

    spark, setting = stream_.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    follower = type("Follower", (_Follower, StatefulProcessor), {})
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        told = stream_.withWatermark("ts", "1 day").groupBy("key").transformWithStateInPandas(follower(), "key long, number long, before string, value string, late boolean", "append", "EventTime")
        return run(told, _base(spark, name), "append").drop("batch")
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def moves(spark: SparkSession, sf_dir: str, table: str, files: int | None = None) -> DataFrame:
    """proposition_id, seq, grade_from, grade, direction, late of every grade event that is not blind; `table` is the SELECT that makes grade events of the events stream."""
    shown = spark.sql(table, events=events(spark, sf_dir, files)).where("not blind")
    told = followed(shown.select(F.col("proposition_id").alias("key"), F.col("seq").alias("number"), F.col("occurred_at").alias("ts"), F.col("grade").alias("value")), "moves")
    a, b = exprs.grade_rank(F.col("before")), exprs.grade_rank(F.col("value"))
    direction = F.when(F.col("late"), F.lit(None)).when(F.col("before").isNull(), "first").when(F.col("before") == F.col("value"), "same").when(a.isNull() | b.isNull(), "kind").when(b > a, "up").otherwise("down")
    return told.select(F.col("key").alias("proposition_id"), F.col("number").alias("seq"), F.col("before").alias("grade_from"), F.col("value").alias("grade"), direction.alias("direction"), "late")


def drift(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """user_id, changes, late: how often the hash of what a user's events hold changed from one to the next, and how many came too late to tell."""
    content = F.sha2(F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")), 256)
    told = followed(events(spark, sf_dir, files).select(F.col("user_id").alias("key"), F.col("event_id").alias("number"), "ts", content.alias("value")), "drift")
    return told.groupBy(F.col("key").alias("user_id")).agg(F.count_if(F.col("before") != F.col("value")).alias("changes"), F.count_if("late").alias("late"))


def expired_leases(spark: SparkSession, sf_dir: str, taken: str, done: str, within: str = "30 minutes") -> DataFrame:
    """Leases that no finishing event of the same user followed in time: they return to the pending ones. Each batch is held against the static table."""
    base = _base(spark, "leases")
    ended = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == done).select(F.col("user_id").alias("u"), F.col("ts").alias("done_at"))

    def write(batch: DataFrame, epoch: int) -> None:
        leases = batch.where(F.col("event_type") == taken)
        late = leases.join(ended, F.expr(f"user_id = u and done_at >= ts and done_at <= ts + interval {within}"), "left_anti")
        late.select("event_id", "user_id").write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    events(spark, sf_dir).writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
