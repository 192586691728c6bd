"""The register's streams: observations as they arrive, and leads that meet receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, regrade
from ..sources import fixture
from .windows import _base, events, newest, stream


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the line-item stream as observations with membership, built batch by batch against the static documents.

    Each batch goes to a folder of its own number, so a batch that is run again replaces itself.
    """
    base = _base(spark, "membership")
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    rows = stream(spark, sf_dir, "lineitem", schema, 1)

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        raw = session.sql(fixture.TABLES["raw_observation"], lineitem=batch)
        obs = evidence.build_observations(raw, fixture.table(session, sf_dir, "document"), fixture.table(session, sf_dir, "proposition"))
        obs.select("observation_id", "proposition_id", "membership", "signed_weight").write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    rows.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def leads_with_receipts(spark: SparkSession, sf_dir: str, lead: str, receipt: str, within: str = "1 hour") -> DataFrame:
    """Stream-stream interval join: each lead with the same user's receipts that follow within the time."""
    base = _base(spark, "leads")
    leads = events(spark, sf_dir).where(F.col("event_type") == lead).select(F.col("user_id"), F.col("event_id").alias("lead_id"), F.col("ts").alias("lead_at")).withWatermark("lead_at", "1 day")
    receipts = events(spark, sf_dir).where(F.col("event_type") == receipt).select(F.col("user_id").alias("receipt_user"), F.col("event_id").alias("receipt_id"), F.col("ts").alias("receipt_at")).withWatermark("receipt_at", "1 day")
    joined = leads.join(receipts, F.expr(f"user_id = receipt_user and receipt_at >= lead_at and receipt_at <= lead_at + interval {within}"))
    joined.select("user_id", "lead_id", "receipt_id").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, lead_id long, receipt_id long").parquet(f"{base}/out")


def incremental_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proposition_id, n_v, n_u, grade, final, kept up batch by batch as line items arrive.

    A batch's rows go to a log, split by the hash of their proposition, and their counts are added to
    those stored. Its propositions are dirty: they are graded again from their own rows of the log, and
    what hangs on them follows. Only rows of the rollup that moved are written, under the batch's number, so
    a batch that is run again replaces itself.
    """
    base = _base(spark, "regrade")
    rows = stream(spark, sf_dir, "lineitem", spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema, 1)
    part = F.pmod(F.xxhash64("proposition_id"), F.lit(LOG_PARTS)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        table = lambda name: fixture.table(session, sf_dir, name)
        raw = session.sql(fixture.TABLES["raw_observation"], lineitem=batch)
        raw.withColumn("part", part).write.partitionBy("part").mode("overwrite").parquet(f"{base}/log/batch={epoch}")
        arrived = session.read.parquet(f"{base}/log/batch={epoch}").drop("part")
        obs = evidence.build_observations(arrived, table("document"), table("proposition"))
        obs.groupBy("proposition_id").agg(F.count_if(F.col("membership") == "V").alias("n_v"), F.count_if(F.col("membership") == "U").alias("n_u")).write.mode("overwrite").parquet(f"{base}/counts/batch={epoch}")
        log = session.read.parquet(f"{base}/log").where(F.col("batch") <= epoch).select(*raw.columns)
        now = regrade.Evidence(table("proposition"), log, table("document"), table("citation"), table("profile"), table("witness"), table("candidate_set"))
        if not _exists(session, f"{base}/roots"):
            now.roots().write.mode("overwrite").parquet(f"{base}/roots")
        roots = session.read.parquet(f"{base}/roots")
        if epoch == 0:
            stored, dirty = _rollup(session, None), now.propositions
        else:
            stored, dirty = _rollup(session, f"{base}/rollup", epoch), arrived.select("proposition_id")
        rollup, _ = regrade.drain(stored, now, roots, dirty)
        rollup.exceptAll(stored.select(*rollup.columns)).write.mode("overwrite").parquet(f"{base}/rollup/batch={epoch}")

    rows.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(f"{base}/counts").groupBy("proposition_id").agg(F.sum("n_v").alias("n_v"), F.sum("n_u").alias("n_u"))
    return counts.join(_rollup(spark, f"{base}/rollup").select("proposition_id", "grade", "final"), "proposition_id")


#: Parts of the log of observations.
LOG_PARTS = 16


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _rollup(spark: SparkSession, path: str | None, before: int | None = None) -> DataFrame:
    """The rollup as the batches before a number left it, of what each wrote."""
    if path is None:
        return spark.createDataFrame([], "proposition_id long, entity_id long, class string, parent_id long, candidate_set_id long, grade string, final string")
    written = spark.read.parquet(path)
    return newest(written if before is None else written.where(F.col("batch") < before), ["proposition_id"])
