"""Grade history: latest, as-of, movement, ratchet and state hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab

def _by_seq():
    return Window.partitionBy("proposition_id").orderBy("seq")



def latest(events: DataFrame, until: Column | None = None) -> DataFrame:
    """The last non-blind event of each proposition, up to a time if one is given."""
    shown = events.where("not blind")
    if until is not None:
        shown = shown.where(F.col("occurred_at") <= until)
    last = shown.groupBy("proposition_id").agg(F.max_by(F.struct("seq", "grade", "occurred_at", "cause"), F.struct("occurred_at", "seq")).alias("e"))
    return last.select("proposition_id", "e.seq", "e.grade", "e.occurred_at", "e.cause")


def as_of(events: DataFrame, times: DataFrame) -> DataFrame:
    """times (proposition_id, t) with the grade that held at t; X before the first event."""
    held = times.join(events.where("not blind"), "proposition_id", "left").where("occurred_at is null or occurred_at <= t")
    best = held.groupBy("proposition_id", "t").agg(F.max_by("grade", F.struct("occurred_at", "seq")).alias("grade"))
    return times.join(best, ["proposition_id", "t"], "left").select("proposition_id", "t", F.coalesce("grade", F.lit("X")).alias("grade"))


def history(events: DataFrame, with_drift: bool = True) -> DataFrame:
    """Events with the grade before, the direction of the move and whether it is instrument drift."""
    e = events.where("not blind").withColumn("grade_from", F.lag("grade").over(_by_seq())).withColumn("drift", F.col("cause").isin(vocab.DRIFT_CAUSES))
    a, b = exprs.grade_rank(F.col("grade_from")), exprs.grade_rank(F.col("grade"))
    direction = F.when(F.col("grade_from").isNull(), "first").when(F.col("grade_from") == F.col("grade"), "same").when(a.isNull() | b.isNull(), "kind").when(b > a, "up").otherwise("down")
    out = e.withColumn("direction", direction)
    return out if with_drift else out.where("not drift")


def ratchet_holds(events: DataFrame) -> DataFrame:
    """History with `held`: a rise whose cause is not exempt and that no new disclosure preceded is held back."""
    h = history(events)
    disclosed = F.max((F.col("cause") == "NEW-DISCLOSURE").cast("int")).over(_by_seq().rowsBetween(Window.unboundedPreceding, 0)) == 1
    return h.withColumn("held", (F.col("direction") == "up") & ~F.col("cause").isin(vocab.EXEMPT_CAUSES) & ~disclosed)


def state_hash(obs: DataFrame) -> DataFrame:
    """proposition_id with a hash of its rows' states, the same in any order and made without bringing rows together."""
    line = F.concat_ws("|", "observation_id", "membership", F.col("magnitude").cast("string"), "sign")
    return obs.groupBy("proposition_id").agg(F.count("*").alias("n"), exprs.key_digest(line).alias("h")).select("proposition_id", F.md5(F.concat_ws(":", "n", "h")).alias("state_hash"))


def change_set(obs: DataFrame, changed_documents: DataFrame, roots: DataFrame, propositions: DataFrame) -> DataFrame:
    """Propositions to regrade when documents change: those with a row in any touched citation component; EXIST first."""
    touched = changed_documents.join(roots.withColumnRenamed("node", "document_id"), "document_id", "left").select(F.coalesce("root", "document_id").alias("root")).distinct()
    members = roots.withColumnRenamed("node", "document_id").join(touched, "root", "left_semi").select("document_id").unionByName(changed_documents.select("document_id")).distinct()
    dirty = obs.join(members, "document_id", "left_semi").select("proposition_id").distinct()
    return propositions.join(dirty, "proposition_id", "left_semi").select("proposition_id", F.when(F.col("class") == "EXIST", 10).otherwise(100).alias("priority"))


# ---- moving state: rollups, events, snapshots, drains


def triggering(obs: DataFrame, before: DataFrame) -> DataFrame:
    """Rows that were asserted after the last grading of their proposition (before: proposition_id, graded_on); all rows where there was none."""
    o = obs.join(before.select("proposition_id", "graded_on"), "proposition_id", "left")
    return o.where(F.col("graded_on").isNull() | (F.col("asserted_on") > F.col("graded_on"))).select("proposition_id", "observation_id", "document_id", "document_date", "membership", "echo")


def ratchet(now: DataFrame, before: DataFrame, arrived: DataFrame, publications: DataFrame, cause: Column) -> DataFrame:
    """now (proposition_id, entity_id, final) with grade_before, published grade and whether a rise was held back.

    A rise between ranked grades stands if its cause is exempt, if the entity was never published, or if a
    supporting row that arrived is dated at or before the first publication and is no echo of the register.
    """
    first = publications.groupBy("entity_id").agg(F.min("first_published").alias("first_published"))
    n = now.join(before.select("proposition_id", F.col("grade").alias("grade_before")), "proposition_id", "left").join(first, "entity_id", "left")
    dated = arrived.where("membership = 'V' and document_date is not null and not echo").groupBy("proposition_id").agg(F.min("document_date").alias("oldest"))
    n = n.join(dated, "proposition_id", "left").withColumn("cause", cause)
    a, b = exprs.grade_rank(F.col("grade_before")), exprs.grade_rank(F.col("final"))
    rises = F.coalesce(b > a, F.lit(False)) & ~F.col("cause").isin(vocab.EXEMPT_CAUSES)
    carried = F.col("first_published").isNull() | F.coalesce(F.col("oldest") <= F.col("first_published"), F.lit(False))
    return n.withColumn("held", rises & ~carried).withColumn("published", F.when(F.col("held"), F.col("grade_before")).otherwise(F.col("final")))


def new_events(rated: DataFrame, log: DataFrame) -> DataFrame:
    """Events to append: first grades and changes, numbered within their proposition after what its log holds."""
    upto = log.groupBy("proposition_id").agg(F.count("*").alias("held_events"))
    moved = rated.where(F.col("grade_before").isNull() | (F.col("grade_before") != F.col("published")))
    return moved.join(upto, "proposition_id", "left").select("proposition_id", (F.coalesce("held_events", F.lit(0)) + 1).alias("event_no"), F.col("grade_before").alias("grade_from"), F.col("published").alias("grade"), "cause")


def snapshot(events: DataFrame, obs: DataFrame) -> DataFrame:
    """The evidence as it stood when each event was written."""
    return events.select("proposition_id", "event_no").join(obs.select("proposition_id", "observation_id", "membership", "signed_weight"), "proposition_id")
