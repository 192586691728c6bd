"""Regrading what a change touches: dirty keys, grades of chosen keys from their own evidence, and the drain.

A rollup holds a proposition's own grade and its final one, clamped by its parent. Grades of some
keys are computed from the rows of these keys alone: every table is semi-joined with the keys, or
with what the keys refer to, before anything is aggregated, so the work of a regrade follows what
changed. Whether a candidate set's program is good enough is the one thing that grades read of other
propositions, so programs of touched sets are graded beside the keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence, graph, score
from .shared import cut, having, marks

#: Priorities of dirty propositions: parents of others first.
FIRST, OTHERS, SETS = 10, 100, 150
#: Levels of children that are followed one by one; beyond, the whole rollup is clamped by doubling.
LEVELS = 6
#: From this part of all propositions on, a regrade reads all rows once instead of picking those of its keys.
MOST = 1 / 8


@dataclass(frozen=True)
class Evidence:
    """The tables that grades are computed from; members: those of candidate sets, where propositions are only some of them."""

    propositions: DataFrame
    raw: DataFrame
    documents: DataFrame
    citations: DataFrame
    profiles: DataFrame
    witnesses: DataFrame
    sets: DataFrame
    members: DataFrame | None = None

    def roots(self) -> DataFrame:
        return graph.components(self.citations.where("collapses"))

    def of(self, keys: DataFrame) -> Evidence:
        """What propositions with these keys read; sets and citations stay."""
        marked = marks(keys)
        near = lambda df: having(df, keys, marked)
        raw = cut(near(self.raw), "raw-of-keys")
        documents = self.documents.join(raw.select("document_id").distinct(), "document_id", "left_semi")
        return Evidence(near(self.propositions), raw, documents, self.citations, near(self.profiles), self.witnesses, self.sets)

    def wide(self, roots: DataFrame) -> DataFrame:
        """Every count and flag of all propositions, written once."""
        witnesses = cut(self.witnesses, "witnesses")  # a few rows out of many: read once
        counts = evidence.all_counts(self.raw, self.documents, self.propositions, roots, witnesses)
        return cut(score.gather(self.propositions, counts, self.profiles), "wide")


def _column(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def grade_own(e: Evidence, roots: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """ROLLUP less `final` of all propositions, and the named counts: grades before their parents clamp them."""
    wide = e.wide(roots)
    sets = score.candidate_sets(e.members, score.evaluate(wide), e.sets)
    return score.evaluate(wide, sets.select("candidate_set_id", "program_ok")).select(*ROLLUP[:-1], *more)


def grade_all(e: Evidence, roots: DataFrame) -> DataFrame:
    """The rollup from scratch: proposition_id, entity_id, class, parent_id, candidate_set_id, grade, final."""
    return score.clamp(grade_own(e, roots)).select(*ROLLUP)


ROLLUP = ["proposition_id", "entity_id", "class", "parent_id", "candidate_set_id", "grade", "final"]


def _most(keys: DataFrame, of: DataFrame) -> bool:
    return keys.count() >= MOST * of.count()


def _part(e: Evidence, roots: DataFrame, keys: DataFrame) -> tuple[Evidence, DataFrame]:
    """(evidence, roots) that grades of the keys (proposition_id) read: of the keys and of programs in their candidate sets."""
    asked = e.propositions.join(keys, "proposition_id", "left_semi")
    touched = cut(_column(asked.where("candidate_set_id is not null"), "candidate_set_id"), "touched-sets")
    members = e.propositions.join(touched, "candidate_set_id", "left_semi")
    programs = members.where("class = 'PROGRAM'").select("proposition_id")
    scope = cut(keys.select("proposition_id").unionByName(programs).distinct(), "scope")
    if _most(scope, e.propositions):  # rows of other propositions fall out where rows meet their proposition
        near = lambda df: df.join(scope, "proposition_id", "left_semi")
        return replace(e, propositions=near(e.propositions), profiles=near(e.profiles), members=members), roots
    part = replace(e.of(scope), members=members)
    return part, roots.join(_column(part.raw, "document_id").withColumnRenamed("document_id", "node"), "node", "left_semi")


def grade_keys(e: Evidence, roots: DataFrame, keys: DataFrame) -> DataFrame:
    """ROLLUP less `final` of the keys (proposition_id), from their own evidence."""
    return grade_own(*_part(e, roots, keys)).join(keys, "proposition_id", "left_semi")


def dirty_keys(e: Evidence, rows: DataFrame | None = None, documents: DataFrame | None = None, roots: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(proposition_id, reason, priority) of what a change makes dirty, each key once under its first reason.

    rows: proposition_id of rows that came, went or changed. documents: document_id of changed ones.
    roots: components before and after; documents whose root moved are changed ones, and so is every
    proposition with a row in either of two components that met or parted.
    """
    parts = []
    if rows is not None:
        parts.append(rows.select("proposition_id", F.lit("evidence").alias("reason")))
    of_documents = lambda d, why: e.raw.join(d.distinct(), "document_id", "left_semi").select("proposition_id", F.lit(why).alias("reason"))
    if documents is not None:
        parts.append(of_documents(documents.select("document_id"), "document"))
    if roots is not None:
        before, after = (r.select(F.col("node").alias("document_id"), F.col("root").alias(name)) for r, name in zip(roots, ("was", "now"), strict=True))
        moved = before.join(after, "document_id", "full_outer").where("coalesce(was, document_id) <> coalesce(now, document_id)")
        # a component that changed at all is dirty as a whole: its other members count lineages with those that moved
        ends = moved.select(F.col("was").alias("root")).unionByName(moved.select(F.col("now").alias("root"))).where("root is not null").distinct()
        inside = after.withColumnRenamed("now", "root").join(ends, "root", "left_semi").select("document_id")
        parts.append(of_documents(moved.select("document_id").unionByName(inside), "lineage"))
    found = reduce(DataFrame.unionByName, parts).groupBy("proposition_id").agg(F.min("reason").alias("reason"))
    kinds = e.propositions.select("proposition_id", "class")
    return found.join(kinds, "proposition_id").select("proposition_id", "reason", F.when(F.col("class") == "EXIST", FIRST).otherwise(OTHERS).alias("priority"))


def drain(stored: DataFrame, e: Evidence, roots: DataFrame, dirty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rollup, regraded): the stored rollup with dirty keys, and all that hangs on them, graded again.

    Dirty keys are graded first; where a program crosses the line between B and C the members of
    its set follow. Then final grades are carried down from whatever moved, to children as far as they move.
    """
    keys, regraded = cut(_column(dirty, "proposition_id"), "dirty"), None
    while not keys.isEmpty():
        now = cut(grade_keys(e, roots, keys), "regraded")
        before = stored.select("proposition_id", F.col("grade").alias("was"))
        strong = lambda c: F.coalesce(F.col(c).isin("A", "B"), F.lit(False))
        crossed = now.where("class = 'PROGRAM' and candidate_set_id is not null").join(before, "proposition_id", "left").where(strong("was") != strong("grade"))
        regraded = now if regraded is None else regraded.unionByName(now)
        members = e.propositions.join(_column(crossed, "candidate_set_id"), "candidate_set_id", "left_semi").select("proposition_id")
        keys = cut(members.distinct().join(regraded.select("proposition_id"), "proposition_id", "left_anti"), "dirty")
    if regraded is None:
        return stored, stored.where("false").select("proposition_id")
    rest = stored.join(regraded.select("proposition_id"), "proposition_id", "left_anti")
    own = cut(rest.select(*ROLLUP).unionByName(regraded.join(stored.select("proposition_id", "final"), "proposition_id", "left").select(*ROLLUP)), "rollup-own")
    whole = _most(regraded, own)
    return cut(score.clamp(own.drop("final")).select(*ROLLUP) if whole else _carried(own, regraded.select("proposition_id")), "rollup"), regraded.select("proposition_id")


def _carried(own: DataFrame, keys: DataFrame) -> DataFrame:
    """own with final grades put right for the keys and for their children, where these move."""
    ended = own
    for _ in range(LEVELS):
        level = own.join(keys, "proposition_id", "left_semi")
        parents = ended.join(_column(level.where("parent_id is not null"), "parent_id").withColumnRenamed("parent_id", "proposition_id"), "proposition_id", "left_semi")
        parents = parents.join(keys, "proposition_id", "left_anti")  # of two dirty generations the parents' are not known yet
        fixed = parents.select(*(F.lit(None).cast(t).alias(c) if c == "parent_id" else F.col("final").alias(c) if c == "grade" else F.col(c) for c, t in own.dtypes if c != "final"))
        put = cut(score.clamp(level.drop("final").unionByName(fixed)).join(keys, "proposition_id", "left_semi").select(*ROLLUP), "carried")
        was = ended.join(keys, "proposition_id", "left_semi").select("proposition_id", F.col("final").alias("was"))
        moved = put.join(was, "proposition_id").where(~F.col("was").eqNullSafe(F.col("final"))).select(F.col("proposition_id").alias("parent_id"))
        ended = cut(ended.join(put.select("proposition_id"), "proposition_id", "left_anti").unionByName(put), "carried-all")
        keys = cut(own.join(moved, "parent_id", "left_semi").join(put.select("proposition_id"), "proposition_id", "left_anti").select("proposition_id"), "children")
        if keys.isEmpty():
            return ended
    return score.clamp(own.drop("final")).select(*ROLLUP)


# ---- other worlds


def grade_worlds(e: Evidence, roots: DataFrame, worlds: dict[str, Callable[[Evidence], Evidence]], more: tuple[str, ...] = ()) -> DataFrame:
    """(world, ROLLUP less `final`, the named counts) of several worlds, graded in one pass.

    A world changes propositions, rows, profiles, sets or their members; documents, citations and witnesses are
    shared. The keys of each world's rows carry its number, so that counts, lineages and sets of all worlds
    are made by the same shuffles and never mix.
    """
    names = list(worlds)
    key = lambda c, k: (F.col(c) * len(names) + k).alias(c)
    keyed = lambda df, k: df.select(*(key(c, k) if c in ("proposition_id", "parent_id", "candidate_set_id") else c for c in df.columns))
    each = [worlds[name](e) for name in names]
    both = lambda what: reduce(DataFrame.unionByName, (keyed(getattr(w, what), k) for k, w in enumerate(each)))
    joint = Evidence(both("propositions"), both("raw"), e.documents, e.citations, both("profiles"), e.witnesses, both("sets"), None if e.members is None else both("members"))
    own = lambda c: F.expr(f"{c} div {len(names)}").alias(c)
    world = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col("proposition_id"), F.lit(len(names))) + 1).cast("int"))
    graded = grade_own(joint, roots, more)
    return graded.select(world.alias("world"), *(own(c) if c in ("proposition_id", "parent_id", "candidate_set_id") else c for c in graded.columns))


def leads_verified(e: Evidence) -> Evidence:
    """The world in which every lead that is still unresolved turns out as it says."""
    return replace(e, raw=e.raw.withColumn("receipt_state", F.when(F.col("receipt_state") == "UNRESOLVED", "VERIFIED").otherwise(F.col("receipt_state"))))


def second_null(e: Evidence, null_id: Column) -> Evidence:
    """The world in which propositions are held against another null, as one that was selected."""
    return replace(e, propositions=e.propositions.withColumns({"null_id": null_id, "null_selected": F.lit(True)}))


def _into(merges: DataFrame) -> DataFrame:
    """(entity_id, root) of entities that merges (a, b) name: what they connect is one, an entity merged with itself is one by itself."""
    alone = merges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    both = graph.components(merges, "a", "b").unionByName(alone)
    return cut(both.groupBy(F.col("node").alias("entity_id")).agg(F.min("root").alias("root")), "into")


def _least(p: DataFrame, identity: list[str]) -> DataFrame:
    """root, identity, least and pooled: what propositions (beside the root of their entity) that agree in `identity` become, and how many they are."""
    return p.where("root is not null").groupBy("root", *identity).agg(F.min("proposition_id").alias("least"), F.count("*").alias("pooled"))


def grade_merged(e: Evidence, roots: DataFrame, merges: DataFrame, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """(graded, named): grades of propositions that a merge of entities would pool, as they are (world `now`) and as it makes them
    (world `merged`), and (proposition_id, target) of these propositions. Others may stand beside them in graded.

    All others keep the rows that they have, so the work follows what is pooled: both worlds are graded in one pass
    over the rows of these propositions and of the programs that their candidate sets depend on.
    """
    into = _into(merges)
    e = replace(e, propositions=cut(e.propositions, "propositions"))  # windows over all of them, read several times
    p = cut(e.propositions.select("proposition_id", "entity_id", *identity).join(into, "entity_id"), "near")
    named = p.join(_least(p, identity).where("pooled > 1"), ["root", *identity])
    named = cut(named.select("proposition_id", F.col("least").alias("target")), "pooled")
    part, near = _part(e, roots, named.select("proposition_id"))
    return grade_worlds(part, near, {"now": lambda w: w, "merged": lambda w: merged(w, into, identity)[0]}), named


def merged(e: Evidence, into: DataFrame, identity: list[str]) -> tuple[Evidence, DataFrame]:
    """The world in which entities are merged, and (proposition_id, target): which proposition each one's rows go to.

    into: entity_id, root. Propositions of a merged entity that agree in `identity` are one, named by the least
    of them: its rows are those of all, its profiles its own. A parent that becomes the proposition itself is none.
    """
    p = e.propositions.join(into, "entity_id", "left").withColumn("whole", F.coalesce("root", "entity_id"))
    named = p.join(_least(p, identity), ["root", *identity], "left").withColumn("target", F.coalesce("least", "proposition_id"))
    named = cut(named.select("proposition_id", "target", "whole"), "targets")
    heads = named.where("proposition_id = target").select("proposition_id", F.col("whole").alias("into"))
    to = named.select(F.col("proposition_id").alias("parent_id"), F.col("target").alias("up"))
    propositions = e.propositions.join(heads, "proposition_id").join(to, "parent_id", "left")
    propositions = propositions.select(*(F.col("into").alias(c) if c == "entity_id" else F.when(F.coalesce("up", "parent_id") != F.col("proposition_id"), F.coalesce("up", "parent_id")).alias(c) if c == "parent_id" else c for c in e.propositions.columns))
    raw = e.raw.join(named.select("proposition_id", "target"), "proposition_id").select(*(F.col("target").alias(c) if c == "proposition_id" else c for c in e.raw.columns))
    members = e.members
    if members is not None:  # those that are not among the propositions stay, in their merged entity
        gone = named.where("proposition_id <> target").select("proposition_id")
        members = members.join(gone, "proposition_id", "left_anti").join(into, "entity_id", "left").select(*(F.coalesce("root", "entity_id").alias(c) if c == "entity_id" else c for c in members.columns))
    return replace(e, propositions=propositions, raw=raw, profiles=e.profiles.join(heads, "proposition_id", "left_semi"), members=members), named.select("proposition_id", "target")
