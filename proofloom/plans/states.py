"""Queries on state that moves: rollups, ratchet, events, snapshots, plans of publication."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import evidence, graph, regrade, state
from ..operators.shared import cut
from .oracle import world
from .register import Register
from .registry import query

_SHOWN = "publication_state = 'PUBLISHED' and not is_canary"
_RANK = "case {} when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 end"
_CAUSE = "case proposition_id % 6 when 0 then 'NEW-DISCLOSURE' when 1 then 'SCORER-CHANGE' else 'NEW-SEARCH' end"
_RATED = f"""arrived as (select o.*, graded_on from obs o left join (select proposition_id, graded_on from rollup_before) b using (proposition_id) where graded_on is null or asserted_on > graded_on),
oldest as (select proposition_id, min(document_date) as oldest from arrived where membership = 'V' and document_date is not null and not echo group by 1), firsts as (select entity_id, min(first_published) as first_published from publication group by 1),
rated0 as (select proposition_id, entity_id, f.final, b.grade as grade_before, {_CAUSE} as cause, coalesce({_RANK.format('f.final')} > {_RANK.format('b.grade')}, false) and ({_CAUSE}) not in ('SCORER-CHANGE', 'TABLE-VERSION-CHANGE', 'RESCORE-NOISE', 'NEW-DISCLOSURE', 'MERGE', 'SPLIT') and first_published is not null and not coalesce(oldest <= first_published, false) as held
  from final f left join rollup_before b using (proposition_id) left join firsts using (entity_id) left join oldest using (proposition_id)),
rated as (select *, case when held then grade_before else final end as published from rated0),
moved as (select proposition_id, coalesce(n, 0) + 1 as event_no, grade_before as grade_from, published as grade, cause from rated left join (select proposition_id, count(*) as n from grade_event group by 1) l using (proposition_id) where grade_before is null or grade_before <> published)"""


def _rated(r: Register) -> DataFrame:
    before = r.table("rollup_before")
    return cut(state.ratchet(r.final.select("proposition_id", "entity_id", "final"), before, state.triggering(r.observations, before), r.table("publication"), F.expr(_CAUSE)), "rated")


@query(_RATED + "=> select proposition_id, grade_before, final, published, held from rated", "graded")
def published_rollup(r: Register) -> DataFrame:
    """The rollup as it is published: final grades, but rises that the ratchet holds back stay where they were."""
    return _rated(r).select("proposition_id", "grade_before", "final", "published", "held")


@query(_RATED + "=> select proposition_id, event_no, grade_from, grade, cause from moved", "graded")
def appended_events(r: Register) -> DataFrame:
    return state.new_events(_rated(r), r.table("grade_event")).select("proposition_id", "event_no", "grade_from", "grade", "cause")


@query(_RATED + "=> select proposition_id, event_no, membership, count(*) as n, sum(signed_weight)::bigint as weight from moved join obs using (proposition_id) group by 1, 2, 3", "graded")
def event_snapshots(r: Register) -> DataFrame:
    events = state.new_events(_rated(r), r.table("grade_event"))
    return state.snapshot(events, r.observations).groupBy("proposition_id", "event_no", "membership").agg(F.count("*").alias("n"), F.sum("signed_weight").alias("weight"))


@query("=> select proposition_id, parent_id, grade as grade_before, final as grade_after from final where final <> grade", "graded")
def clamp_events(r: Register) -> DataFrame:
    return r.final.where("clamped").select("proposition_id", "parent_id", F.col("grade").alias("grade_before"), F.col("final").alias("grade_after"))


@query(_RATED.split("oldest as")[0].rstrip().rstrip(",") + "=> select proposition_id, count(*) as n, min(observation_id) as first_id, max(observation_id) as last_id from arrived group by 1", "obs")
def triggering_rows(r: Register) -> DataFrame:
    t = state.triggering(r.observations, r.table("rollup_before"))
    return t.groupBy("proposition_id").agg(F.count("*").alias("n"), F.min("observation_id").alias("first_id"), F.max("observation_id").alias("last_id"))


#: The evidence before the last change: rows that came since, documents that were still pending and citations that were not known.
_EARLIER = {
    "raw_observation": "asserted_on < date '1998-08-20'",
    "citation": "not (citing % 97 = 5 and citing > cited)",
    "pending": "document_id % 211 = 3",
}
_BEFORE = f"""raw_old as (select * from raw_observation where {_EARLIER['raw_observation']}), citation_old as (select * from citation where {_EARLIER['citation']}),
document_old as (select * replace (case when {_EARLIER['pending']} then 'PENDING' else tier end as tier) from document),
""" + world("old_final", {"raw_observation": "select * from raw_old", "citation": "select * from citation_old", "document": "select * from document_old"}, "select proposition_id, final from final")


def _earlier(e: regrade.Evidence) -> regrade.Evidence:
    tier = F.when(F.expr(_EARLIER["pending"]), "PENDING").otherwise(F.col("tier"))
    return replace(e, raw=e.raw.where(_EARLIER["raw_observation"]), citations=e.citations.where(_EARLIER["citation"]), documents=e.documents.withColumn("tier", tier))


def _drained(r: Register) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, rollup, regraded): a rollup graded before the last change, and what the drain makes of it from the evidence as it is now."""
    now, was = r.evidence, _earlier(r.evidence)
    before = was.roots()
    stored = cut(regrade.grade_all(was, before), "stored")
    changed = now.documents.join(was.documents.select("document_id", F.col("tier").alias("was")), "document_id").where("tier <> was").select("document_id")
    dirty = regrade.dirty_keys(now, now.raw.where(f"not ({_EARLIER['raw_observation']})").select("proposition_id"), changed, (before, r.roots))
    return stored, *regrade.drain(stored, now, r.roots, dirty)


@query("=> select proposition_id, final as grade from final", "graded")
def drained_rollup(r: Register) -> DataFrame:
    """Regrading what a change made dirty, and what hangs on it, gives the grades from scratch."""
    return _drained(r)[1].select("proposition_id", F.col("final").alias("grade"))


@query(_BEFORE + "=> select class, count(*) as propositions, count(*) filter (where o.final is distinct from f.final) as moved, 0::bigint as lost, 0::bigint as added from final f left join old_final o using (proposition_id) group by 1", "graded")
def rebuild_difference(r: Register) -> DataFrame:
    """By class, the grades that the drain moved, and rows that its rollup lacks or has too many against a rebuild from all evidence; the oracle rebuilds both states."""
    stored, rollup, _ = _drained(r)
    scratch = regrade.grade_all(r.evidence, r.roots).select("proposition_id", "class", "final")
    rollup = rollup.select("proposition_id", "class", "final")
    was = stored.select("proposition_id", F.col("final").alias("was"))
    one = lambda df, **flags: df.select("class", *(flags.get(c, F.lit(0)).cast("long").alias(c) for c in ("propositions", "moved", "lost", "added")))
    each = one(rollup.join(was, "proposition_id", "left"), propositions=F.lit(1), moved=(~F.col("was").eqNullSafe(F.col("final"))))
    # rows of both, those of the rebuild counted up and those of the rollup down
    apart = scratch.withColumn("n", F.lit(1)).unionByName(rollup.withColumn("n", F.lit(-1))).groupBy("proposition_id", "class", "final").agg(F.sum("n").alias("n")).where("n <> 0")
    both = each.unionByName(one(apart, lost=F.greatest("n", F.lit(0)), added=F.greatest(-F.col("n"), F.lit(0))))
    return both.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("propositions", "moved", "lost", "added")))


_WEEKS = "days as (select timestamp '2024-01-01' + to_days(7 * i) as t from range(0, 5) d(i))"


@query(_WEEKS + f""", e as (select p.entity_id, p.proposition_id, g.grade, g.seq, g.occurred_at from proposition p join grade_event g using (proposition_id) where not blind),
h as (select entity_id, proposition_id, t, arg_max(grade, seq) as grade from e join days on occurred_at <= t group by 1, 2, 3)
=> select entity_id, strftime(t, '%Y-%m-%d') as day, count(*) as graded, count(*) filter (where grade in ('A', 'B')) as strong, coalesce(max({_RANK.format('grade')}), 0) as best from h group by 1, 2""")
def entity_as_of(r: Register) -> DataFrame:
    """An entity at several days: its claims graded by then and their best rank."""
    e = r.table("proposition").select("entity_id", "proposition_id").join(r.table("grade_event").where("not blind"), "proposition_id")
    weeks = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.timestamp_add("DAY", i * 7, F.lit("2024-01-01").cast("timestamp"))))
    h = e.withColumn("t", weeks).where("occurred_at <= t").groupBy("entity_id", "proposition_id", "t").agg(F.max_by("grade", F.struct("occurred_at", "seq")).alias("grade"))
    return h.groupBy("entity_id", F.date_format("t", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("graded"), F.count_if(F.col("grade").isin("A", "B")).alias("strong"), F.coalesce(F.max(exprs.grade_rank(F.col("grade"))), F.lit(0)).alias("best"))


@query("""a as (select observation_id, membership from obs where asserted_on < date '1996-01-01'), b as (select observation_id, case when asserted_on < date '1993-01-01' then 'INERT' else membership end as membership from obs where asserted_on < date '1997-01-01' and not superseded)
=> select observation_id, 'entered' as move from (select * from b except select * from a) x union all select observation_id, 'left' from (select * from a except select * from b) y""", "obs")
def evidence_moves(r: Register) -> DataFrame:
    """Rows that entered and rows that left the evidence between two states of it."""
    o = r.observations
    a = o.where("asserted_on < date '1996-01-01'").select("observation_id", "membership")
    b = o.where("asserted_on < date '1997-01-01' and not superseded").select("observation_id", F.when(F.col("asserted_on") < F.lit("1993-01-01").cast("date"), "INERT").otherwise(F.col("membership")).alias("membership"))
    return b.exceptAll(a).select("observation_id", F.lit("entered").alias("move")).unionByName(a.exceptAll(b).select("observation_id", F.lit("left").alias("move")))


@query(f"=> select entity_id, case when first_published is null then 'FIRST-PUBLISH' else 'REPUBLISH' end as event, count(*) as propositions from entity join proposition using (entity_id) left join publication using (entity_id) where {_SHOWN} group by 1, 2")
def publication_log_rows(r: Register) -> DataFrame:
    """What a publication appends to its log: first or again, with the claims it shows."""
    e = r.table("entity").where(_SHOWN).select("entity_id").join(r.table("proposition").select("entity_id", "proposition_id"), "entity_id").join(r.table("publication"), "entity_id", "left")
    return e.groupBy("entity_id", F.when(F.col("first_published").isNull(), "FIRST-PUBLISH").otherwise("REPUBLISH").alias("event")).agg(F.count("*").alias("propositions"))


@query("""gone as (select entity_id from entity where is_canary or entity_id % 31 = 4), p as (select proposition_id from proposition where entity_id in (select entity_id from gone))
=> select 'entity' as tab, count(*) as withdrawn from gone union all select 'proposition', count(*) from p union all select 'observation', count(*) from raw_observation where proposition_id in (select proposition_id from p)""")
def withdrawal_plan(r: Register) -> DataFrame:
    gone = r.table("entity").where("is_canary or entity_id % 31 = 4").select("entity_id")
    p = r.table("proposition").join(gone, "entity_id", "left_semi").select("proposition_id")
    o = r.table("raw_observation").join(p, "proposition_id", "left_semi")
    one = lambda df, tab: df.agg(F.count("*").alias("withdrawn")).select(F.lit(tab).alias("tab"), "withdrawn")
    return one(gone, "entity").unionByName(one(p, "proposition")).unionByName(one(o, "observation"))


@query("""v as (select c_custkey as entity_id, o_orderdate as day, case o_orderpriority when '1-URGENT' then 'depot' when '2-HIGH' then 'works' else 'archive' end as typology, o_orderkey from customer join orders on o_custkey = c_custkey),
w as (select *, lag(typology) over (partition by entity_id order by day, o_orderkey) as before from v) => select entity_id, o_orderkey, before, typology from w where before is distinct from typology""")
def typology_history(r: Register) -> DataFrame:
    """The rows at which the type of an entity changes, the first one included."""
    v = r.driver("orders").select(F.col("o_custkey").alias("entity_id"), "o_orderkey", F.col("o_orderdate").alias("day"), F.when(F.col("o_orderpriority") == "1-URGENT", "depot").when(F.col("o_orderpriority") == "2-HIGH", "works").otherwise("archive").alias("typology"))
    w = v.withColumn("before", F.lag("typology").over(Window.partitionBy("entity_id").orderBy("day", "o_orderkey")))
    return w.where(~F.col("before").eqNullSafe(F.col("typology"))).select("entity_id", "o_orderkey", "before", "typology")


@query("""shown as (select o.document_id, min(first_published) as shown_on from obs o join proposition p using (proposition_id) join publication using (entity_id) where document_id is not null group by 1)
=> select document_id, first_observed > shown_on and not (tier in ('T1', 'T2') and coalesce(document_date <= shown_on, false)) as quarantined from document join shown using (document_id) where first_observed is not null""", "obs")
def echo_quarantine(r: Register) -> DataFrame:
    """Documents first seen after what they support was published are echoes, unless they are first class and dated earlier."""
    shown = r.observations.where("document_id is not null").join(r.table("proposition").select("proposition_id", "entity_id"), "proposition_id").join(r.table("publication"), "entity_id").groupBy("document_id").agg(F.min("first_published").alias("shown_on"))
    d = r.table("document").where("first_observed is not null").join(shown, "document_id")
    early = F.col("tier").isin("T1", "T2") & F.coalesce(F.col("document_date") <= F.col("shown_on"), F.lit(False))
    return d.select("document_id", ((F.col("first_observed") > F.col("shown_on")) & ~early).alias("quarantined"))


@query("""h as (select document_id, observation_id, md5(receipt_state || '|' || scope) as sha, lag(md5(receipt_state || '|' || scope)) over (partition by document_id order by asserted_on, observation_id) as before from raw_observation where document_id is not null)
=> select document_id, count(*) as receipts, count(*) filter (where before <> sha) as drifts from h group by 1""")
def content_drift(r: Register) -> DataFrame:
    """How often the content behind a document changed between successive receipts."""
    o = r.table("raw_observation").where("document_id is not null").withColumn("sha", F.md5(F.concat_ws("|", "receipt_state", "scope")))
    h = o.withColumn("before", F.lag("sha").over(Window.partitionBy("document_id").orderBy("asserted_on", "observation_id")))
    return h.groupBy("document_id").agg(F.count("*").alias("receipts"), F.count_if(F.col("before") != F.col("sha")).alias("drifts"))


_RAW = "raw_now as (select * from raw_observation), prop_now as (select * from proposition), profile_now as (select * from profile),\n"


@query(_RAW + world("verified", {"raw_observation": "select * replace (case when receipt_state = 'UNRESOLVED' then 'VERIFIED' else receipt_state end as receipt_state) from raw_now"}, "select proposition_id, grade from graded")
    + "=> select proposition_id, g.grade, n_v0 as debt, v.grade as reachable from graded g join verified v using (proposition_id) where n_v0 > 0 and g.grade in ('D', 'E', 'F')", "graded")
def verification_debt(r: Register) -> DataFrame:
    """Unverified rows of weak claims and the band that a true grading gives if all leads turn out as they say."""
    both = cut(regrade.grade_worlds(r.evidence, r.roots, {"now": lambda e: e, "verified": regrade.leads_verified}, ("n_v0",)), "worlds")
    now = both.where("world = 'now' and n_v0 > 0").select("proposition_id", "grade", F.col("n_v0").alias("debt")).where(F.col("grade").isin("D", "E", "F"))
    then = both.where("world = 'verified'").select("proposition_id", F.col("grade").alias("reachable"))
    return now.join(then, "proposition_id").select("proposition_id", "grade", "debt", "reachable")


_IDENTITY = ["class", "function_set", "null_id"]


@query(_RAW + """merge as (select entity_id, case when entity_id % 20 between 1 and 4 then entity_id - entity_id % 20 + 1 end as root from entity),
named as (select p.proposition_id, coalesce(case when root is not null then min(p.proposition_id) over (partition by coalesce(root, -p.entity_id), root is null, class, function_set, null_id) end, p.proposition_id) as target, coalesce(root, p.entity_id) as whole from prop_now p join merge using (entity_id)),
""" + world("after", {
    "proposition": "select p.* replace (n.whole as entity_id, nullif(coalesce(u.target, p.parent_id), p.proposition_id) as parent_id) from prop_now p join named n on n.proposition_id = p.proposition_id and n.target = p.proposition_id left join named u on u.proposition_id = p.parent_id",
    "raw_observation": "select o.* replace (target as proposition_id) from raw_now o join named n on n.proposition_id = o.proposition_id", "profile": "select * from profile_now where proposition_id in (select target from named)"}, "select proposition_id, grade from graded")
    + f""", best as (select target, count(*) as pooled, max({_RANK.format('grade')}) as own from named join graded using (proposition_id) group by 1)
=> select target as proposition_id, pooled, coalesce(own, 0) as own_rank, a.grade as merged_grade, coalesce({_RANK.format('a.grade')}, 0) > coalesce(own, 0) as raised from best join after a on a.proposition_id = target where pooled > 1""", "graded")
def merge_guard(r: Register) -> DataFrame:
    """Claims that a merge of entities would pool: the best rank that they have of their own, the grade of the pooled evidence, and whether it is higher, which stops the merge."""
    near = r.table("entity").where("entity_id % 20 between 1 and 4").select((F.col("entity_id") - F.col("entity_id") % 20 + 1).alias("a"), F.col("entity_id").alias("b"))
    graded, named = regrade.grade_merged(r.evidence, r.roots, near, _IDENTITY)
    graded = cut(graded.select("world", "proposition_id", "grade"), "worlds")
    before = graded.where("world = 'now'").select("proposition_id", exprs.grade_rank(F.col("grade")).alias("rank"))
    own = named.join(before, "proposition_id").groupBy(F.col("target").alias("proposition_id")).agg(F.count("*").alias("pooled"), F.coalesce(F.max("rank"), F.lit(0)).alias("own_rank"))
    after = graded.where("world = 'merged'").select("proposition_id", F.col("grade").alias("merged_grade"))
    return own.join(after, "proposition_id").withColumn("raised", F.coalesce(exprs.grade_rank(F.col("merged_grade")), F.lit(0)) > F.col("own_rank"))


# ---- lineage


_LOOP = """reach2(x, y) as (select distinct citing, cited from citation union select r.x, c.cited from reach2 r join citation c on c.citing = r.y), looped as (select x as node from reach2 where x = y)"""


@query(_LOOP + """, base as (select distinct proposition_id, document_id from obs where membership = 'V' and document_id is not null),
term as (select document_id from document where document_id not in (select citing from citation)),
ends as (select b.proposition_id, r.y as node from base b join reach2 r on r.x = b.document_id where r.y in (select document_id from term) union select proposition_id, document_id from base where document_id in (select document_id from term)),
dated as (select proposition_id, node, document_date from ends join document on document_id = node), first_end as (select proposition_id, arg_min(node, (document_date, node)) as node from dated where document_date is not null group by 1),
own as (select b.proposition_id, arg_min(b.document_id, (coalesce(document_date, date '9999-12-31'), b.document_id)) as node, count(*) filter (where b.document_id in (select node from looped)) as cycles from base b join document using (document_id) group by 1)
=> select own.proposition_id, coalesce(f.node, own.node) as origin, case when f.node is null then 'earliest row' else 'terminus' end as method, cycles from own left join first_end f using (proposition_id)""", "obs")
def earliest_origins(r: Register) -> DataFrame:
    """The earliest dated document without citations that a claim goes back to, else its earliest own document; and how many of its documents stand in a circle."""
    docs, edges = r.table("document").select("document_id", "document_date"), r.table("citation")
    base = cut(r.observations.where("membership = 'V' and document_id is not null").select("proposition_id", "document_id").distinct(), "base")
    first, _ = graph.origins(edges, docs.select("document_id", F.col("document_date").alias("dated"), F.lit("document").alias("basis")))
    first = first.withColumnRenamed("first", "e")
    looped = graph.on_cycle(edges).select(F.col("node").alias("document_id"), F.lit(1).alias("loop"))
    rows = base.join(docs, "document_id").join(first, "document_id", "left").join(looped, "document_id", "left")
    far = F.coalesce("document_date", F.lit("9999-12-31").cast("date"))
    own = rows.groupBy("proposition_id").agg(F.min("e").alias("e"), F.min_by("document_id", F.struct(far, "document_id")).alias("node"), F.count("loop").alias("cycles"))
    return own.select("proposition_id", F.coalesce("e.node", "node").alias("origin"), F.when(F.col("e").isNull(), "earliest row").otherwise("terminus").alias("method"), "cycles")


@query("""base as (select distinct proposition_id, document_id from obs where membership = 'V' and document_id is not null), touch as (select b.proposition_id, count(*) as edges, count(*) filter (where kind = 'mirror') as mirrors from base b join citation c on c.citing = b.document_id group by 1),
comp as (select b.proposition_id, count(distinct coalesce(root, document_id)) as components from base b left join roots on node = document_id group by 1), att as (select proposition_id, count(*) filter (where held) as held from attested where membership = 'V' group by 1)
=> select proposition_id, count(*) as nodes, coalesce(any_value(edges), 0) as edges, coalesce(any_value(mirrors), 0) as mirrors, any_value(components) as components, coalesce(any_value(held), 0) as attestations from base left join touch using (proposition_id) left join comp using (proposition_id) left join att using (proposition_id) group by 1""", "counts")
def lineage_payload(r: Register) -> DataFrame:
    """What the lineage view of a claim shows: nodes, edges, mirrors, components and attestations, five aggregates joined by key."""
    base = cut(r.observations.where("membership = 'V' and document_id is not null").select("proposition_id", "document_id").distinct(), "base")
    nodes = base.groupBy("proposition_id").agg(F.count("*").alias("nodes"))
    touch = base.join(r.table("citation").withColumnRenamed("citing", "document_id"), "document_id").groupBy("proposition_id").agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "mirror").alias("mirrors"))
    comp = base.join(r.roots.withColumnRenamed("node", "document_id"), "document_id", "left").groupBy("proposition_id").agg(F.count_distinct(F.coalesce("root", "document_id")).alias("components"))
    att = evidence.attestations(r.observations, r.table("witness")).where("membership = 'V'").groupBy("proposition_id").agg(F.count_if("held").alias("attestations"))
    out = nodes.join(touch, "proposition_id", "left").join(comp, "proposition_id").join(att, "proposition_id", "left")
    return out.fillna(0, ["edges", "mirrors", "attestations"])


@query("=> select model_family, count(*) as judged, count(*) filter (where disagreed) as disagreed, count(*) filter (where defaulted) as defaulted, count(*) filter (where disagreed) * 10000 // count(*) as disagreement_bp from obs where model_family is not null group by 1", "obs")
def family_disagreement(r: Register) -> DataFrame:
    o = r.observations.where("model_family is not null").groupBy("model_family").agg(F.count("*").alias("judged"), F.count_if("disagreed").alias("disagreed"), F.count_if("defaulted").alias("defaulted"))
    return o.withColumn("disagreement_bp", F.expr("disagreed * 10000 div judged"))


@query(_LOOP + """=> select c.citing, c.cited, coalesce(a.document_date < b.document_date, false) as cites_the_future, exists (select 1 from reach2 r where r.x = c.cited and r.y = c.citing) as comes_back from citation c join document a on a.document_id = c.citing join document b on b.document_id = c.cited where a.document_date < b.document_date or exists (select 1 from reach2 r where r.x = c.cited and r.y = c.citing)""")
def counterfactual_checks(r: Register) -> DataFrame:
    """Edges that cannot be as they are: older documents citing younger ones, and edges whose target leads back to their source."""
    d = r.table("document").select("document_id", "document_date")
    e = r.table("citation").select("citing", "cited")
    e = e.join(d.select(F.col("document_id").alias("citing"), F.col("document_date").alias("a")), "citing").join(d.select(F.col("document_id").alias("cited"), F.col("document_date").alias("b")), "cited")
    back = graph.strong_parts(r.table("citation"))
    both = e.join(back.select(F.col("node").alias("citing"), F.col("part").alias("pa")), "citing", "left").join(back.select(F.col("node").alias("cited"), F.col("part").alias("pb")), "cited", "left")
    out = both.select("citing", "cited", F.coalesce(F.col("a") < F.col("b"), F.lit(False)).alias("cites_the_future"), F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)).alias("comes_back"))
    return out.where("cites_the_future or comes_back")


@query("""walk(seed, node, depth) as (select distinct citing, citing, 0 from citation where citing % 10 = 1 union select w.seed, c.cited, w.depth + 1 from walk w join citation c on w.node = c.citing where w.depth < 24),
far as (select seed, node, min(depth) as depth from walk group by 1, 2) => select seed, node, depth + 1 as steps from far where depth > 0""")
def origin_path_lengths(r: Register) -> DataFrame:
    """Shortest ways from every tenth citing document to all it reaches, as lengths of the walked paths."""
    edges = r.table("citation")
    trace = graph.trace_origin(edges, edges.where("citing % 10 = 1").select(F.col("citing").alias("seed")))
    paths = graph.origin_paths(trace, trace.where("depth > 0").select("seed", "node"))
    return paths.select("seed", "node", F.size("path").alias("steps"))
