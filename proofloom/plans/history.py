"""Queries on grade events, agents and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import state
from .register import Register
from .registry import query

_RANK = "case {} when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 end"
_HISTORY = f"""h0 as (select *, lag(grade) over (partition by proposition_id order by seq) as grade_from, cause in ('SCORER-CHANGE', 'TABLE-VERSION-CHANGE', 'RESCORE-NOISE') as drift from grade_event where not blind),
h as (select *, case when grade_from is null then 'first' when grade_from = grade then 'same' when {_RANK.format('grade_from')} is null or {_RANK.format('grade')} is null then 'kind' when {_RANK.format('grade')} > {_RANK.format('grade_from')} then 'up' else 'down' end as direction from h0)"""


@query("=> select proposition_id, arg_max(seq, seq) as seq, arg_max(grade, seq) as grade, arg_max(cause, seq) as cause from grade_event where not blind group by 1")
def latest_grades(r: Register) -> DataFrame:
    return state.latest(r.table("grade_event")).select("proposition_id", "seq", "grade", "cause")


@query("""days as (select proposition_id, timestamp '2024-01-01' + to_days(7 * i) as t from (select distinct proposition_id from grade_event) p, range(0, 5) d(i))
=> select d.proposition_id, strftime(t, '%Y-%m-%d') as day, coalesce(arg_max(grade, seq), 'X') as grade from days d left join (select * from grade_event where not blind) e on e.proposition_id = d.proposition_id and e.occurred_at <= t group by 1, 2""")
def grades_as_of(r: Register) -> DataFrame:
    events = r.table("grade_event")
    weeks = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.timestamp_add("DAY", i * 7, F.lit("2024-01-01").cast("timestamp"))))
    times = events.select("proposition_id").distinct().withColumn("t", weeks)
    return state.as_of(events, times).select("proposition_id", F.date_format("t", "yyyy-MM-dd").alias("day"), "grade")


@query(_HISTORY + "=> select seq, proposition_id, grade_from, grade, direction, drift from h")
def grade_history(r: Register) -> DataFrame:
    return state.history(r.table("grade_event")).select("seq", "proposition_id", "grade_from", "grade", "direction", "drift")


@query(_HISTORY + "=> select grade_from, grade, count(*) as n from h where grade_from is not null and not drift group by 1, 2")
def movement_matrix(r: Register) -> DataFrame:
    return state.history(r.table("grade_event"), with_drift=False).where("grade_from is not null").groupBy("grade_from", "grade").agg(F.count("*").alias("n"))


@query(_HISTORY + """=> select seq, direction, direction = 'up' and cause not in ('SCORER-CHANGE', 'TABLE-VERSION-CHANGE', 'RESCORE-NOISE', 'NEW-DISCLOSURE', 'MERGE', 'SPLIT')
and max(case when cause = 'NEW-DISCLOSURE' then 1 else 0 end) over (partition by proposition_id order by seq rows unbounded preceding) = 0 as held from h""")
def ratchet(r: Register) -> DataFrame:
    return state.ratchet_holds(r.table("grade_event")).select("seq", "direction", "held")


@query("=> select proposition_id, md5(count(*) || ':' || sum(('0x' || substr(md5(s), 1, 8))::bigint)::bigint) as state_hash from (select proposition_id, observation_id || '|' || membership || '|' || magnitude || '|' || sign as s from obs) t group by 1", "obs")
def evidence_state_hash(r: Register) -> DataFrame:
    return state.state_hash(r.observations)


@query("""changed as (select document_id from document where tier = 'T5'), touched as (select distinct coalesce(root, document_id) as root from changed left join roots on node = document_id),
members as (select node as document_id from roots where root in (select root from touched) union select document_id from changed)
=> select proposition_id, case when class = 'EXIST' then 10 else 100 end as priority from proposition where proposition_id in (select proposition_id from obs where document_id in (select document_id from members))""", "roots")
def regrade_change_set(r: Register) -> DataFrame:
    return state.change_set(r.observations, r.table("document").where("tier = 'T5'").select("document_id"), r.roots, r.table("proposition"))


@query("=> select agent, count(*) as runs, sum(emitted)::bigint as emitted, sum(resolved)::bigint as resolved, case when sum(emitted) > 0 then ((sum(emitted) - sum(resolved)) * 10000)::bigint // sum(emitted)::bigint end as unresolved_bp from agent_run group by 1")
def unresolved_rate(r: Register) -> DataFrame:
    runs = r.table("agent_run").groupBy("agent").agg(F.count("*").alias("runs"), F.sum("emitted").alias("emitted"), F.sum("resolved").alias("resolved"))
    return runs.withColumn("unresolved_bp", F.when(F.col("emitted") > 0, F.expr("((emitted - resolved) * 10000) div emitted")))


@query("=> select strftime(date_trunc('month', started_at), '%Y-%m-%d') as month, agent, count(*) filter (where canary) as canaries, count(*) as runs from agent_run group by 1, 2")
def canaries_by_month(r: Register) -> DataFrame:
    return r.table("agent_run").groupBy(F.date_format(F.date_trunc("month", "started_at"), "yyyy-MM-dd").alias("month"), "agent").agg(F.count_if("canary").alias("canaries"), F.count("*").alias("runs"))


@query("=> select strftime(date_trunc('day', started_at), '%Y-%m-%d') as day, count(*) as runs, count(*) filter (where canary) as canaries, sum(emitted - resolved)::bigint as unresolved from agent_run group by 1")
def daily_windows(r: Register) -> DataFrame:
    w = r.table("agent_run").groupBy(F.window("started_at", "1 day")).agg(F.count("*").alias("runs"), F.count_if("canary").alias("canaries"), F.sum(F.col("emitted") - F.col("resolved")).alias("unresolved"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "runs", "canaries", "unresolved")


@query("""gaps as (select *, case when started_at - lag(started_at) over (partition by agent order by started_at, run_id) < interval 30 minutes then 0 else 1 end as opens from agent_run), numbered as (select *, sum(opens) over (partition by agent order by started_at, run_id rows unbounded preceding) as session from gaps)
=> select agent, strftime(min(started_at), '%Y-%m-%d %H:%M:%S') as started, count(*) as runs, sum(emitted)::bigint as emitted from numbered group by agent, session""")
def agent_sessions(r: Register) -> DataFrame:
    s = r.table("agent_run").groupBy("agent", F.session_window("started_at", "30 minutes")).agg(F.count("*").alias("runs"), F.sum("emitted").alias("emitted"))
    return s.select("agent", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "runs", "emitted")


@query("=> select agent, arg_max(run_id, run_id) as last_run, arg_max(emitted, run_id) as last_emitted from agent_run group by 1")
def latest_run_per_agent(r: Register) -> DataFrame:
    return r.table("agent_run").groupBy("agent").agg(F.max("run_id").alias("last_run"), F.max_by("emitted", "run_id").alias("last_emitted"))


@query("""old as (select * from obs where asserted_on < date '1997-01-01'), o as (select proposition_id, count(*) filter (where membership = 'V') as v from old group by 1), n as (select proposition_id, count(*) filter (where membership = 'V') as v from obs group by 1)
=> select coalesce(o.proposition_id, n.proposition_id) as proposition_id, coalesce(o.v, 0) as v_before, coalesce(n.v, 0) as v_after from o full join n using (proposition_id) where coalesce(o.v, 0) <> coalesce(n.v, 0)""", "obs")
def evidence_entered(r: Register) -> DataFrame:
    n_v = F.count_if(F.col("membership") == "V")
    old = r.observations.where("asserted_on < date '1997-01-01'").groupBy("proposition_id").agg(n_v.alias("a"))
    new = r.observations.groupBy("proposition_id").agg(n_v.alias("b"))
    both = old.join(new, "proposition_id", "full_outer").select("proposition_id", F.coalesce("a", F.lit(0)).alias("v_before"), F.coalesce("b", F.lit(0)).alias("v_after"))
    return both.where("v_before <> v_after")


@query("=> select proposition_id, seq, grade from (select *, row_number() over (partition by proposition_id order by seq desc) as k from grade_event where not blind) t where k <= 3")
def last_three_events(r: Register) -> DataFrame:
    w = Window.partitionBy("proposition_id").orderBy(F.desc("seq"))
    return r.table("grade_event").where("not blind").withColumn("k", F.row_number().over(w)).where("k <= 3").select("proposition_id", "seq", "grade")
