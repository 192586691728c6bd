"""Queries on evidence, lineage and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evidence, graph, score
from ..operators.shared import cut
from .register import Register
from .registry import query


@query("=> select grade, count(*) as n, count(*) * 10000 // sum(count(*)) over ()::bigint as share_bp from graded group by 1", "graded")
def band_occupancy(r: Register) -> DataFrame:
    bands = r.graded.groupBy("grade").agg(F.count("*").alias("n"))  # eight rows, so a window over all is small
    return bands.withColumn("total", F.sum("n").over(Window.partitionBy())).select("grade", "n", F.expr("n * 10000 div total").alias("share_bp"))


@query("=> select class, grade, count(*) as n, count(*) * 10000 // sum(count(*)) over (partition by class)::bigint as share_bp from graded group by 1, 2", "graded")
def band_occupancy_by_class(r: Register) -> DataFrame:
    bands = r.graded.groupBy("class", "grade").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("class")))
    return bands.select("class", "grade", "n", F.expr("n * 10000 div total").alias("share_bp"))


@query("=> select class, grade, count(*) as n from graded group by cube (class, grade)", "graded")
def band_cube(r: Register) -> DataFrame:
    return r.graded.cube("class", "grade").agg(F.count("*").alias("n"))


@query("=> select observation_id, membership, exclusion_reason, magnitude, signed_weight, null_excluding, prov_tier from obs", "obs")
def observations_built(r: Register) -> DataFrame:
    return r.observations.select("observation_id", "membership", "exclusion_reason", "magnitude", "signed_weight", "null_excluding", "prov_tier")


@query("=> select membership, coalesce(exclusion_reason, '') as reason, count(*) as n from obs group by 1, 2", "obs")
def membership_reasons(r: Register) -> DataFrame:
    return r.observations.groupBy("membership", F.coalesce("exclusion_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


_COUNTS = "proposition_id, n_v, n_u, n_v0, n_inert, n_v_claim, v_d4_claim, v_d2_claim, v_d1_claim, v_d1, v_d0, v_d2, has_t1t2, mirror_d3, dated_before_cut, excl_d3, excl_d2, excl_any, null_documented"


@query(f"=> select {_COUNTS} from counts", "counts")
def evidence_counts(r: Register) -> DataFrame:
    return evidence.counts(r.observations).select(*_COUNTS.split(", "))


@query("=> select proposition_id, place_weight, claim_weight, place_weight + claim_weight as weight from counts", "counts")
def two_bars(r: Register) -> DataFrame:
    return evidence.counts(r.observations).select("proposition_id", "place_weight", "claim_weight", (F.col("place_weight") + F.col("claim_weight")).alias("weight"))


@query("""strongest as (select *, row_number() over (partition by proposition_id, sign, coalesce(fact_key, observation_id) order by magnitude desc, asserted_on, observation_id) as k from obs where membership in ('V', 'U'))
=> select proposition_id, observation_id, sign, magnitude from strongest where k = 1""", "obs")
def merged_evidence(r: Register) -> DataFrame:
    w = Window.partitionBy("proposition_id", "sign", F.coalesce("fact_key", "observation_id")).orderBy(F.desc("magnitude"), "asserted_on", "observation_id")
    return r.observations.where(F.col("membership").isin("V", "U")).withColumn("k", F.row_number().over(w)).where("k = 1").select("proposition_id", "observation_id", "sign", "magnitude")


@query("=> select proposition_id, membership, locus, observation_id, row_number() over (partition by proposition_id, membership, locus order by magnitude desc, observation_id) as tick from obs", "obs")
def evidence_ticks(r: Register) -> DataFrame:
    w = Window.partitionBy("proposition_id", "membership", "locus").orderBy(F.desc("magnitude"), "observation_id")
    return r.observations.select("proposition_id", "membership", "locus", "observation_id", F.row_number().over(w).alias("tick"))


@query("=> select node, root from roots", "roots")
def citation_components(r: Register) -> DataFrame:
    return r.roots


@query("=> select root, count(*) as nodes from roots group by 1", "roots")
def component_sizes(r: Register) -> DataFrame:
    return r.roots.groupBy("root").agg(F.count("*").alias("nodes"))


@query("=> select proposition_id, lineage_key, n_rows, has_claim, has_place_excluding, documents from lin2", "lineages")
def independent_lineages(r: Register) -> DataFrame:
    return evidence.lineage_rows(r.observations, r.roots, 2)


@query("=> select proposition_id, l_d0, l_d2, l_d3, l_d3_claim, l_d2_place_excluding from lcounts", "lineages")
def lineage_counts(r: Register) -> DataFrame:
    return evidence.lineage_counts(r.observations, r.roots)


@query("""docs as (select proposition_id, count(distinct document_id) as documents from obs where membership = 'V' group by 1)
=> select proposition_id, documents, coalesce(l_d0, 0) as lineages, documents - coalesce(l_d0, 0) as collapsed from docs left join lcounts using (proposition_id)""", "lineages")
def collapse_delta(r: Register) -> DataFrame:
    docs = r.observations.where("membership = 'V'").groupBy("proposition_id").agg(F.count_distinct("document_id").alias("documents"))
    lineages = F.coalesce("l_d0", F.lit(0))
    return docs.join(evidence.lineage_counts(r.observations, r.roots), "proposition_id", "left").select("proposition_id", "documents", lineages.alias("lineages"), (F.col("documents") - lineages).alias("collapsed"))


#: DuckDB: node-wise shallowest depths of all citing documents, by recursion over (seed, node, depth).
_TRACE = """walk(seed, node, depth) as (select distinct citing, citing, 0 from citation union select w.seed, c.cited, w.depth + 1 from walk w join citation c on w.node = c.citing where w.depth < 24),
trace as (select seed, node, min(depth) as depth from walk group by 1, 2)"""


def _trace(r: Register) -> DataFrame:
    edges = r.table("citation")
    return graph.trace_origin(edges, edges.select(F.col("citing").alias("seed")))


@query(_TRACE + """, hops as (select t.seed, t.node, t.depth, min(c.kind) as via from trace t left join trace p on p.seed = t.seed and p.depth = t.depth - 1 left join citation c on c.citing = p.node and c.cited = t.node group by 1, 2, 3)
=> select seed, node, depth, via from hops""")
def origin_trace(r: Register) -> DataFrame:
    return _trace(r).select("seed", "node", "depth", "via")


@query(_TRACE + """, out_ as (select distinct citing from citation)
=> select t.seed, t.node, t.depth, t.node not in (select citing from out_) as is_terminus, exists (select 1 from citation c join trace b on b.seed = t.seed and b.node = c.cited where c.citing = t.node) as closes_cycle from trace t""")
def origin_trace_flags(r: Register) -> DataFrame:
    return graph.with_flags(_trace(r), r.table("citation")).drop("via")


@query(_TRACE + "=> select distinct t.seed as node from trace t join citation c on c.citing = t.node and c.cited = t.seed")
def cycle_members(r: Register) -> DataFrame:
    return graph.on_cycle(r.table("citation"))


@query(_TRACE + """=> select t.seed as document_id, count(*) as reached_t5, min(t.depth) as nearest from trace t join document s on s.document_id = t.seed and s.tier in ('T1', 'T2', 'T3')
join document d on d.document_id = t.node and d.tier = 'T5' where t.depth > 0 group by 1""")
def citogenesis(r: Register) -> DataFrame:
    """First-class documents that lead back to fifth-class ones: how many, and how near the nearest is."""
    docs, edges = r.table("document").select("document_id", "tier"), r.table("citation")
    low = docs.where("tier = 'T5'").select(F.col("document_id").alias("node"))
    parts, ways = graph.condensed(edges)
    reached = graph.targets_ahead(ways, parts.join(low, "node", "left_semi").select("part", F.col("node").alias("target"))).groupBy("part").agg(F.count("*").alias("reached_t5"))
    seeds = docs.where(F.col("tier").isin("T1", "T2", "T3")).select(F.col("document_id").alias("node"))
    near = graph.steps_to(edges, low).select("node", F.col("steps").alias("nearest"))
    return seeds.join(parts, "node").join(reached, "part").join(near, "node").select(F.col("node").alias("document_id"), "reached_t5", "nearest")


@query("=> select citing, cited, kind from citation join document a on a.document_id = citing and a.tier in ('T1', 'T2', 'T3') join document b on b.document_id = cited and b.tier = 'T5'")
def direct_laundering(r: Register) -> DataFrame:
    docs = r.table("document").select("document_id", "tier")
    return r.table("citation").join(docs.where(F.col("tier").isin("T1", "T2", "T3")).withColumnRenamed("document_id", "citing"), "citing", "left_semi").join(docs.where("tier = 'T5'").withColumnRenamed("document_id", "cited"), "cited", "left_semi").select("citing", "cited", "kind")


@query("""reach2(x, y) as (select distinct citing, citing from citation union select r.x, c.cited from reach2 r join citation c on c.citing = r.y),
dated as (select document_id, coalesce(document_date, first_observed) as dated, case when document_date is not null then 'document' when first_observed is not null then 'first observed' end as basis from document),
ends as (select x as document_id, y as node from reach2 where y not in (select citing from citation)), seeds as (select distinct proposition_id, document_id from obs where membership = 'V' and document_id is not null and document_id in (select document_id from document)),
found as (select s.proposition_id, coalesce(e.node, s.document_id) as origin from seeds s left join ends e using (document_id)),
firsts as (select proposition_id, arg_min((dated, origin, basis), (dated, origin)) filter (where dated is not null) as f from found join dated on origin = dated.document_id group by 1)
=> select proposition_id, origins, f[2] as first_origin, f[1]::varchar as first_date, f[3] as basis from (select proposition_id, count(distinct origin) as origins from found group by 1) n left join firsts using (proposition_id)""", "obs")
def claim_origin(r: Register) -> DataFrame:
    """How many documents without citations a claim goes back to at any distance, or its own where they lead to none, and the earliest with its date and what dates it."""
    d = r.table("document")
    basis = F.when(F.col("document_date").isNotNull(), "document").when(F.col("first_observed").isNotNull(), "first observed")
    docs = cut(d.select("document_id", F.coalesce("document_date", "first_observed").alias("dated"), basis.alias("basis")), "dated")
    first, every = graph.origins(r.table("citation"), docs)
    seeds = cut(r.observations.where("membership = 'V' and document_id is not null").select("proposition_id", "document_id").distinct().join(docs, "document_id"), "seeds")
    counted = seeds.select("proposition_id", "document_id").join(every, "document_id", "left").groupBy("proposition_id").agg(F.count_distinct(F.coalesce("node", "document_id")).alias("origins"))
    # a seed without any end is its own origin; one whose ends are all undated has none with a date
    known = every.select("document_id").distinct().withColumn("ends", F.lit(True))
    own = F.when(F.col("ends").isNull() & F.col("dated").isNotNull(), F.struct("dated", F.col("document_id").alias("node"), "basis"))
    best = seeds.join(known, "document_id", "left").join(first, "document_id", "left").groupBy("proposition_id").agg(F.min(F.coalesce("first", own)).alias("f"))
    return counted.join(best, "proposition_id").select("proposition_id", "origins", F.col("f.node").alias("first_origin"), F.col("f.dated").cast("string").alias("first_date"), F.col("f.basis").alias("basis"))


@query("""closure(node) as (select distinct document_id from obs join proposition using (proposition_id) join entity using (entity_id) where publication_state = 'PUBLISHED' and not is_canary and document_id is not null union select cited from closure join citation on citing = node)
=> select node as document_id from closure""", "obs")
def published_closure(r: Register) -> DataFrame:
    shown = r.table("entity").where("publication_state = 'PUBLISHED' and not is_canary").select("entity_id")
    props = r.table("proposition").join(shown, "entity_id", "left_semi").select("proposition_id")
    # one seed for all: reachability needs each node once
    start = r.observations.where("document_id is not null").join(props, "proposition_id", "left_semi").select(F.col("document_id").alias("cited")).distinct()
    edges = r.table("citation").select("citing", "cited").unionByName(start.select(F.lit(-1).cast("long").alias("citing"), "cited")).withColumn("kind", F.lit("x"))
    trace = graph.trace_origin(edges, r.spark.range(1).select(F.lit(-1).cast("long").alias("seed")), 10_000)
    return trace.where("node >= 0").select(F.col("node").alias("document_id"))


@query("=> select proposition_id, search_n, search_k, search_index, silence from searched", "counts")
def search_completeness(r: Register) -> DataFrame:
    return evidence.search(r.table("profile")).select("proposition_id", "search_n", "search_k", "search_index", "silence")


@query("=> select proposition_id, null_state, refutation, u_lineages, unrebutted_d3 from wide", "wide")
def null_and_refutation(r: Register) -> DataFrame:
    return score.evaluate(r.wide).select("proposition_id", "null_state", "refutation", "u_lineages", "unrebutted_d3")


_CONDITIONS = "A1, A1alt, A2, A3, A4, A5, A6, B1, B2, B3, B4, C1a, C1b, C1c, C2, C3, D1, D2, E1, E2"


@query(f"=> select proposition_id, awarded, {_CONDITIONS} from graded", "graded")
def band_conditions(r: Register) -> DataFrame:
    return r.graded.select("proposition_id", "awarded", *_CONDITIONS.split(", "))


@query("=> select proposition_id, grade, awarded, cap_text, ceiling, ceiling_reason, at_ceiling, marginal, limiting from graded", "graded")
def grades(r: Register) -> DataFrame:
    return r.graded.select("proposition_id", "grade", "awarded", "cap_text", "ceiling", "ceiling_reason", "at_ceiling", "marginal", "limiting")


@query("=> select cap, count(*) as n from (select unnest(string_split(cap_text, ',')) as cap from graded where cap_text <> '') t group by 1", "graded")
def cap_counts(r: Register) -> DataFrame:
    return r.graded.select(F.explode("caps").alias("cap")).groupBy("cap").agg(F.count("*").alias("n"))


@query("=> select candidate_set_id, members, documented, program, members <= 3 * documented as undiluted from sets", "graded")
def candidate_dilution(r: Register) -> DataFrame:
    return score.candidate_sets(None, r.first_grades, r.table("candidate_set")).select("candidate_set_id", "members", "documented", "program", "undiluted")


@query("=> select proposition_id, grade, final, final <> grade as clamped from final", "graded")
def clamped_grades(r: Register) -> DataFrame:
    return r.final.select("proposition_id", "grade", "final", "clamped")


@query("""better as (select proposition_id, least(4, coalesce(l_d2, 0) + n_v0) as reachable_lineages, n_v0, limiting, case grade when 'A' then 0 when 'B' then 1 when 'C' then 2 when 'D' then 3 when 'E' then 4 else 5 end as distance from graded where n_v0 > 0)
=> select proposition_id, reachable_lineages, n_v0 * (6 - distance) as priority, row_number() over (order by n_v0 * (6 - distance) desc, proposition_id) as place from better qualify place <= 200""", "graded")
def verification_priority(r: Register) -> DataFrame:
    """The 200 propositions whose unverified rows matter most; the limit is the report."""
    distance = F.when(F.col("grade") == "A", 0).when(F.col("grade") == "B", 1).when(F.col("grade") == "C", 2).when(F.col("grade") == "D", 3).when(F.col("grade") == "E", 4).otherwise(5)
    g = r.graded.where("n_v0 > 0").select("proposition_id", F.least(F.lit(4), F.col("l_d2") + F.col("n_v0")).alias("reachable_lineages"), (F.col("n_v0") * (6 - distance)).alias("priority"))
    top = g.orderBy(F.desc("priority"), "proposition_id").limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "proposition_id")))
