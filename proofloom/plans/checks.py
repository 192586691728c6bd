"""Validation: rules as violation reports, audits between snapshots, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import derived, exprs
from ..operators import evidence, geo, rules
from .register import Register
from .registry import query

_ARGS = """args as (select proposition_id, class, case class when 'EXTENT' then json_object('metres', proposition_id * 10) when 'FUNCTION' then json_object('function', function_set) when 'STATUS' then json_object('status', function_set, 'year', proposition_id % 60 + 1940)
when 'LOCATE' then json_object('precision', function_set) else '{}' end as args from proposition)"""


def _union(rows: str, tab: str, key: str, bad: dict[str, str]) -> str:
    return " union all ".join(f"select '{tab}' as tab, '{rule}' as rule, {key}::varchar as key from {rows} where {cond}" for rule, cond in bad.items())


_OBSERVATION = {
    "verified without custody": "receipt_state = 'VERIFIED' and custody = 'unknown'", "verified mirror without document": "receipt_state = 'VERIFIED' and mirror_only and document_id is null", "matrix without ordinals": "source = 'MATRIX' and alternative is null",
    "matrix above its ceiling": "source = 'MATRIX' and magnitude > 3", "instance not bound": "scope = 'INSTANCE' and not bound", "negative search must undercut": "negative_search and sign <> 'UNDERCUTS'", "seen in person without lawful access": "direct and not lawful",
    "superseded but counted": "superseded and membership <> 'INERT'", "pending tier above two": "prov_tier = 'PENDING' and magnitude > 2",
}


@query("=> " + _union("obs", "observation", "observation_id", _OBSERVATION), "obs")
def observation_rules(r: Register) -> DataFrame:
    return rules.violations(r.observations, "observation", F.col("observation_id"), {k: F.expr(v) for k, v in _OBSERVATION.items()})


_ASSERTION = {"point without radius": "loc_precision in ('approximate_1km', 'approximate_10km') and radius_m is null", "a name with coordinates": "loc_precision = 'place_name_only' and lon_c is not null", "preferred but superseded": "preferred and superseded"}


@query("=> " + _union("assertion", "assertion", "entity_id || '/' || assertion_id", _ASSERTION) + " union all select 'assertion', 'several preferred', entity_id::varchar from assertion where preferred group by entity_id having count(*) > 1")
def geometry_rules(r: Register) -> DataFrame:
    a = r.table("assertion")
    return rules.violations(a, "assertion", F.concat_ws("/", "entity_id", "assertion_id"), {k: F.expr(v) for k, v in _ASSERTION.items()}).unionByName(rules.repeated(a.where("preferred"), "assertion", "several preferred", ["entity_id"]))


#: Keys that the arguments of a class must have.
_REQUIRED = {"EXTENT": ["metres", "as_of"], "FUNCTION": ["function"], "STATUS": ["status", "year"], "LOCATE": ["precision", "datum"], "HARDEN": ["depth"]}


@query(_ARGS + ", need as (select * from (values " + ", ".join(f"('{c}', {ks})" for c, ks in _REQUIRED.items()) + ") t(class, keys)) => select proposition_id, array_to_string(list_sort(list_filter(keys, lambda k: not list_contains(json_keys(args), k))), ',') as missing from args join need using (class) where len(list_filter(keys, lambda k: not list_contains(json_keys(args), k))) > 0")
def predicate_rules(r: Register) -> DataFrame:
    """Arguments that lack a key their class requires."""
    p = r.table("proposition").withColumn("args", derived.predicate_args(F.col("class"), F.col("proposition_id"), F.col("function_set")))
    need = F.lit(None).cast("array<string>")
    for c, keys in _REQUIRED.items():
        need = F.when(F.col("class") == c, F.array(*(F.lit(k) for k in keys))).otherwise(need)
    missing = F.array_sort(F.array_except(need, F.json_object_keys("args")))
    return p.withColumn("m", missing).where(F.size("m") > 0).select("proposition_id", F.array_join("m", ",").alias("missing"))


@query("=> select 'proposition' as tab, 'several existence claims' as rule, entity_id::varchar as key from proposition where class = 'EXIST' group by entity_id having count(*) > 1 union all select 'proposition', 'same claim twice', entity_id || '/' || class || '/' || function_set || '/' || coalesce(reference_class, '-') from proposition group by entity_id, class, function_set, reference_class having count(*) > 1")
def proposition_rules(r: Register) -> DataFrame:
    p = r.table("proposition")
    return rules.repeated(p.where("class = 'EXIST'"), "proposition", "several existence claims", ["entity_id"]).unionByName(rules.repeated(p, "proposition", "same claim twice", ["entity_id", "class", "function_set", "reference_class"]))


_DOCUMENT = {"first class but self-attesting": "tier = 'T1' and self_attesting", "unattributed era with an early date": "era = 'POST-2022-UNATTRIBUTED' and document_date <= date '2000-01-01'", "writable channel in the first class": "tier = 'T1' and channel = 'ADVERSARY-WRITABLE'", "undated and never observed": "document_date is null and first_observed is null"}
_PROFILE = {"outcome without search": "outcome is not null and not searched", "searched though not applicable": "searched and not applicable"}


@query("=> " + _union("document", "document", "document_id", _DOCUMENT) + " union all " + _union("profile", "profile", "proposition_id || '/' || profile_id", _PROFILE))
def document_rules(r: Register) -> DataFrame:
    d = rules.violations(r.table("document"), "document", F.col("document_id"), {k: F.expr(v) for k, v in _DOCUMENT.items()})
    return d.unionByName(rules.violations(r.table("profile"), "profile", F.concat_ws("/", "proposition_id", "profile_id"), {k: F.expr(v) for k, v in _PROFILE.items()}))


@query("=> select proposition_id, search_index from rollup_before join searched using (proposition_id) where grade = 'X' and search_index >= 500", "counts")
def search_floor_rules(r: Register) -> DataFrame:
    """Stored X grades although half of the expected records were searched."""
    return r.table("rollup_before").where("grade = 'X'").join(evidence.search(r.table("profile")), "proposition_id").where("search_index >= 500").select("proposition_id", "search_index")


@query("=> select seq, case when seq % 50 = 7 then 'lost' else 'changed' end as finding from grade_event where seq % 50 = 7 or (seq % 40 = 3 and grade <> 'A')")
def append_only_audit(r: Register) -> DataFrame:
    """A later copy of the event log, in which some rows are gone and some changed, held against the log."""
    old = r.table("grade_event")
    new = old.where("seq % 50 <> 7").withColumn("grade", F.when(F.col("seq") % 40 == 3, "A").otherwise(F.col("grade")))
    return rules.log_audit(old, new, "seq", ["proposition_id", "occurred_at", "grade", "cause", "blind"])


@query("=> select document_id from document where document_id % 37 = 5")
def no_delete_audit(r: Register) -> DataFrame:
    """Documents of the older snapshot that the newer one lacks."""
    old = r.table("document").select("document_id")
    return old.join(old.where("document_id % 37 <> 5"), "document_id", "left_anti")


_NEW_TYPE = "case when entity_id % 6 = 0 then 'depot' else typology end"


@query(f"""t as (select entity_id, max(case grade when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 end) as best from graded where class = 'TYPOLOGY' group by 1)
=> select entity_id, typology as old, {_NEW_TYPE} as new, coalesce(best >= 5, false) as allowed from entity left join t using (entity_id) where typology is distinct from {_NEW_TYPE}""", "graded")
def typology_changes(r: Register) -> DataFrame:
    """Changes of type between snapshots, and whether a claim of type graded C or better carries them."""
    best = r.graded.where("class = 'TYPOLOGY'").groupBy("entity_id").agg(F.max(exprs.grade_rank(F.col("grade"))).alias("best"))
    e = r.table("entity").select("entity_id", F.col("typology").alias("old"), F.expr(_NEW_TYPE).alias("new"))
    return e.where(~F.col("old").eqNullSafe(F.col("new"))).join(best, "entity_id", "left").select("entity_id", "old", "new", F.coalesce(F.col("best") >= 5, F.lit(False)).alias("allowed"))


@query("""=> select (select count(*) from entity where publication_state = 'PUBLISHED' and not is_canary) as published, (select count(distinct entity_id) from assertion where not superseded and loc_precision not in ('place_name_only', 'non_located')) as located,
(select count(*) from proposition) as propositions, (select count(*) from rollup_before) as rolled_up, (select count(*) from proposition) > (select count(*) from rollup_before) as missing_rollups, (select count(distinct entity_id) from assertion where not superseded and loc_precision not in ('place_name_only', 'non_located')) = 0 as blank_map""")
def map_guard(r: Register) -> DataFrame:
    """Counts that tell a blank map or missing rollups, in one row."""
    located = r.table("assertion").where("not superseded and loc_precision not in ('place_name_only', 'non_located')").agg(F.count_distinct("entity_id").alias("located"))
    published = r.table("entity").where("publication_state = 'PUBLISHED' and not is_canary").agg(F.count("*").alias("published"))
    counts = published.crossJoin(located).crossJoin(r.table("proposition").agg(F.count("*").alias("propositions"))).crossJoin(r.table("rollup_before").agg(F.count("*").alias("rolled_up")))
    return counts.select("*", (F.col("propositions") > F.col("rolled_up")).alias("missing_rollups"), (F.col("located") == 0).alias("blank_map"))


#: Classes of identifiers and their anchored patterns.
_GRAMMAR = {"clerk": "^Clerk#[0-9]{9}$", "brand": "^Brand#[1-4][1-5]$", "customer": "^Customer#[0-9]{6,9}[02468]$", "segment": "^[A-Z]+$"}
_IDS = "ids as (select 'brand' as class, p_brand as value from part union all select 'customer', c_name from customer union all select 'segment', c_mktsegment from customer)"


@query(_IDS + ", g as (select * from (values " + ", ".join(f"('{c}', '{p}')" for c, p in _GRAMMAR.items()) + ") t(class, pattern)) => select class, value, count(*) as n from ids join g using (class) where not regexp_matches(value, pattern) group by 1, 2")
def identifier_grammar(r: Register) -> DataFrame:
    ids = r.driver("part").select(F.lit("brand").alias("class"), F.col("p_brand").alias("value")).unionByName(r.driver("customer").select(F.explode(F.array(F.struct(F.lit("customer").alias("class"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("class"), F.col("c_mktsegment").alias("value")))).alias("x")).select("x.class", "x.value"))
    patterns = r.spark.createDataFrame(list(_GRAMMAR.items()), "class string, pattern string")
    return rules.grammar(ids, patterns).groupBy("class", "value").agg(F.count("*").alias("n"))


@query("""anchors as (select n_nationkey as band, date '1992-01-01' + cast(n_nationkey * 90 as int) as not_before, date '1998-01-01' - cast(n_nationkey * 20 as int) as not_after from nation)
=> select o_orderkey, case when o_orderdate < not_before then 'too early' else 'too late' end as finding from orders join anchors on band = o_orderkey % 1000 // 40 where o_orderdate < not_before or o_orderdate > not_after""")
def impossible_dates(r: Register) -> DataFrame:
    """Dates outside what the anchors of their number band allow: the band is the equi-key, the dates its residual."""
    anchors = r.driver("nation").select(F.col("n_nationkey").cast("long").alias("band"), F.expr("date '1992-01-01' + cast(n_nationkey * 90 as int)").alias("not_before"), F.expr("date '1998-01-01' - cast(n_nationkey * 20 as int)").alias("not_after"))
    o = r.driver("orders").withColumn("band", F.expr("cast(o_orderkey % 1000 div 40 as bigint)")).join(anchors, "band")
    return o.where("o_orderdate < not_before or o_orderdate > not_after").select("o_orderkey", F.when(F.col("o_orderdate") < F.col("not_before"), "too early").otherwise("too late").alias("finding"))


_PRESENT = {"membership": ["V", "U", "INERT", "V0"], "scope": ["INSTANCE", "CLASS", "ADJACENT"], "prov_tier": ["T1", "T2", "T3", "T4", "T5", "PENDING"]}


@query("=> " + " union all ".join(f"select '{c}' as column_name, value, coalesce(n, 0) as n, n is not null as ok from (select unnest({vs}) as value) w left join (select {c} as value, count(*) as n from obs group by 1) f using (value)" for c, vs in _PRESENT.items()) + f" union all select 'loc_precision', value, coalesce(n, 0), n is not null from (select unnest({geo.PRECISIONS}) as value) w left join (select loc_precision as value, count(*) as n from assertion group by 1) f using (value)", "obs")
def vocabulary_coverage(r: Register) -> DataFrame:
    """Whether every value of the vocabularies occurs."""
    out = None
    for frame, column, values in [*((r.observations, c, v) for c, v in _PRESENT.items()), (r.table("assertion"), "loc_precision", geo.PRECISIONS)]:
        one = rules.present(frame, column, values).select(F.lit(column).alias("column_name"), "value", "n", "ok")
        out = one if out is None else out.unionByName(one)
    return out


@query("""m as (select (select count(*) from obs) as observations, (select count(*) from raw_observation) as raw, (select count(*) from obs where membership = 'V') as v, (select sum(n_v)::bigint from counts) as v_counted, (select count(distinct proposition_id) from obs) as props, (select count(*) from counts) as props_counted)
=> select 'observations' as check_name, raw as expected, observations as actual, raw = observations as ok from m union all select 'counted rows', v, v_counted, v = v_counted from m union all select 'propositions with rows', props, props_counted, props = props_counted from m union all select 'lines loaded', (select count(*) from lineitem), raw, (select count(*) from lineitem) = raw from m""", "counts")
def load_report(r: Register) -> DataFrame:
    """Expected and actual numbers after a load, measured two ways."""
    o, counts = r.observations, evidence.counts(r.observations)
    m = o.agg(F.count("*").alias("observations"), F.count_if(F.col("membership") == "V").alias("v"), F.count_distinct("proposition_id").alias("props"))
    m = m.crossJoin(counts.agg(F.sum("n_v").alias("v_counted"), F.count("*").alias("props_counted"))).crossJoin(r.table("raw_observation").agg(F.count("*").alias("raw"))).crossJoin(r.driver("lineitem").agg(F.count("*").alias("lines")))
    rows = [("observations", "raw", "observations"), ("counted rows", "v", "v_counted"), ("propositions with rows", "props", "props_counted"), ("lines loaded", "lines", "raw")]
    stacked = m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(e).cast("long").alias("expected"), F.col(a).cast("long").alias("actual")) for n, e, a in rows))).alias("x")).select("x.*")
    return stacked.withColumn("ok", F.col("expected") == F.col("actual"))
