"""Projection of the driver tables onto the register's tables.

Each table is one SELECT over driver tables, in SQL that both Spark and DuckDB read; `{name}`
stands for a driver table. Integer arithmetic alone, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CLASS = "case o_orderkey % 11 when 0 then 'EXTENT' when 1 then 'HARDEN' when 2 then 'CONTROL' when 3 then 'FUNCTION' when 4 then 'STATUS' when 5 then 'LOCATE' when 6 then 'FEATURE' when 7 then 'PROGRAM' when 8 then 'IDENTITY' when 9 then 'ORIGIN' else 'TYPOLOGY' end"
_KINDS = "when 0 then 'cites' when 1 then 'syndicates' when 2 then 'paraphrases' when 3 then 'shared-error' when 4 then 'compiler-exposes' else 'mirror'"
_TIER = "case p_partkey % 7 when 0 then 'T1' when 1 then 'T2' when 2 then 'T3' when 3 then 'T3' when 4 then 'T4' when 5 then 'T5' else 'PENDING' end"

TABLES: dict[str, str] = {
    "entity": """
select c_custkey as entity_id, c_name as name, c_custkey % 97 = 0 as is_canary, case when c_custkey % 5 <> 0 then 'PUBLISHED' else 'INTERNAL' end as publication_state,
  n_name as country, case c_mktsegment when 'AUTOMOBILE' then 'depot' when 'BUILDING' then 'works' when 'FURNITURE' then 'archive' when 'MACHINERY' then 'mill' else 'relay' end as typology,
  case c_custkey % 8 when 0 then 'surveyed' when 1 then 'approximate_1km' when 2 then 'approximate_10km' when 3 then 'regional' when 4 then 'admin_area' when 5 then 'claimed_only' when 6 then 'place_name_only' else 'non_located' end as loc_precision,
  cast((c_custkey * 7919) % 36000 as bigint) - 18000 as lon_c, cast((c_custkey * 104729) % 17000 as bigint) - 8500 as lat_c, 1000 + (c_custkey % 9) * 2500 as radius_m
from {customer} join {nation} on c_nationkey = n_nationkey""",
    "proposition": f"""
select o_orderkey as proposition_id, o_custkey as entity_id, case when o_orderkey = first_key then 'EXIST' else {_CLASS} end as class, cast(o_orderdate as date) as created_on,
  o_orderkey % 13 <> 0 as null_selected, concat('FS', cast(o_orderkey % 3 as string)) as function_set, case when o_orderkey % 3 = 0 then cast((o_custkey - o_custkey % 20) / 20 as bigint) end as candidate_set_id,
  case when o_orderkey <> first_key then case when o_orderkey % 4 = 1 then prev_key else first_key end end as parent_id, concat('N', cast(o_orderkey % 4 as string)) as null_id,
  case when o_orderkey % 7 = 0 then concat('RC', cast(o_orderkey % 6 as string)) end as reference_class, o_orderkey % 101 = 0 as citogenesis, o_orderkey % 17 = 0 and o_orderkey % 34 <> 0 as r2_proposed
from (select o.*, min(o_orderkey) over (partition by o_custkey) as first_key, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as prev_key from {{orders}} o) t""",
    "document": f"""
select p_partkey as document_id, p_name as title, {_TIER} as tier, case p_size % 10 when 0 then 'ADVERSARY-WRITABLE' when 1 then 'FAITHFUL-MIRROR' else 'ORIGIN-HOST' end as channel,
  case p_size % 11 when 0 then 'SOLICITED-BY-CLAIMANT' when 1 then 'SOLICITED-3P' when 2 then 'SELF-PUBLISHED' when 3 then 'CROWD-EDITED' else 'UNSOLICITED' end as causal,
  case when p_size % 13 = 0 then 'POST-2022-UNATTRIBUTED' else 'PRE-2022' end as era, p_partkey % 23 = 0 as self_attesting, p_partkey % 29 = 0 as echo,
  case when p_partkey % 17 = 0 then concat('fam', cast(p_partkey % 3 as string)) end as model_family,
  case when p_partkey % 19 <> 0 then date '1950-01-01' + cast((p_partkey * 37) % 27000 as int) end as document_date, case when p_partkey % 2 = 0 then date '2015-01-01' + cast((p_partkey * 11) % 5000 as int) end as first_observed,
  concat('https://', lower(replace(p_brand, '#', '')), case p_partkey % 6 when 0 then '.wiki.example' when 1 then '.gov.example' when 2 then '.blog.example' when 3 then '.mirror.example' else '.news.example' end, '/doc/', cast(p_partkey as string)) as url
from {{part}}""",
    "raw_observation": """
select md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(q as string), cast(cast(round(l_extendedprice * 100) as bigint) as string),
    cast(dc as string), cast(tx as string), l_returnflag, l_linestatus, cast(cast(l_shipdate as date) as string))) as observation_id,
  l_orderkey as proposition_id, case when neg then null else l_partkey end as document_id, neg as negative_search,
  case when neg then 'UNDERCUTS' when l_returnflag = 'A' and l_linenumber = 6 then 'NEUTRAL' when l_returnflag in ('R', 'A') and l_returnflag = 'R' then 'UNDERCUTS' else 'SUPPORTS' end as sign,
  case when (l_partkey + l_linenumber) % 10 < 8 then 'INSTANCE' when (l_partkey + l_linenumber) % 10 = 8 then 'CLASS' else 'ADJACENT' end as scope,
  case when q % 10 = 0 then 'UNRESOLVED' when q % 10 = 1 then 'DEAD' else 'VERIFIED' end as receipt_state, l_partkey % 11 <> 3 as bound, q % 8 = 0 as mirror_only,
  cast((l_suppkey + l_linenumber) % 5 as int) as raw_magnitude, q % 2 = 0 as gate_a, dc <> 8 as gate_b, l_linenumber <> 5 as gate_c, l_suppkey % 9 <> 1 as gate_d, l_partkey % 3 <> 0 as gate_e, tx <> 7 as gate_f,
  case (l_partkey + l_suppkey) % 5 when 0 then 'MATRIX' when 1 then 'DEFAULT' else 'CATALOG' end as source, concat('E', cast(l_suppkey % 4 as string)) as expected, case when l_partkey % 6 <> 0 then concat('A', cast((l_partkey + l_linenumber) % 4 as string)) end as alternative,
  case when tx >= 3 then tx % 2 = 0 end as catalog_excluding, case when l_partkey % 4 <> 0 then concat('N', cast(l_suppkey % 4 as string)) end as catalog_null,
  l_suppkey % 2 = 0 as direct, dc <> 7 as lawful, q % 3 <> 0 as georeferenced, l_suppkey % 97 as witness_id, case (l_partkey + l_linenumber) % 4 when 0 then 'deposition' when 1 then 'quotation' when 2 then 'interview' else 'unknown' end as custody,
  l_suppkey % 61 = 0 as disagreed, l_suppkey % 67 = 0 as defaulted,
  case when l_linenumber % 2 = 1 then 'CLAIM' else 'PLACE' end as locus, case when l_linenumber <> 6 then concat('f', cast(l_suppkey % 7 as string)) end as fact_key, dc = 10 as superseded, dc = 9 as rebutted, cast(l_shipdate as date) as asserted_on, l_partkey % 5 = 0 as documents_null,
  case when l_suppkey % 53 = 0 then 'R3' when l_suppkey % 41 = 0 then 'R1' end as refutation_class, l_orderkey % 2 = 0 as in_basis
from (select l.*, cast(l_quantity as bigint) as q, cast(round(l_discount * 100) as int) as dc, cast(round(l_tax * 100) as int) as tx, l_linenumber = 7 and l_suppkey % 2 = 0 as neg from {lineitem} l) t""",
    "citation": f"""
select citing, cited, kind, kind <> 'compiler-exposes' as collapses from (
  select p_partkey as citing, b * 40 + ((p_partkey % 40) * 3 + 1) % 40 as cited, case p_partkey % 6 {_KINDS} end as kind from (select p_partkey, (p_partkey - p_partkey % 40) / 40 as bb, cast((p_partkey - p_partkey % 40) / 40 as bigint) as b from {{part}}) x where p_partkey % 4 <> 0
  union all
  select p_partkey, b * 40 + ((p_partkey % 40) * 7 + 5) % 40, case (p_partkey + 1) % 6 {_KINDS} end from (select p_partkey, cast((p_partkey - p_partkey % 40) / 40 as bigint) as b from {{part}}) y where p_partkey % 3 = 0) e
where citing <> cited and cited < (select count(*) from {{part}})""",
    "profile": """
select o_orderkey as proposition_id, k as profile_id, (o_orderkey + k) % 3 <> 0 as applicable, concat('X', cast((o_orderkey * 7 + k) % 4 as string)) as resolved_x, (o_orderkey + 2 * k) % 2 = 0 as searched,
  case when (o_orderkey + k) % 5 = 0 then 'NEGATIVE' when (o_orderkey + k) % 7 = 0 then 'POSITIVE' end as outcome, case when (o_orderkey + k) % 31 = 0 then 'RECORD-DESTROYED' end as override
from {orders} cross join (values (0), (1), (2), (3)) as p(k)""",
    "witness": """
select k as witness_id, k % 3 <> 0 as resolvable, case k % 4 when 0 then 'none' when 1 then 'payroll' when 2 then 'census' else 'directory' end as record_kind from (select distinct l_suppkey % 97 as k from {lineitem}) t""",
    "candidate_set": """
select candidate_set_id, candidate_set_id % 10 + 1 as documented from (select distinct cast((c_custkey - c_custkey % 20) / 20 as bigint) as candidate_set_id from {customer}) t""",
    "rollup_before": """
select o_orderkey as proposition_id, case cast((o_orderkey - o_orderkey % 7) / 7 as bigint) % 8 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' when 4 then 'E' when 5 then 'F' when 6 then 'R' else 'X' end as grade, date '1994-01-01' + cast(o_orderkey % 1500 as int) as graded_on
from {orders} where o_orderkey % 9 <> 4""",
    "publication": """
select c_custkey as entity_id, date '1993-06-01' + cast(c_custkey % 1700 as int) as first_published from {customer} where c_custkey % 3 <> 0""",
    "base_rate": """
select concat('RC', cast(r as string)) as reference_class, concat('FS', cast(f as string)) as function_set, class, case (r + f + length(class)) % 3 when 0 then 'COMMON' when 1 then 'RARE' else 'UNKNOWN' end as reading
from (select distinct l_linenumber - 1 as r from {lineitem}) a cross join (select distinct o_orderkey % 3 as f from {orders}) b cross join (values ('EXIST'), ('LOCATE'), ('FUNCTION'), ('PROGRAM'), ('STATUS')) as c(class)""",
    "assertion": """
select c_custkey as entity_id, k as assertion_id, case (c_custkey + 3 * k) % 8 when 0 then 'surveyed' when 1 then 'approximate_1km' when 2 then 'approximate_10km' when 3 then 'regional' when 4 then 'admin_area' when 5 then 'claimed_only' when 6 then 'place_name_only' else 'non_located' end as loc_precision,
  k = 1 and c_custkey % 4 <> 0 as preferred, (c_custkey + k) % 11 = 0 as superseded, cast((c_custkey * 7919 + k * (c_custkey % 3) * 17) % 36000 as bigint) - 18000 as lon_c, cast((c_custkey * 104729) % 17000 as bigint) - 8500 as lat_c, case when (c_custkey + k) % 5 <> 0 then 1000 + (c_custkey % 9) * 2500 end as radius_m
from {customer} cross join (values (0), (1), (2)) as p(k) where (c_custkey + k) % 4 <> 1""",
    "grade_event": """
select event_id as seq, user_id as proposition_id, ts as occurred_at, case event_id % 8 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' when 4 then 'E' when 5 then 'F' when 6 then 'R' else 'X' end as grade,
  case event_type when 'click' then 'NEW-SEARCH' when 'view' then 'NEW-VERIFICATION' when 'purchase' then 'NEW-DISCLOSURE' when 'signup' then 'SCORER-CHANGE' else 'RE-ANALYSIS' end as cause, event_id % 10 = 9 as blind
from {events}""",
    "agent_run": """
select event_id as run_id, user_id % 12 as agent, ts as started_at, k as emitted, cast((k * (event_id % 5) - (k * (event_id % 5)) % 5) / 5 as bigint) as resolved, event_id % 37 = 0 as canary
from (select e.*, cast(KEXPR as bigint) as k from {events} e) t""",
}

DRIVER = ["customer", "nation", "orders", "part", "lineitem", "events"]
_K = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One register table, made lazily from the driver tables it reads."""
    sql = TABLES[name].replace("KEXPR", _K["spark"])
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DRIVER if f"{{{t}}}" in sql})


def ctes() -> str:
    """The same tables as DuckDB common table expressions."""
    plain = {t: t for t in DRIVER}
    return ",\n".join(f"{n} as ({sql.replace('KEXPR', _K['duckdb']).format(**plain)})" for n, sql in TABLES.items())
