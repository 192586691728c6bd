"""Further queries: gates, re-scoring, agreement, facets, readers and tiles."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import geo, regrade
from ..operators.shared import cut
from .oracle import world
from .register import Register
from .registry import query

_SHOWN = "publication_state = 'PUBLISHED' and not is_canary"


@query("""g as (select entity_id, count(*) as n, count(*) filter (where class = 'EXIST' and grade in ('A', 'B', 'C', 'D')) as stands, sum(n_v0)::bigint as unverified from graded group by 1)
=> select entity_id, concat_ws(',', case when is_canary then 'canary' end, case when loc_precision in ('place_name_only', 'non_located') then 'no location' end, case when n is null then 'ungraded' end, case when coalesce(stands, 0) = 0 then 'existence below D' end, case when coalesce(unverified, 0) > 3 then 'unverified rows' end) as reasons
from entity left join g using (entity_id)""", "graded")
def publication_gate(r: Register) -> DataFrame:
    """Why an entity may not be published; empty where nothing speaks against it."""
    stands = (F.col("class") == "EXIST") & F.col("grade").isin("A", "B", "C", "D")
    g = r.graded.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(stands).alias("stands"), F.sum("n_v0").alias("unverified"))
    e = r.table("entity").join(g, "entity_id", "left")
    reasons = [
        ("canary", F.col("is_canary")), ("no location", F.col("loc_precision").isin("place_name_only", "non_located")), ("ungraded", F.col("n").isNull()), ("existence below D", F.coalesce("stands", F.lit(0)) == 0),
        ("unverified rows", F.coalesce("unverified", F.lit(0)) > 3),
    ]
    return e.select("entity_id", F.concat_ws(",", *(F.when(on, F.lit(name)) for name, on in reasons)).alias("reasons"))


_R = "case {} when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 end"
_SECOND = "concat('N', cast((proposition_id + 1) % 4 as string))"
_HERE = "raw_now as (select * from raw_observation), prop_now as (select * from proposition),\n"


@query(_HERE + world("other", {"proposition": f"select * replace ({_SECOND} as null_id, true as null_selected) from prop_now"}, "select proposition_id, grade from graded") + f"""
=> select proposition_id, g.grade, o.grade as co_grade, case when g.grade in ('R', 'X') then g.grade when o.grade in ('R', 'X') then o.grade when {_R.format('g.grade')} <= {_R.format('o.grade')} then g.grade else o.grade end as published from graded g join other o using (proposition_id)""", "graded")
def co_null_grades(r: Register) -> DataFrame:
    """Every proposition graded against its own null and against a second one; the lower grade is published."""
    worlds = {"own": lambda e: e, "second": lambda e: regrade.second_null(e, F.expr(_SECOND))}
    both = cut(regrade.grade_worlds(r.evidence, r.roots, worlds), "worlds")
    own, other = (both.where(F.col("world") == w).select("proposition_id", F.col("grade").alias(name)) for w, name in (("own", "grade"), ("second", "co_grade")))
    return own.join(other, "proposition_id").withColumn("published", exprs.grade_min(F.col("grade"), F.col("co_grade")))


@query("=> select f.proposition_id, f.grade as before, g.grade as after from first_pass f join graded g using (proposition_id) where f.grade is distinct from g.grade", "graded")
def rescored(r: Register) -> DataFrame:
    """What the candidate-set table changes: grades without it and with it, where they differ."""
    before, after = r.first_grades.select("proposition_id", F.col("grade").alias("before")), r.graded.select("proposition_id", F.col("grade").alias("after"))
    return before.join(after, "proposition_id", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("proposition_id", "before", "after")


#: The next version of the catalogue: entries on one null no longer exclude it, and unlisted rows on another do.
_NEXT_CATALOG = "case when catalog_null = 'N2' then false when catalog_excluding is null and catalog_null = 'N1' then true else catalog_excluding end"


@query(_HERE + world("next", {"raw_observation": f"select * replace ({_NEXT_CATALOG} as catalog_excluding) from raw_now"}, "select proposition_id, grade from graded") + f"""
=> select g.grade as before, n.grade as after, count(*) as propositions, coalesce({_R.format('n.grade')} - {_R.format('g.grade')}, 0)::int as bands from graded g join next n using (proposition_id) where g.grade <> n.grade group by 1, 2""", "graded")
def version_delta(r: Register) -> DataFrame:
    """What another version of the catalogue table changes: moves from grade to grade, how many, and by how many bands."""
    worlds = {"now": lambda e: e, "next": lambda e: replace(e, raw=e.raw.withColumn("catalog_excluding", F.expr(_NEXT_CATALOG)))}
    both = cut(regrade.grade_worlds(r.evidence, r.roots, worlds), "worlds")
    now, then = (both.where(F.col("world") == w).select("proposition_id", F.col("grade").alias(name)) for w, name in (("now", "before"), ("next", "after")))
    moved = now.join(then, "proposition_id").where("before <> after").groupBy("before", "after").agg(F.count("*").alias("propositions"))
    bands = exprs.grade_rank(F.col("after")) - exprs.grade_rank(F.col("before"))
    return moved.withColumn("bands", F.coalesce(bands, F.lit(0)).cast("int"))


@query("""b as (select proposition_id, arg_max(grade, seq) as blind_grade from grade_event where blind group by 1), l as (select proposition_id, arg_max(grade, seq) as grade from grade_event where not blind group by 1)
=> select grade, count(*) as n, count(*) filter (where grade = blind_grade) as agree from l join b using (proposition_id) group by 1""")
def blind_agreement(r: Register) -> DataFrame:
    events = r.table("grade_event")
    blind = events.where("blind").groupBy("proposition_id").agg(F.max_by("grade", "seq").alias("blind_grade"))
    shown = events.where("not blind").groupBy("proposition_id").agg(F.max_by("grade", "seq").alias("grade"))
    return shown.join(blind, "proposition_id").groupBy("grade").agg(F.count("*").alias("n"), F.count_if(F.col("grade") == F.col("blind_grade")).alias("agree"))


@query("=> select proposition_id from proposition where substr(md5(proposition_id::varchar), 1, 1) = '0'")
def rescoring_sample(r: Register) -> DataFrame:
    """The sampling operator: a stable sixteenth by hash, picked for scoring again."""
    return r.table("proposition").where(F.substring(F.md5(F.col("proposition_id").cast("string")), 1, 1) == "0").select("proposition_id")


@query(f"=> select entity_id, count(*) as hits from graded where class in ('EXIST', 'LOCATE') and grade in ('A', 'B', 'C') and entity_id in (select entity_id from entity where {_SHOWN}) group by 1", "graded")
def register_facets(r: Register) -> DataFrame:
    """Entities with a badge whose class and band both match: one predicate on the badge."""
    hit = F.col("class").isin("EXIST", "LOCATE") & F.col("grade").isin("A", "B", "C")
    badges = r.graded.groupBy("entity_id").agg(F.count_if(hit).alias("hits")).where("hits > 0")
    return badges.join(r.table("entity").where(_SHOWN), "entity_id", "left_semi").select("entity_id", "hits")


@query("=> select country, typology as most_common from (select country, typology, row_number() over (partition by country order by count(*) desc, typology) as k from entity group by country, typology) t where k = 1")
def common_typology(r: Register) -> DataFrame:
    n = r.table("entity").groupBy("country", "typology").agg(F.count("*").alias("n"))
    w = Window.partitionBy("country").orderBy(F.desc("n"), "typology")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").select("country", F.col("typology").alias("most_common"))


@query("=> select p_name as name, count(*) as parts, min(p_partkey) as first_part from part group by 1 having count(*) > 1")
def shared_identifiers(r: Register) -> DataFrame:
    return r.driver("part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part")).where("parts > 1")


@query("""t as (select floor((lon_c / 100.0::double + 180) / 360 * 64)::int as x, floor((1 - ln(tan(radians(lat_c / 100.0::double)) + 1 / cos(radians(lat_c / 100.0::double))) / pi()) / 2 * 64)::int as y from entity)
=> select x, y, count(*) as n from t group by 1, 2""")
def map_tiles(r: Register) -> DataFrame:
    return geo.tiles(r.table("entity"), 6).groupBy("x", "y").agg(F.count("*").alias("n"))


def _folder(r: Register) -> str:
    cut(r.spark.range(0), "base")
    base = r.spark.conf.get("spark.checkpoint.dir", None) or r.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base}/proofloom/files-{uuid.uuid4().hex}"


@query("=> select p_partkey, p_name, p_size from part")
def delimited_scan(r: Register) -> DataFrame:
    """Parts through a pipe-separated file, read with a given schema."""
    at = _folder(r)
    r.driver("part").select("p_partkey", "p_name", "p_size").write.option("sep", "|").option("escape", '"').csv(at)
    return r.spark.read.schema("p_partkey long, p_name string, p_size int").option("sep", "|").option("escape", '"').csv(at)


@query("=> select event_id, user_id, event_type from events")
def ledger_scan(r: Register) -> DataFrame:
    """Events through JSON lines."""
    at = _folder(r)
    r.driver("events").select("event_id", "user_id", "event_type").write.json(at)
    return r.spark.read.schema("event_id long, user_id long, event_type string").json(at)


@query("=> select c_custkey, c_mktsegment from customer")
def fixed_width_scan(r: Register) -> DataFrame:
    """Customers through fixed-width lines."""
    at = _folder(r)
    r.driver("customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.rpad("c_mktsegment", 12, " "))).write.text(at)
    line = r.spark.read.text(at)
    return line.select(F.substring("value", 1, 12).cast("long").alias("c_custkey"), F.rtrim(F.substring("value", 13, 12)).alias("c_mktsegment"))


@query("=> select c_custkey, c_name from customer")
def xml_scan(r: Register) -> DataFrame:
    at = _folder(r)
    r.driver("customer").select("c_custkey", "c_name").write.format("xml").option("rowTag", "customer").save(at)
    return r.spark.read.format("xml").schema("c_custkey long, c_name string").option("rowTag", "customer").load(at)


@query(f"""=> select 'proposition' as tab, count(*) as n from proposition where entity_id in (select entity_id from entity where {_SHOWN}) union all select 'observation', count(*) from obs where proposition_id in (select proposition_id from proposition where entity_id in (select entity_id from entity where {_SHOWN}))
union all select 'document', count(distinct document_id) from obs where proposition_id in (select proposition_id from proposition where entity_id in (select entity_id from entity where {_SHOWN}))""", "obs")
def publication_plan(r: Register) -> DataFrame:
    """How many rows of each table a publication makes visible."""
    props = r.table("proposition").join(r.table("entity").where(_SHOWN), "entity_id", "left_semi").select("proposition_id")
    o = r.observations.join(props, "proposition_id", "left_semi")
    both = o.agg(F.count("*").alias("observation"), F.count_distinct("document_id").alias("document"))
    return props.agg(F.count("*").alias("proposition")).crossJoin(both).unpivot([], ["proposition", "observation", "document"], "tab", "n")


@query("""s as (select *, case when l_shipdate - lag(l_shipdate) over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) > interval 3 days then 1 else 0 end as gap from lineitem)
=> select l_suppkey as supplier, count(*) as shipments, sum(gap)::bigint as gaps from s group by 1""")
def shipment_gaps(r: Register) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    late = F.col("l_shipdate") - F.lag("l_shipdate").over(w) > F.expr("interval 3 days")
    return r.driver("lineitem").withColumn("gap", F.when(late, 1).otherwise(0)).groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("shipments"), F.sum("gap").alias("gaps"))
