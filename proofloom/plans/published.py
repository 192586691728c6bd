"""Queries on published projections, visibility, validation, geography and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import geo
from .register import Register
from .registry import query

_SHOWN = "publication_state = 'PUBLISHED' and not is_canary"


def _shown(r: Register) -> DataFrame:
    return r.table("entity").where(_SHOWN)


@query(f"=> select g.proposition_id, g.entity_id, e.name, g.class, g.grade, g.cap_text, g.limiting, g.ceiling, g.at_ceiling from graded g join entity e using (entity_id) where {_SHOWN}", "graded")
def proposition_badges(r: Register) -> DataFrame:
    g = r.graded.select("proposition_id", "entity_id", "class", "grade", "cap_text", "limiting", "ceiling", "at_ceiling")
    return g.join(_shown(r).select("entity_id", "name"), "entity_id").select("proposition_id", "entity_id", "name", "class", "grade", "cap_text", "limiting", "ceiling", "at_ceiling")


@query(f"=> select observation_id, o.proposition_id, d.title, o.prov_tier, o.membership, o.magnitude, e.country from obs o join proposition p on p.proposition_id = o.proposition_id join entity e using (entity_id) left join document d on d.document_id = o.document_id where {_SHOWN}", "obs")
def evidence_rows(r: Register) -> DataFrame:
    o = r.observations.join(r.table("proposition").select("proposition_id", "entity_id"), "proposition_id").join(_shown(r).select("entity_id", "country"), "entity_id").join(r.table("document").select("document_id", "title"), "document_id", "left")
    return o.select("observation_id", "proposition_id", "title", "prov_tier", "membership", "magnitude", "country")


@query("=> select entity_id, count(*) as propositions, count(*) filter (where grade in ('A', 'B')) as strong, count(*) filter (where grade = 'R') as refuted, string_agg(class || ':' || grade, ',' order by class || ':' || grade) as badges from graded group by 1", "graded")
def entity_summary(r: Register) -> DataFrame:
    badge = F.concat_ws(":", "class", "grade")
    return r.graded.groupBy("entity_id").agg(F.count("*").alias("propositions"), F.count_if(F.col("grade").isin("A", "B")).alias("strong"), F.count_if(F.col("grade") == "R").alias("refuted"), F.array_join(F.array_sort(F.collect_list(badge)), ",").alias("badges"))


_PIVOT = ["EXIST", "LOCATE", "FUNCTION", "PROGRAM", "TYPOLOGY"]


@query("=> select entity_id, " + ", ".join(f"count(*) filter (where class = '{c}') as n_{c.lower()}" for c in _PIVOT) + " from proposition group by 1")
def class_matrix(r: Register) -> DataFrame:
    p = r.table("proposition").groupBy("entity_id").pivot("class", _PIVOT).agg(F.count("proposition_id"))
    return p.select("entity_id", *(F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in _PIVOT))


@query("=> select proposition_id, grade, refutation from graded where grade in ('E', 'F', 'R', 'X')", "graded")
def claims_register(r: Register) -> DataFrame:
    return r.graded.where(F.col("grade").isin("E", "F", "R", "X")).select("proposition_id", "grade", "refutation")


_SORT = "case when grade = 'R' then 1 when grade = 'X' then 2 else 0 end, case grade when 'A' then 0 when 'B' then 1 when 'C' then 2 when 'D' then 3 when 'E' then 4 when 'F' then 5 else 6 end, proposition_id"


@query(f"=> select proposition_id, grade from graded order by {_SORT} limit 100 offset 100", "graded")
def register_page(r: Register) -> DataFrame:
    """The second page of a hundred in the register's order; the limit is the page."""
    from ..functions import exprs

    group = F.when(F.col("grade") == "R", 1).when(F.col("grade") == "X", 2).otherwise(0)
    return r.graded.select("proposition_id", "grade").orderBy(group, exprs.grade_rank(F.col("grade")).desc_nulls_last(), "proposition_id").offset(100).limit(100)


@query(f"=> select proposition_id from proposition where entity_id in (select entity_id from entity where {_SHOWN})")
def visible_propositions(r: Register) -> DataFrame:
    return r.table("proposition").join(_shown(r), "entity_id", "left_semi").select("proposition_id")


@query("""located as (select distinct entity_id from graded where class = 'LOCATE' and grade in ('A', 'B', 'C')),
modes as (select entity_id, lon_c, lat_c, case when loc_precision in ('place_name_only', 'non_located') then 'none' when loc_precision in ('surveyed', 'approximate_1km') and entity_id in (select entity_id from located) then 'point' when loc_precision = 'regional' then 'region_polygon' when loc_precision = 'admin_area' then 'admin_polygon' else 'uncertainty_circle' end as mode,
  case loc_precision when 'surveyed' then radius_m when 'approximate_1km' then 1000 when 'approximate_10km' then 10000 else 25000 end as radius from entity)
=> select entity_id, mode, radius::bigint as radius from modes""", "graded")
def render_gate(r: Register) -> DataFrame:
    return _features(r).select("entity_id", "mode", F.col("radius").cast("long").alias("radius"))


def _features(r: Register) -> DataFrame:
    located = r.graded.where((F.col("class") == "LOCATE") & F.col("grade").isin("A", "B", "C")).select("entity_id").distinct().withColumn("located", F.lit(True))
    e = r.table("entity").join(located, "entity_id", "left").withColumn("located", F.coalesce("located", F.lit(False)))
    return e.withColumn("mode", geo.render_mode(F.col("located"))).withColumn("radius", geo.radius())


@query(f"""f as (select entity_id, lon_c, lat_c, unnest(generate_series(2, 9))::int as zoom from entity where {_SHOWN} and loc_precision not in ('place_name_only', 'non_located')),
g as (select *, greatest(1, 36000 // (2 ** (zoom + 3))::int) as cell from f), c as (select zoom, (lon_c + 18000) // cell as cell_x, (lat_c + 9000) // cell as cell_y, count(*) as n, list_sort(list(entity_id))[1:25] as ids from g group by all)
=> select zoom, cell_x::bigint as cell_x, cell_y::bigint as cell_y, n, array_to_string(ids, ',') as sample from c""")
def map_clusters(r: Register) -> DataFrame:
    f = _shown(r).where("loc_precision not in ('place_name_only', 'non_located')").withColumn("mode", F.lit("any"))
    return geo.grid_clusters(f).drop("points")


@query(f"=> select entity_id, lon_c, lat_c from entity where {_SHOWN} and (lon_c >= 9000 or lon_c <= -9000) and lat_c between -3000 and 6000")
def viewport_over_antimeridian(r: Register) -> DataFrame:
    return geo.viewport(_shown(r), 9000, -3000, -9000, 6000).select("entity_id", "lon_c", "lat_c")


@query("=> select entity_id, round(radians(lon_c / 100) * 6378137.0, 2) as x, round(ln(tan(pi() / 4 + radians(lat_c / 100) / 2)) * 6378137.0, 2) as y from entity")
def mercator_points(r: Register) -> DataFrame:
    x, y = geo.mercator(F.col("lon_c"), F.col("lat_c"))
    return r.table("entity").select("entity_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("=> select loc_precision, count(*) as n from entity where loc_precision in ('place_name_only', 'non_located') group by 1")
def not_locatable(r: Register) -> DataFrame:
    return r.table("entity").where("loc_precision in ('place_name_only', 'non_located')").groupBy("loc_precision").agg(F.count("*").alias("n"))


@query("""=> select 'observation' as tab, 'magnitude 4 needs its gates' as rule, observation_id as key from obs where magnitude = 4 and not (gates and receipt_state = 'VERIFIED' and scope = 'INSTANCE')
union all select 'observation', 'raw magnitude clamped', observation_id from obs join (select observation_id, raw_magnitude as rm from raw_observation) using (observation_id) where rm <> magnitude union all select 'proposition', 'own parent', proposition_id::varchar from proposition where parent_id = proposition_id
union all select 'entity', 'canary published', entity_id::varchar from entity where is_canary and publication_state = 'PUBLISHED' union all select 'citation', 'duplicate edge', citing || '>' || cited from citation group by citing, cited having count(*) > 1""", "obs")
def rule_violations(r: Register) -> DataFrame:
    o = r.observations.join(r.table("raw_observation").select("observation_id", "raw_magnitude"), "observation_id")
    row = lambda df, tab, rule, key: df.select(F.lit(tab).alias("tab"), F.lit(rule).alias("rule"), key.alias("key"))
    parts = [
        row(o.where("magnitude = 4 and not (gates and receipt_state = 'VERIFIED' and scope = 'INSTANCE')"), "observation", "magnitude 4 needs its gates", F.col("observation_id")),
        row(o.where("raw_magnitude <> magnitude"), "observation", "raw magnitude clamped", F.col("observation_id")),
        row(r.table("proposition").where("parent_id = proposition_id"), "proposition", "own parent", F.col("proposition_id").cast("string")),
        row(r.table("entity").where("is_canary and publication_state = 'PUBLISHED'"), "entity", "canary published", F.col("entity_id").cast("string")),
        row(r.table("citation").groupBy("citing", "cited").count().where("count > 1"), "citation", "duplicate edge", F.concat_ws(">", "citing", "cited")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""=> select 'lineitem.l_orderkey' as ref, count(*) filter (where l_orderkey not in (select o_orderkey from orders)) as missing, count(*) as total from lineitem union all select 'orders.o_custkey', count(*) filter (where o_custkey not in (select c_custkey from customer)), count(*) from orders
union all select 'lineitem.l_partkey', count(*) filter (where l_partkey not in (select p_partkey from part)), count(*) from lineitem""")
def referential_integrity(r: Register) -> DataFrame:
    out = None
    for name, child, key, parent, pkey in (("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"), ("lineitem.l_partkey", "lineitem", "l_partkey", "part", "p_partkey")):
        found = r.driver(child).select(F.col(key).alias("k")).join(r.driver(parent).select(F.col(pkey).alias("k"), F.lit(1).alias("hit")), "k", "left")
        one = found.agg(F.count_if(F.col("hit").isNull()).alias("missing"), F.count("*").alias("total")).select(F.lit(name).alias("ref"), "missing", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("""m as (select count(*) as observations, count(*) filter (where membership = 'V') as v, count(distinct proposition_id) as propositions from obs)
=> select 'observations' as measure, observations as n from m union all select 'v', v from m union all select 'propositions', propositions from m""", "obs")
def reconciliation(r: Register) -> DataFrame:
    m = r.observations.agg(F.count("*").alias("observations"), F.count_if(F.col("membership") == "V").alias("v"), F.count_distinct("proposition_id").alias("propositions"))
    return m.unpivot([], ["observations", "v", "propositions"], "measure", "n")


@query("""h as (select entity_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('entity:' || entity_id)) as h from entity)
=> select entity_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) as surrogate from h""")
def surrogate_keys(r: Register) -> DataFrame:
    from ..sources.loading import uuid5

    return r.table("entity").select("entity_id", uuid5(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.concat(F.lit("entity:"), F.col("entity_id").cast("string"))).alias("surrogate"))


@query("=> select entity_id, name from (select entity_id, name, row_number() over (partition by entity_id order by version desc) as k from (select entity_id, name, 0 as version from entity union all select entity_id, name || ' (revised)', 1 from entity where entity_id % 3 = 0) u) t where k = 1")
def upserted_entities(r: Register) -> DataFrame:
    from ..sources.loading import upsert

    base = r.table("entity").select("entity_id", "name")
    return upsert(base, base.where("entity_id % 3 = 0").withColumn("name", F.concat("name", F.lit(" (revised)"))), ["entity_id"])


@query("=> select country, typology, entity_id, n, place from (select country, typology, entity_id, n, row_number() over (partition by country order by n desc, entity_id) as place from (select entity_id, count(*) as n from proposition group by 1) p join entity using (entity_id)) t where place <= 5")
def busiest_entities_by_country(r: Register) -> DataFrame:
    n = r.table("proposition").groupBy("entity_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("country").orderBy(F.desc("n"), "entity_id")
    return n.join(r.table("entity").select("entity_id", "country", "typology"), "entity_id").withColumn("place", F.row_number().over(w)).where("place <= 5").select("country", "typology", "entity_id", "n", "place")
