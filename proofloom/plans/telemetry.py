"""Queries on the register's own health, and on maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import geo
from .register import Register
from .registry import query

_SHOWN = "publication_state = 'PUBLISHED' and not is_canary"
_RANK = "case {} when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 end"


@query("s as (select class, count(*) as n, count(*) filter (where grade = 'C') as c from graded group by 1) => select class, c * 10000 // n as share_bp, c * 10000 // n > 1500 as alert from s", "graded")
def band_alerts(r: Register) -> DataFrame:
    """Classes of claims of which more than 15 percent stand at C."""
    s = r.graded.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("grade") == "C").alias("c")).withColumn("share_bp", F.expr("c * 10000 div n"))
    return s.select("class", "share_bp", (F.col("share_bp") > 1500).alias("alert"))


@query("""h as (select *, lag(grade) over (partition by proposition_id order by seq) as before from grade_event where not blind)
=> select count(*) filter (where grade = 'R') as refuted, count(*) filter (where before = 'R' and grade <> 'R') as reversed, (select count(*) from rollup_before where graded_on < date '1995-06-01') as overdue from h""")
def refutation_counts(r: Register) -> DataFrame:
    """Refutations, refutations taken back, and grades that are due for review."""
    h = r.table("grade_event").where("not blind").withColumn("before", F.lag("grade").over(Window.partitionBy("proposition_id").orderBy("seq")))
    counts = h.agg(F.count_if(F.col("grade") == "R").alias("refuted"), F.count_if((F.col("before") == "R") & (F.col("grade") != "R")).alias("reversed"))
    return counts.crossJoin(r.table("rollup_before").where("graded_on < date '1995-06-01'").agg(F.count("*").alias("overdue")))


@query("=> select (select count(*) from entity) as entities, (select count(*) from proposition) as propositions, (select count(*) from document) as documents, (select count(*) from raw_observation) as observations, (select string_agg(grade || ':' || n, ',' order by grade) from (select grade, count(*) as n from rollup_before group by 1) t) as grades")
def register_summary(r: Register) -> DataFrame:
    one = lambda t, name: r.table(t).agg(F.count("*").alias(name))
    grades = r.table("rollup_before").groupBy("grade").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "grade", "n"))), ",").alias("grades"))
    return one("entity", "entities").crossJoin(one("proposition", "propositions")).crossJoin(one("document", "documents")).crossJoin(one("raw_observation", "observations")).crossJoin(grades)


@query("""expected as (select proposition_id, case when proposition_id % 3 = 0 then grade when proposition_id % 3 = 1 then 'C' end as want from rollup_before where proposition_id % 20 < 6)
=> select proposition_id, want, grade, want is not distinct from grade as ok from expected left join (select proposition_id, arg_max(grade, seq) as grade from grade_event where not blind group by 1) l using (proposition_id)""")
def calibration_run(r: Register) -> DataFrame:
    """Expected and returned grades of calibration claims; no grade expected and none returned is right too."""
    want = F.when(F.col("proposition_id") % 3 == 0, F.col("grade")).when(F.col("proposition_id") % 3 == 1, "C")
    expected = r.table("rollup_before").where("proposition_id % 20 < 6").select("proposition_id", want.alias("want"))
    got = r.table("grade_event").where("not blind").groupBy("proposition_id").agg(F.max_by("grade", "seq").alias("grade"))
    return expected.join(got, "proposition_id", "left").withColumn("ok", F.col("want").eqNullSafe(F.col("grade")))


@query("=> select strftime(date_trunc('month', occurred_at), '%Y-%m') as month, count(*) as events, count(*) filter (where seq % 25 = 3) as merges, count(*) filter (where seq % 40 = 9) as splits, count(*) filter (where seq % 25 = 3) * 10000 // count(*) as merge_bp from grade_event group by 1")
def merge_split_rates(r: Register) -> DataFrame:
    e = r.table("grade_event").groupBy(F.date_format("occurred_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("events"), F.count_if(F.col("seq") % 25 == 3).alias("merges"), F.count_if(F.col("seq") % 40 == 9).alias("splits"))
    return e.withColumn("merge_bp", F.expr("merges * 10000 div events"))


@query("""o as (select membership, count(*) as n from obs group by 1), t as (select sum(n)::bigint as total from o), e as (select * from (values ('V', 3000), ('U', 1000), ('INERT', 3500), ('V0', 1500), ('LOST', 0)) x(membership, expected_bp))
=> select membership, expected_bp, coalesce(n, 0) * 10000 // total as observed_bp from e left join o using (membership) cross join t""", "obs")
def expectation_table(r: Register) -> DataFrame:
    """What was expected of the evidence against what is there; a registry of five rows."""
    o = r.observations.groupBy("membership").agg(F.count("*").alias("n"))
    expected = r.spark.createDataFrame([("V", 3000), ("U", 1000), ("INERT", 3500), ("V0", 1500), ("LOST", 0)], "membership string, expected_bp int")
    both = expected.join(o, "membership", "left").crossJoin(o.agg(F.sum("n").alias("total")))
    return both.select("membership", "expected_bp", F.expr("coalesce(n, 0) * 10000 div total").alias("observed_bp"))


@query("=> select proposition_id % 7 as theme, count(*) as searches, count(*) filter (where outcome = 'NEGATIVE') as empty, count(distinct proposition_id) as examined from profile where searched group by 1")
def null_return_coverage(r: Register) -> DataFrame:
    """What was looked at and found empty, by theme."""
    return r.table("profile").where("searched").groupBy((F.col("proposition_id") % 7).alias("theme")).agg(F.count("*").alias("searches"), F.count_if(F.col("outcome") == "NEGATIVE").alias("empty"), F.count_distinct("proposition_id").alias("examined"))


@query("""w as (select p_partkey, unnest(string_split(p_name, ' ')) as beat from part), c as (select beat, count(distinct p_partkey) as candidates from w group by 1), runs as (select agent, count(*) as runs, count(distinct cast(started_at as date)) as days from agent_run group by 1)
=> select 'beat' as kind, beat as name, candidates as n from c union all select 'agent', agent::varchar, runs from runs""")
def candidates_per_beat(r: Register) -> DataFrame:
    """Different candidates of each beat and runs of each agent; a candidate of several beats counts in each."""
    beats = r.driver("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("beat")).groupBy("beat").agg(F.count_distinct("p_partkey").alias("n")).select(F.lit("beat").alias("kind"), F.col("beat").alias("name"), "n")
    agents = r.table("agent_run").groupBy("agent").agg(F.count("*").alias("n")).select(F.lit("agent").alias("kind"), F.col("agent").cast("string").alias("name"), "n")
    return beats.unionByName(agents)


@query("""sh as (select root, count(distinct tier) as tiers, count(*) as nodes, min(node) as first_node from roots join document on document_id = node group by 1), done as (select distinct citing from citation where kind = 'mirror')
=> select first_node, nodes, tiers from sh where tiers > 1 and first_node not in (select citing from done)""", "roots")
def shared_node_disagreement(r: Register) -> DataFrame:
    """Lineages whose documents are of several classes, proposed for curation unless they are known mirrors."""
    n = r.roots.join(r.table("document").select(F.col("document_id").alias("node"), "tier"), "node").groupBy("root").agg(F.count_distinct("tier").alias("tiers"), F.count("*").alias("nodes"), F.min("node").alias("first_node"))
    known = r.table("citation").where("kind = 'mirror'").select(F.col("citing").alias("first_node")).distinct()
    return n.where("tiers > 1").join(known, "first_node", "left_anti").select("first_node", "nodes", "tiers")


@query("""b as (select proposition_id, arg_max(cause, seq) as cause, arg_max(grade, seq) as grade from grade_event where blind group by 1), l as (select proposition_id, arg_max(cause, seq) as cause, arg_max(grade, seq) as grade from grade_event where not blind group by 1)
=> select condition, count(*) as n, count(*) filter (where agrees) as agree from (select 'grade' as condition, l.grade = b.grade as agrees from l join b using (proposition_id) union all select 'cause', l.cause = b.cause from l join b using (proposition_id) union all select 'ranked', (l.grade in ('R', 'X')) = (b.grade in ('R', 'X')) from l join b using (proposition_id)) t group by 1""")
def agreement_by_condition(r: Register) -> DataFrame:
    """Agreement of blind and shown gradings, condition by condition."""
    last = lambda c: r.table("grade_event").where(c).groupBy("proposition_id").agg(F.max_by(F.struct("grade", "cause"), "seq").alias("e"))
    both = last("not blind").withColumnRenamed("e", "a").join(last("blind").withColumnRenamed("e", "b"), "proposition_id")
    unranked = lambda x: F.col(f"{x}.grade").isin("R", "X")
    conditions = {"grade": F.col("a.grade") == F.col("b.grade"), "cause": F.col("a.cause") == F.col("b.cause"), "ranked": unranked("a") == unranked("b")}
    told = both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("condition"), v.alias("agrees")) for k, v in conditions.items()))).alias("x"))
    return told.groupBy("x.condition").agg(F.count("*").alias("n"), F.count_if("x.agrees").alias("agree"))


# ---- maps


@query("""k as (select entity_id, unnest(generate_series(0, 64)) as i, lat_c / 100.0::double as lat, lon_c / 100.0::double as lon, coalesce(radius_m, 25000)::double as rad from entity where loc_precision = 'approximate_10km')
=> select entity_id, i::int as i, round(lat + degrees(rad / 6371000.0) * sin(2 * pi() * i / 64), 5) as y, round(lon + degrees(rad / 6371000.0) / greatest(cos(radians(lat)), 0.01) * cos(2 * pi() * i / 64), 5) as x from k""")
def ground_circles(r: Register) -> DataFrame:
    """Uncertainty circles as rings of 64 segments, closed."""
    return geo.rings(r.table("entity").where("loc_precision = 'approximate_10km'"), 64).select("entity_id", "i", F.round("y", 5).alias("y"), F.round("x", 5).alias("x"))


@query("""box as (select entity_id, lon_c - radius_m / 1000 as west, lon_c + radius_m / 1000 as east, lat_c - radius_m / 2000 as south, lat_c + radius_m / 2000 as north from entity where loc_precision in ('regional', 'admin_area'))
=> select entity_id, round((west + east) / 2, 3) as x, round((south + north) / 2, 3) as y from box""")
def label_points(r: Register) -> DataFrame:
    """A point within each area: the middle of the chord through its middle line."""
    e = r.table("entity").where("loc_precision in ('regional', 'admin_area')")
    ring = F.array(*(F.struct((F.col("lon_c") + sx * F.col("radius_m") / 1000).alias("x"), (F.col("lat_c") + sy * F.col("radius_m") / 2000).alias("y")) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    x, y = geo.label_point(ring)
    return e.select("entity_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""ex as (select entity_id, arg_min(grade, proposition_id) as g from graded where class = 'EXIST' group by 1), n as (select entity_id, count(*) as propositions, count(*) filter (where grade = 'R') as refuted, count(*) filter (where grade = 'X') as unassessed from graded group by 1)
=> select entity_id, g as exist_grade, lon_c, lat_c, propositions, refuted, unassessed from entity join ex using (entity_id) join n using (entity_id) where {_SHOWN} and {_RANK.format('g')} >= 4 and loc_precision not in ('place_name_only', 'non_located')""", "graded")
def map_features(r: Register) -> DataFrame:
    """What the map shows: published entities whose existence stands at D or better, with three counts of their claims."""
    g = r.graded
    exist = g.where("class = 'EXIST'").groupBy("entity_id").agg(F.min_by("grade", "proposition_id").alias("exist_grade"))
    n = g.groupBy("entity_id").agg(F.count("*").alias("propositions"), F.count_if(F.col("grade") == "R").alias("refuted"), F.count_if(F.col("grade") == "X").alias("unassessed"))
    e = r.table("entity").where(_SHOWN).where("loc_precision not in ('place_name_only', 'non_located')").join(exist, "entity_id").join(n, "entity_id")
    return e.where(exprs.grade_rank(F.col("exist_grade")) >= 4).select("entity_id", "exist_grade", "lon_c", "lat_c", "propositions", "refuted", "unassessed")


@query("""f as (select entity_id, loc_precision, unnest(generate_series(2, 9))::int as zoom, radians(lon_c / 100.0::double) * 6378137.0 as x, ln(tan(pi() / 4 + radians(lat_c / 100.0::double) / 2)) * 6378137.0 as y from entity where loc_precision not in ('place_name_only', 'non_located')),
c as (select *, 40075016.686 / (2 ** zoom) / 4 as cell from f), k as (select zoom, floor(x / cell + 0.5)::bigint as cell_x, floor(y / cell + 0.5)::bigint as cell_y, loc_precision from c)
=> select zoom, cell_x, cell_y, count(*) as n, count(*) filter (where loc_precision in ('surveyed', 'approximate_1km')) as precise, count(*) filter (where loc_precision in ('approximate_10km', 'claimed_only')) as rough, count(*) filter (where loc_precision in ('regional', 'admin_area')) as areas from k group by 1, 2, 3""")
def metric_clusters(r: Register) -> DataFrame:
    """Clusters on a metric grid whose cells halve with every zoom, with the precisions of what is in them."""
    e = r.table("entity").where("loc_precision not in ('place_name_only', 'non_located')")
    x, y = geo.mercator(F.col("lon_c"), F.col("lat_c"))
    z = e.select("loc_precision", x.alias("x"), y.alias("y"), F.explode(F.sequence(F.lit(2), F.lit(9))).alias("zoom")).withColumn("cell", F.lit(40075016.686) / F.pow(F.lit(2.0), "zoom") / 4)
    p = F.col("loc_precision")
    return z.groupBy("zoom", F.floor(F.col("x") / F.col("cell") + 0.5).cast("long").alias("cell_x"), F.floor(F.col("y") / F.col("cell") + 0.5).cast("long").alias("cell_y")).agg(
        F.count("*").alias("n"), F.count_if(p.isin("surveyed", "approximate_1km")).alias("precise"), F.count_if(p.isin("approximate_10km", "claimed_only")).alias("rough"), F.count_if(p.isin("regional", "admin_area")).alias("areas")
    )


@query("=> select entity_id, count(*) as assertions, count(distinct lon_c || '/' || lat_c) as positions, count(distinct lon_c || '/' || lat_c) > 1 as conflict from assertion where not superseded group by 1")
def competing_assertions(r: Register) -> DataFrame:
    """How many locations of an entity stand against each other; they are never averaged."""
    a = r.table("assertion").where("not superseded").groupBy("entity_id").agg(F.count("*").alias("assertions"), F.count_distinct("lon_c", "lat_c").alias("positions"))
    return a.withColumn("conflict", F.col("positions") > 1)


@query("""ed as (select p_partkey % 50 as feature, p_size % 5 as edition from part group by 1, 2), l as (select *, lead(edition) over (partition by feature order by edition) as next_edition from ed)
=> select feature, edition as last_seen, coalesce(next_edition, 5) as seen_again from l where edition < 4 and coalesce(next_edition, 5) > edition + 1""")
def edition_gaps(r: Register) -> DataFrame:
    """Features that stand in an edition and are missing from the next one."""
    ed = r.driver("part").select((F.col("p_partkey") % 50).alias("feature"), (F.col("p_size") % 5).alias("edition")).distinct()
    follow = F.coalesce(F.lead("edition").over(Window.partitionBy("feature").orderBy("edition")), F.lit(5))
    return ed.withColumn("seen_again", follow).where("edition < 4 and seen_again > edition + 1").select("feature", F.col("edition").alias("last_seen"), "seen_again")


@query("""areas as (select n_nationkey as area, n_nationkey % 5 * 6000 - 15000 as west, n_nationkey // 5 * 3200 - 8000 as south from nation), pts as (select entity_id, lon_c, lat_c from entity)
=> select entity_id, area from pts join areas on lon_c >= west and lon_c < west + 5000 and lat_c >= south and lat_c < south + 2500 and (lon_c - west) + 2 * (lat_c - south) < 8000""")
def points_in_areas(r: Register) -> DataFrame:
    """Points within polygons: both sides are keyed by grid cells, then rays are counted in the ring of the area."""
    areas = r.driver("nation").select(F.col("n_nationkey").cast("long").alias("area"), F.expr("cast(n_nationkey % 5 * 6000 - 15000 as bigint)").alias("w"), F.expr("cast(n_nationkey div 5 * 3200 - 8000 as bigint)").alias("s"))
    corner = lambda dx, dy: F.struct((F.col("w") + dx).cast("double").alias("x"), (F.col("s") + dy).cast("double").alias("y"))
    rings = areas.select("area", F.array(corner(0, 0), corner(5000, 0), corner(5000, 1500), corner(3000, 2500), corner(0, 2500), corner(0, 0)).alias("ring"))
    return geo.points_in_rings(r.table("entity").select("entity_id", "lon_c", "lat_c"), rings, 1000).select("entity_id", "area")


@query(f"""f as (select entity_id, lon_c, lat_c from entity where {_SHOWN}), v as (select n_nationkey as view_id, n_nationkey % 5 * 6000 - 15000 as west, n_nationkey % 5 * 6000 - 11000 as east, n_nationkey // 5 * 3200 - 8000 as south, n_nationkey // 5 * 3200 - 6000 as north from nation)
=> select view_id, count(*) as features from f join v on lon_c between west and east and lat_c between south and north group by 1""")
def features_per_viewport(r: Register) -> DataFrame:
    """Features of many boxes at once, joined by the grid cells that a box covers."""
    v = r.driver("nation").select(F.col("n_nationkey").cast("long").alias("view_id"), F.expr("cast(n_nationkey % 5 * 6000 - 15000 as bigint)").alias("west"), F.expr("cast(n_nationkey div 5 * 3200 - 8000 as bigint)").alias("south"))
    v = v.withColumns({"east": F.col("west") + 4000, "north": F.col("south") + 2000})
    return geo.in_boxes(r.table("entity").where(_SHOWN), v, 1000).groupBy("view_id").agg(F.count("*").alias("features"))
