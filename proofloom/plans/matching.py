"""Queries that match texts, metadata and entities, and on streams that keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import norm_token
from ..operators import geo, text
from ..operators.shared import cut
from ..sources import fixture
from ..streaming import register as streams
from ..streaming import windows
from .register import Register
from .registry import query
from .texts import _NORM


@query()
def fuzzy_spans(r: Register) -> DataFrame:
    """Benchmark passages that stand in documents with edits of two percent of their length at most; no SQL, as it has no alignment with free ends: brute force in the tests."""
    return text.fuzzy_spans(r.driver("documents"), r.driver("benchmark"), 2)


_NEXT = "join document b on b.document_id = a.document_id + 1"


@query(f"""p as (select a.document_id, list_distinct(string_split(a.title, ' ')) as x, list_distinct(string_split(b.title, ' ')) as y, a.tier = b.tier as same_body, coalesce(abs(date_diff('day', a.document_date, b.document_date)) <= 400, false) as near_date from document a {_NEXT}),
j as (select *, len(list_intersect(x, y)) as n_both, len(list_distinct(list_concat(x, y))) as n_either from p)
=> select document_id, n_both * 10000 // n_either as jaccard_bp, same_body, near_date, n_both * 2 >= n_either and (same_body or near_date) as matched from j""")
def metadata_matches(r: Register) -> DataFrame:
    """Whether a document's title, class and date fit those of the next one: token overlap of half, and the class or a near date."""
    d = r.table("document").select("document_id", F.array_distinct(F.split("title", " ")).alias("x"), "tier", "document_date")
    b = d.select((F.col("document_id") - 1).alias("document_id"), F.col("x").alias("y"), F.col("tier").alias("tier_b"), F.col("document_date").alias("date_b"))
    j = d.join(b, "document_id").withColumns({"n_both": F.size(F.array_intersect("x", "y")), "n_either": F.size(F.array_union("x", "y"))})
    same, near = F.col("tier") == F.col("tier_b"), F.coalesce(F.abs(F.datediff("document_date", "date_b")) <= 400, F.lit(False))
    return j.select("document_id", F.expr("n_both * 10000 div n_either").alias("jaccard_bp"), same.alias("same_body"), near.alias("near_date"), ((F.col("n_both") * 2 >= F.col("n_either")) & (same | near)).alias("matched"))


@query(f"""al as (select item_id as entity_id, array_to_string(string_split({_NORM.format('text')}, ' ')[1:2], ' ') as alias from benchmark where item_id % 7 <> 3), w as (select doc_id, string_split({_NORM.format('text')}, ' ') as ws from documents),
g as (select distinct doc_id, ws[i::bigint] || ' ' || ws[i::bigint + 1] as alias from w, range(1, 100000) r(i) where i < len(ws)) => select entity_id, count(distinct doc_id) as documents from g join al using (alias) group by 1""")
def subject_bindings(r: Register) -> DataFrame:
    """Documents that name an entity by one of its admissible aliases: runs of two words, joined by their hash, retired aliases left out."""
    aliases = r.driver("benchmark").where("item_id % 7 <> 3").select(F.col("item_id").alias("entity_id"), F.xxhash64(F.slice(F.split(norm_token(F.col("text")), " "), 1, 2)).alias("alias"))
    runs = text._tokens(r.driver("documents"), "doc_id", "text").select("doc_id", F.explode(F.array_distinct(text._runs(F.col("words"), 2))).alias("alias"))
    return runs.join(aliases, "alias").groupBy("entity_id").agg(F.count_distinct("doc_id").alias("documents"))


@query("""p as (select conv_id, turn, unnest(string_split(text, '.')) as content, generate_subscripts(string_split(text, '.'), 1) as part from conversations)
=> select conv_id, turn, (part - 1)::int as part, (coalesce(sum(length(content) + 1) over (partition by conv_id, turn order by part rows between unbounded preceding and 1 preceding), 0) + 1)::bigint as begins, length(content)::int as n from p""")
def solicited_segments(r: Register) -> DataFrame:
    """Turns cut at full stops, each piece with where it begins."""
    s = text.segments(r.driver("conversations"), ["conv_id", "turn"], "text", "\\.")
    return s.select("conv_id", "turn", "part", "begins", F.length("content").alias("n"))


@query("""c as (select class || '/' || function_set || '/' || null_id as cluster, document_id, document_date from obs join (select proposition_id, class, function_set, p.null_id from proposition p) q using (proposition_id) join (select document_id from document) d using (document_id) where membership = 'V' and document_date is not null)
=> select cluster, arg_min(document_id, (document_date, document_id)) as first_document, min(document_date)::varchar as first_date, count(*) as rows_of_cluster from c group by 1""".replace("null_id as cluster", "q_null as cluster").replace("p.null_id from", "p.null_id as q_null from"), "obs")
def claim_clusters(r: Register) -> DataFrame:
    """The first document of each cluster of like claims."""
    p = r.table("proposition").select("proposition_id", F.concat_ws("/", "class", "function_set", "null_id").alias("cluster"))
    o = r.observations.where("membership = 'V' and document_date is not null and document_id is not null").select("proposition_id", "document_id", "document_date").join(p, "proposition_id")
    c = o.groupBy("cluster").agg(F.min(F.struct("document_date", "document_id")).alias("first"), F.count("*").alias("rows_of_cluster"))
    return c.select("cluster", F.col("first.document_id").alias("first_document"), F.col("first.document_date").cast("string").alias("first_date"), "rows_of_cluster")


@query("""h as (select document_id, regexp_extract(url, '^https://([a-z0-9]+)[.]', 1) as family, regexp_extract(url, '^https://[^.]+[.]([a-z.]+)/', 1) as kind from document), f as (select family, min(document_id) as head from h group by 1)
=> select h.document_id as copy, head as original, kind from h join f using (family) where document_id <> head""")
def host_replicas(r: Register) -> DataFrame:
    """Documents of one family of hosts as replicas of its first one."""
    h = r.table("document").select("document_id", F.regexp_extract("url", "^https://([a-z0-9]+)[.]", 1).alias("family"), F.regexp_extract("url", "^https://[^.]+[.]([a-z.]+)/", 1).alias("kind"))
    heads = h.groupBy("family").agg(F.min("document_id").alias("original"))
    return h.join(heads, "family").where("document_id <> original").select(F.col("document_id").alias("copy"), "original", "kind")


# ---- entities


@query(f"=> select c_custkey as entity_id, {_NORM.format('c_name')} as norm, c_custkey % 9 <> 2 as admissible, c_custkey % 17 = 5 as retired from customer")
def entity_aliases(r: Register) -> DataFrame:
    return r.driver("customer").select(F.col("c_custkey").alias("entity_id"), norm_token(F.col("c_name")).alias("norm"), (F.col("c_custkey") % 9 != 2).alias("admissible"), (F.col("c_custkey") % 17 == 5).alias("retired"))


_KM = 150
_GROUND = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(a.lat_c / 100) - radians(b.lat_c / 100)) / 2), 2) + cos(radians(a.lat_c / 100)) * cos(radians(b.lat_c / 100)) * pow(sin((radians(a.lon_c / 100) - radians(b.lon_c / 100)) / 2), 2))))"
_ENTITY_NAMES = "select p_partkey as id, p_name || ' ' || p_type as name from part join entity on entity_id = p_partkey"


@query(f"""e as (select entity_id as id, lon_c, lat_c, min(entity_id) over (partition by lon_c, lat_c) as class from entity), heads as (select * from e where id = class),
places as (select a.id as a, b.id as b from heads a join heads b on a.id < b.id where {_GROUND} <= {_KM * 1000} union all select class, id from e where id <> class),
q as ({_ENTITY_NAMES}), m as (select id, min(id) over (partition by coalesce(NORMNAME, '')) as class, coalesce(NORMNAME, '') as norm from q), p as (select id, '  ' || norm || ' ' as s from m where id = class),
t as (select distinct id, substr(s, i::bigint, 3) as gram from p, range(1, 400) r(i) where i <= length(s) - 2), c as (select id, count(*) as n from t group by 1),
j as (select x.id as a, y.id as b, count(*) as common from t x join t y on x.gram = y.gram and x.id < y.id group by 1, 2),
names as (select a, b from j join c ca on ca.id = a join c cb on cb.id = b where common * 100 >= 60 * (ca.n + cb.n - common) union all select class, id from m where id <> class),
flags as (select a, b, 'place' as source from places union all select a, b, 'name' from names)
=> select f.a, f.b, string_agg(source, '+' order by source) as sources, any_value(x.country = y.country and x.typology = y.typology) as same_kind from flags f join entity x on x.entity_id = f.a join entity y on y.entity_id = f.b group by 1, 2""".replace("NORMNAME", _NORM.format("name")))
def merge_flags(r: Register) -> DataFrame:
    """Entities that may be one, as flags alone, with the sources that say so: places within 150 km on the ground and names of like trigrams.

    Entities at the very same place, or of the same name, are one class: its members are flagged against the
    least of them, and the least ones against each other.
    """
    e = r.table("entity")
    at = cut(geo.place_classes(e), "place-classes")
    heads = at.where("id = class").select("id", "lon_c", "lat_c")
    star = lambda c: c.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"))
    places = geo.near_pairs(heads, _KM * 1000).unionByName(star(at))
    named = r.driver("part").join(e.select(F.col("entity_id").alias("p_partkey")), "p_partkey", "left_semi").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    classes = cut(text.name_classes(named), "name-classes")
    names = text.similar_names(classes, 60).select("a", "b").unionByName(star(classes))
    flags = places.withColumn("source", F.lit("place")).unionByName(names.withColumn("source", F.lit("name")))
    flags = flags.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    kind = e.select("entity_id", "country", "typology")
    x, y = (kind.select(F.col("entity_id").alias(k), F.col("country").alias(f"country_{k}"), F.col("typology").alias(f"typology_{k}")) for k in "ab")
    return flags.join(x, "a").join(y, "b").select("a", "b", "sources", ((F.col("country_a") == F.col("country_b")) & (F.col("typology_a") == F.col("typology_b"))).alias("same_kind"))


@query("""r as (select p_partkey as x, p_partkey - p_size as y, case p_size % 3 when 0 then 'distinct-from' when 1 then 'part-of' else 'parent-of' end as relation, p_size % 7 = 2 as retracted from part where p_size > 0 and p_partkey > p_size)
=> select least(x, y) as a, greatest(x, y) as b, relation, count(*) as n from r where not retracted and relation = 'distinct-from' group by 1, 2, 3 union all select x, y, relation, count(*) from r where not retracted and relation <> 'distinct-from' group by 1, 2, 3""")
def entity_relations(r: Register) -> DataFrame:
    """Standing relations: symmetrical ones once, the smaller entity first, others as they point."""
    p = r.driver("part").where("p_size > 0 and p_partkey > p_size and p_size % 7 <> 2")
    relation = F.when(F.col("p_size") % 3 == 0, "distinct-from").when(F.col("p_size") % 3 == 1, "part-of").otherwise("parent-of")
    e = p.select(F.col("p_partkey").alias("x"), (F.col("p_partkey") - F.col("p_size")).alias("y"), relation.alias("relation"))
    both = F.col("relation") == "distinct-from"
    e = e.select(F.when(both, F.least("x", "y")).otherwise(F.col("x")).alias("a"), F.when(both, F.greatest("x", "y")).otherwise(F.col("y")).alias("b"), "relation")
    return e.groupBy("a", "b", "relation").agg(F.count("*").alias("n"))


@query("""b as (select entity_id, document_id from obs join (select proposition_id, entity_id from proposition) p using (proposition_id) where document_id is not null and membership = 'V' group by 1, 2)
=> select entity_id, count(*) as beats, count(distinct coalesce(root, document_id)) as origins from b left join roots on node = document_id group by 1""", "roots")
def independent_coverage(r: Register) -> DataFrame:
    """Independent origins of an entity's documents: components, never the sum of documents."""
    o = r.observations.where("document_id is not null and membership = 'V'").join(r.table("proposition").select("proposition_id", "entity_id"), "proposition_id").select("entity_id", "document_id").distinct()
    with_root = o.join(r.roots.withColumnRenamed("node", "document_id"), "document_id", "left")
    return with_root.groupBy("entity_id").agg(F.count("*").alias("beats"), F.count_distinct(F.coalesce("root", "document_id")).alias("origins"))


# ---- streams


@query("=> select user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen from events group by 1, 2")
def streamed_first_appearance(r: Register) -> DataFrame:
    return windows.first_appearance(r.spark, r.sf_dir).select("user_id", "event_type", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("h as (select user_id, sha256(concat_ws('|', event_type, json_extract_string(props, '$.k'))) as content, event_id from events), g as (select user_id, content, lag(content) over (partition by user_id order by event_id) as before from h) => select user_id, count(*) filter (where before <> content) as changes, 0::bigint as late from g group by 1")
def streamed_drift(r: Register) -> DataFrame:
    """Changes of what stands behind a key from one receipt to the next; over one file no row is late."""
    return windows.drift(r.spark, r.sf_dir)


_RANKS = "case {} when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 end"


@query(f"""h as (select proposition_id, seq, grade, lag(grade) over (partition by proposition_id order by seq) as grade_from from grade_event where not blind)
=> select proposition_id, seq, grade_from, grade, case when grade_from is null then 'first' when grade_from = grade then 'same' when {_RANKS.format('grade_from')} is null or {_RANKS.format('grade')} is null then 'kind' when {_RANKS.format('grade')} > {_RANKS.format('grade_from')} then 'up' else 'down' end as direction, false as late from h""")
def streamed_moves(r: Register) -> DataFrame:
    """Every grade event with the direction of its move, from state with a timer; late ones are told and move nothing."""
    return windows.moves(r.spark, r.sf_dir, fixture.TABLES["grade_event"])


@query("=> select event_id, user_id from events a where event_type = 'view' and not exists (select 1 from events b where b.user_id = a.user_id and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 30 minutes)")
def streamed_expired_leases(r: Register) -> DataFrame:
    return windows.expired_leases(r.spark, r.sf_dir, "view", "purchase")


@query("g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as opens from events), n as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g) => select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from n group by user_id, session")
def streamed_sessions(r: Register) -> DataFrame:
    return windows.sessions(r.spark, r.sf_dir).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("""w as (select event_type, ts, unnest(generate_series(date_trunc('day', ts) - interval 6 days, date_trunc('day', ts), interval 1 day)) as start, value from events)
=> select strftime(start, '%Y-%m-%d') as day, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from w group by 1, 2""")
def streamed_sliding_counts(r: Register) -> DataFrame:
    """The same counts over windows of seven days that slide by one."""
    return windows.daily_counts(r.spark, r.sf_dir, "7 days", "1 day")


@query("=> select proposition_id, n_v, n_u, grade, final from final join counts using (proposition_id)".replace("n_v, n_u", "counts.n_v, counts.n_u"), "graded")
def streamed_regrade(r: Register) -> DataFrame:
    """Counts and grades kept up batch by batch equal those from scratch."""
    return streams.incremental_grades(r.spark, r.sf_dir)


@query("h as (select *, lag(grade) over (partition by proposition_id order by seq) as before from grade_event where not blind) => select proposition_id, arg_max(grade, seq) as grade, arg_max(coalesce(before, ''), seq) as before, count(*) as moves from h where before is null or before <> grade group by 1")
def moves_per_proposition(r: Register) -> DataFrame:
    """The last move of each proposition and how many it made."""
    h = r.table("grade_event").where("not blind").withColumn("before", F.lag("grade").over(Window.partitionBy("proposition_id").orderBy("seq"))).where("before is null or before <> grade")
    last = h.groupBy("proposition_id").agg(F.max_by(F.struct("grade", F.coalesce("before", F.lit("")).alias("before")), "seq").alias("e"), F.count("*").alias("moves"))
    return last.select("proposition_id", "e.grade", "e.before", "moves")
