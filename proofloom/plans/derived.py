"""Queries on derived columns, sorts, facets, lookups and read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derived, exprs, vocab
from ..operators import evidence, geo
from ..sources import loading
from .register import Register
from .registry import query

_SHOWN = "publication_state = 'PUBLISHED' and not is_canary"
_CLASS_ORDER = "EXIST,EXTENT,HARDEN,CONTROL,FUNCTION,STATUS,LOCATE,FEATURE,PROGRAM,IDENTITY,ORIGIN,TYPOLOGY"
_RANK = "case {} when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 end"


def _case(column: str, table: dict, default: str = "null") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {column} " + " ".join(f"when '{k}' then {quote(v)}" for k, v in table.items()) + f" else {default} end"


# ---- derived columns


@query("=> select observation_id, scope, bound from obs where scope <> 'INSTANCE'", "obs")
def scope_demotions(r: Register) -> DataFrame:
    """Rows that are not about the instance, those among them that were not bound to it included."""
    return r.observations.where("scope <> 'INSTANCE'").select("observation_id", "scope", "bound")


@query("""=> select proposition_id, case class when 'EXTENT' then json_object('metres', proposition_id * 10) when 'FUNCTION' then json_object('function', function_set) when 'STATUS' then json_object('status', function_set, 'year', proposition_id % 60 + 1940)
when 'LOCATE' then json_object('precision', function_set) else '{}' end::varchar as args from proposition""")
def predicate_arguments(r: Register) -> DataFrame:
    return r.table("proposition").select("proposition_id", derived.predicate_args(F.col("class"), F.col("proposition_id"), F.col("function_set")).alias("args"))


@query("=> select page_id, case when html like '%network%' then 'NETWORK' when html like '%complex%' then 'COMPLEX' when html like '%building%' then 'BUILDING' else 'SITE' end as level from pages")
def entity_levels(r: Register) -> DataFrame:
    return r.driver("pages").select("page_id", F.coalesce(derived.level(F.col("html")), F.lit("SITE")).alias("level"))


@query(f"=> select proposition_id, silence, {_case('silence', derived.SILENCE_TEXT)} as said from searched", "counts")
def silence_prose(r: Register) -> DataFrame:
    return evidence.search(r.table("profile")).select("proposition_id", "silence", derived.silence_text(F.col("silence")).alias("said"))


@query("=> select observation_id, " + " || ".join(f"case when {g} then '1' else '0' end" for g in evidence.GATES) + " as gates, gates as passes from obs where magnitude >= 3", "obs")
def gate_conditions(r: Register) -> DataFrame:
    """The six gates of strong rows as one struct, shown as digits."""
    o = r.observations.where("magnitude >= 3").withColumn("gate", F.struct(*evidence.GATES))
    return o.select("observation_id", F.concat(*(F.when(F.col(f"gate.{g}"), "1").otherwise("0") for g in evidence.GATES)).alias("gates"), F.col("gates").alias("passes"))


@query("""ex as (select entity_id, arg_min(grade, proposition_id) as g from graded where class = 'EXIST' group by 1), lo as (select entity_id, bool_or(grade in ('A', 'B', 'C')) as located from graded where class = 'LOCATE' group by 1)
=> select entity_id, concat_ws(',', case when g in ('E', 'F') then 'ED' end, case when not coalesce(located, false) and loc_precision in ('surveyed', 'approximate_1km') then 'PD' end, case when loc_precision in ('approximate_1km', 'approximate_10km', 'regional') then 'PA' end, case when g = 'D' then 'Rep' end) as tags
from entity left join ex using (entity_id) left join lo using (entity_id)""", "graded")
def chart_tags(r: Register) -> DataFrame:
    g = r.graded
    exist = g.where("class = 'EXIST'").groupBy("entity_id").agg(F.min_by("grade", "proposition_id").alias("g"))
    located = g.where("class = 'LOCATE'").groupBy("entity_id").agg(F.bool_or(F.col("grade").isin("A", "B", "C")).alias("located"))
    e = r.table("entity").join(exist, "entity_id", "left").join(located, "entity_id", "left")
    return e.select("entity_id", F.array_join(derived.chart_tags(F.col("g"), F.coalesce("located", F.lit(False)), F.col("loc_precision")), ",").alias("tags"))


@query("=> select c_custkey, trim(list_extract(string_split(c_name || ', ' || n_name, ','), -1)) as jurisdiction from customer join nation on n_nationkey = c_nationkey")
def jurisdictions(r: Register) -> DataFrame:
    c = r.driver("customer").join(r.driver("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", derived.last_part(F.concat_ws(", ", "c_name", "n_name")).alias("jurisdiction"))


@query(f"=> select proposition_id, case when {_RANK.format('grade')} is null then '' else array_to_string(list_filter(['F', 'E', 'D', 'C', 'B', 'A'], lambda g: {_RANK.format('g')} > {_RANK.format('grade')} and {_RANK.format('g')} <= {_RANK.format('ceiling')}), ',') end as stops from graded", "graded")
def stops_to_ceiling(r: Register) -> DataFrame:
    return r.graded.select("proposition_id", F.array_join(derived.stops_between(F.col("grade"), F.col("ceiling")), ",").alias("stops"))


@query(f"""n as (select entity_id, grade, string_agg(class, ', ' order by list_position(string_split('{_CLASS_ORDER}', ','), class)) as classes from (select distinct entity_id, grade, class from graded) t group by 1, 2)
=> select entity_id, string_agg(grade || ': ' || classes, '; ' order by strpos('ABCDEFRX', grade)) as sentence from n group by 1""", "graded")
def scope_sentences(r: Register) -> DataFrame:
    """What is claimed of an entity, grade by grade in fixed order; grades and classes are few, so the lists are short."""
    place = F.array_position(F.array(*(F.lit(c) for c in _CLASS_ORDER.split(","))), F.col("class"))
    g = r.graded.select("entity_id", "grade", "class").distinct().groupBy("entity_id", "grade").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "class"))).alias("c"))
    g = g.withColumn("text", F.concat(F.col("grade"), F.lit(": "), F.array_join(F.col("c.class"), ", "))).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(F.instr(F.lit("ABCDEFRX"), F.col("grade")).alias("p"), "text"))).alias("s"))
    return g.select("entity_id", F.array_join(F.col("s.text"), "; ").alias("sentence"))


@query("""=> select document_id, case when least(first_observed, document_date) <= date '2022-11-30' then 'PRE-2022' when (first_observed is null and document_date is null) or document_date is null then 'POST-2022-UNATTRIBUTED' else 'POST-2022-ATTRIBUTED' end as era from document""")
def corpus_eras(r: Register) -> DataFrame:
    return r.table("document").select("document_id", derived.corpus_era(F.col("first_observed"), F.lit(None).cast("date"), F.col("document_date")).alias("era"))


@query("""asked as (select distinct c_custkey % 40 as host_no, date '1990-01-01' + cast(c_custkey % 9000 as int) as asked_on from customer where c_custkey % 5 = 0), first_ask as (select host_no, min(asked_on) as asked_on from asked group by 1)
=> select document_id, case when asked_on is not null and document_date >= asked_on then 'SOLICITED-BY-CLAIMANT' when asked_on is not null and document_date is null then 'UNKNOWN' else causal end as cause from document left join first_ask on host_no = document_id % 40""")
def causal_provenance(r: Register) -> DataFrame:
    """A document dated at or after a logged request to its source counts as solicited; undated ones of asked sources are unknown."""
    asked = r.driver("customer").where("c_custkey % 5 = 0").select((F.col("c_custkey") % 40).alias("host_no"), F.expr("date '1990-01-01' + cast(c_custkey % 9000 as int)").alias("asked_on")).groupBy("host_no").agg(F.min("asked_on").alias("asked_on"))
    d = r.table("document").withColumn("host_no", F.col("document_id") % 40).join(asked, "host_no", "left")
    known = F.col("asked_on").isNotNull()
    return d.select("document_id", F.when(known & (F.col("document_date") >= F.col("asked_on")), "SOLICITED-BY-CLAIMANT").when(known & F.col("document_date").isNull(), "UNKNOWN").otherwise(F.col("causal")).alias("cause"))


@query(f"=> select observation_id, least(magnitude, {_case('custody', derived.CUSTODY_CAP, '0')}) as magnitude from obs", "obs")
def custody_caps(r: Register) -> DataFrame:
    return r.observations.select("observation_id", derived.custody_capped(F.col("magnitude"), F.col("custody")).alias("magnitude"))


_LABEL = "case witness_id % 5 when 0 then 'STATES-ON-FACE' when 1 then 'ENTAILS' when 2 then 'CONSISTENT-WITH-BOTH' when 3 then 'UNDERCUTS' else 'IRRELEVANT' end"


@query(f"m as (select observation_id, magnitude, sign, {_LABEL} as label from obs) => select observation_id, label, least(magnitude, {_case('label', derived.LABEL_CAP, '0')}) as magnitude, case when label = 'UNDERCUTS' then 'UNDERCUTS' else sign end as sign from m", "obs")
def demoted_labels(r: Register) -> DataFrame:
    """Rows under the label that a reader gave them: it can lower a magnitude and turn a sign, nothing else."""
    o = r.observations.withColumn("label", F.expr(_LABEL))
    magnitude, sign = derived.demoted(F.col("magnitude"), F.col("sign"), F.col("label"))
    return o.select("observation_id", "label", magnitude.alias("magnitude"), sign.alias("sign"))


#: Suffixes of hosts and what they say of a document.
_HOSTS = {"wiki.example": "CROWD-EDITED", "blog.example": "WRITABLE", "mirror.example": "MACHINE-MIRROR"}


@query("=> select document_id, case when host like '%.wiki.example' then 'CROWD-EDITED' when host like '%.blog.example' then 'WRITABLE' when host like '%.mirror.example' then 'MACHINE-MIRROR' end as rule from (select document_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from document) t")
def host_provenance(r: Register) -> DataFrame:
    return r.table("document").select("document_id", loading.host_rule(F.col("url"), _HOSTS).alias("rule"))


@query("=> select document_id, case when length(title) > 20 then rtrim(substr(title, 1, 19)) || '…' else title end as short_title from document")
def short_titles(r: Register) -> DataFrame:
    return r.table("document").select("document_id", derived.truncated(F.col("title"), 20).alias("short_title"))


# ---- filters, sorts and lookups


@query("""asked as (select c_custkey, list_distinct(list_sort(list_filter(string_split(upper(c_mktsegment), ''), lambda g: g in ('A', 'B', 'C', 'D', 'E', 'F', 'R', 'X')))) as bands from customer)
=> select c_custkey, array_to_string(list_sort(bands), ',') as bands, (len(bands) > 0)::int as active from asked""")
def parsed_facets(r: Register) -> DataFrame:
    """Requested bands: what is no known value is dropped, the rest counts as one active facet."""
    known = F.array(*(F.lit(g) for g in "ABCDEFRX"))
    bands = F.array_sort(F.array_intersect(F.split(F.upper("c_mktsegment"), ""), known))
    return r.driver("customer").select("c_custkey", F.array_join(bands, ",").alias("bands"), (F.size(bands) > 0).cast("int").alias("active"))


@query("=> select entity_id from graded group by 1 having bool_or(class = 'FUNCTION') and bool_or(grade in ('A', 'B'))", "graded")
def simple_filter(r: Register) -> DataFrame:
    """Entities with some badge of the class and some badge of the band, each by itself."""
    g = r.graded.groupBy("entity_id").agg(F.bool_or(F.col("class") == "FUNCTION").alias("c"), F.bool_or(F.col("grade").isin("A", "B")).alias("b"))
    return g.where("c and b").select("entity_id")


@query("=> select entity_id, assertion_id, loc_precision from assertion where not superseded and assertion_id = (select max(assertion_id) from assertion b where b.entity_id = assertion.entity_id and not b.superseded)")
def current_assertions(r: Register) -> DataFrame:
    """Only the current version of each entity's location: a semi join with the newest ones."""
    a = r.table("assertion").where("not superseded")
    return a.join(a.groupBy("entity_id").agg(F.max("assertion_id").alias("assertion_id")), ["entity_id", "assertion_id"], "left_semi").select("entity_id", "assertion_id", "loc_precision")


_CHILDREN = {"observation": ("obs", "observation_id"), "profile": ("profile", "profile_id"), "rollup": ("rollup_before", "proposition_id")}


@query(f"""shown as (select proposition_id, entity_id from proposition where entity_id in (select entity_id from entity where {_SHOWN}))
=> select 'proposition' as tab, count(*) as rows_shown, sum(('0x' || substr(md5(proposition_id::varchar), 1, 8))::bigint)::bigint as keys from shown
union all select 'observation', count(*), sum(('0x' || substr(md5(observation_id), 1, 8))::bigint)::bigint from obs where proposition_id in (select proposition_id from shown)
union all select 'profile', count(*), sum(('0x' || substr(md5(proposition_id || '/' || profile_id), 1, 8))::bigint)::bigint from profile where proposition_id in (select proposition_id from shown)
union all select 'rollup', count(*), sum(('0x' || substr(md5(proposition_id::varchar), 1, 8))::bigint)::bigint from rollup_before where proposition_id in (select proposition_id from shown)
union all select 'assertion', count(*), sum(('0x' || substr(md5(entity_id || '/' || assertion_id), 1, 8))::bigint)::bigint from assertion where entity_id in (select entity_id from shown)""", "obs")
def visible_children(r: Register) -> DataFrame:
    """Rows of every child table that the public may see, by semi joins with the published keys; an order-free digest stands for the keys."""
    shown = r.table("proposition").join(r.table("entity").where(_SHOWN), "entity_id", "left_semi").select("proposition_id", "entity_id")
    parts = [
        ("proposition", shown, "proposition_id", F.col("proposition_id").cast("string")), ("observation", r.observations, "proposition_id", F.col("observation_id")),
        ("profile", r.table("profile"), "proposition_id", F.concat_ws("/", "proposition_id", "profile_id")), ("rollup", r.table("rollup_before"), "proposition_id", F.col("proposition_id").cast("string")),
        ("assertion", r.table("assertion"), "entity_id", F.concat_ws("/", "entity_id", "assertion_id")),
    ]
    out = None
    for tab, frame, key, name in parts:
        seen = frame.join(shown.select(key).distinct(), key, "left_semi").select(name.alias("k"))
        one = seen.agg(F.count("*").alias("rows_shown"), exprs.key_digest(F.col("k")).alias("keys")).select(F.lit(tab).alias("tab"), "rows_shown", "keys")
        out = one if out is None else out.unionByName(one)
    return out


_SORT_KEYS = {"exist": "grade", "propositions": "n"}


@query(f"""ex as (select entity_id, arg_min(grade, proposition_id) as g from graded where class = 'EXIST' group by 1), n as (select entity_id, count(*) as n, max(created_on) as last from graded group by 1)
=> select entity_id, row_number() over (order by case when g is null then 3 when g = 'R' then 1 when g = 'X' then 2 else 0 end, {_RANK.format('g')} desc nulls last, entity_id) as by_grade, row_number() over (order by n desc, entity_id) as by_count, row_number() over (order by last desc nulls last, entity_id) as by_date,
row_number() over (order by name, entity_id) as by_name, row_number() over (order by country, entity_id) as by_country, row_number() over (order by list_position(['surveyed', 'approximate_1km', 'approximate_10km', 'regional', 'admin_area', 'claimed_only', 'place_name_only', 'non_located'], loc_precision), entity_id) as by_precision
from entity join n using (entity_id) left join ex using (entity_id) qualify by_grade <= 50 or by_count <= 50""", "graded")
def register_sorts(r: Register) -> DataFrame:
    """Places in six orders of the register, ties by id; rows on the first page of fifty of two of them (the limit is the page)."""
    g = r.graded
    exist = g.where("class = 'EXIST'").groupBy("entity_id").agg(F.min_by("grade", "proposition_id").alias("g"))
    n = g.groupBy("entity_id").agg(F.count("*").alias("n"), F.max("created_on").alias("last"))
    e = r.table("entity").join(n, "entity_id").join(exist, "entity_id", "left")
    group = F.when(F.col("g").isNull(), 3).when(F.col("g") == "R", 1).when(F.col("g") == "X", 2).otherwise(0)
    precision = F.array_position(F.array(*(F.lit(p) for p in geo.PRECISIONS)), F.col("loc_precision"))
    orders = {
        "by_grade": [group, exprs.grade_rank(F.col("g")).desc_nulls_last()], "by_count": [F.desc("n")], "by_date": [F.col("last").desc_nulls_last()], "by_name": [F.col("name")], "by_country": [F.col("country")], "by_precision": [precision],
    }
    return geo.ranked(e, orders, "entity_id").where("by_grade <= 50 or by_count <= 50").select("entity_id", *orders)


@query("=> select proposition_id, document_id, row_number() over (partition by proposition_id order by document_date nulls last, document_id) as place from (select distinct o.proposition_id, o.document_id, d.document_date from obs o join document d using (document_id) where membership = 'V') t", "obs")
def claim_chronology(r: Register) -> DataFrame:
    """Documents of a claim by date, undated ones last."""
    o = r.observations.where("membership = 'V' and document_id is not null").select("proposition_id", "document_id").distinct().join(r.table("document").select("document_id", "document_date"), "document_id")
    w = Window.partitionBy("proposition_id").orderBy(F.col("document_date").asc_nulls_last(), "document_id")
    return o.select("proposition_id", "document_id", F.row_number().over(w).alias("place"))


@query(f"=> select entity_id, proposition_id, row_number() over (partition by entity_id order by list_position(string_split('{_CLASS_ORDER}', ','), class), proposition_id) as place from proposition")
def class_order(r: Register) -> DataFrame:
    place = F.array_position(F.array(*(F.lit(c) for c in _CLASS_ORDER.split(","))), F.col("class"))
    return r.table("proposition").select("entity_id", "proposition_id", F.row_number().over(Window.partitionBy("entity_id").orderBy(place, "proposition_id")).alias("place"))


@query("=> select proposition_id, observation_id, row_number() over (partition by proposition_id order by case membership when 'V' then 0 when 'U' then 1 when 'V0' then 2 else 3 end, magnitude desc, cast(regexp_extract(fact_key, '([0-9]+)', 1) as int) nulls last, observation_id) as place from obs", "obs")
def receipts_sorted(r: Register) -> DataFrame:
    """Receipts by membership, magnitude and the number in their key, read as a number."""
    member = F.when(F.col("membership") == "V", 0).when(F.col("membership") == "U", 1).when(F.col("membership") == "V0", 2).otherwise(3)
    number = F.regexp_extract("fact_key", "([0-9]+)", 1).try_cast("int")
    w = Window.partitionBy("proposition_id").orderBy(member, F.desc("magnitude"), number.asc_nulls_last(), "observation_id")
    return r.observations.select("proposition_id", "observation_id", F.row_number().over(w).alias("place"))


@query(f"=> select entity_id, lon_c, lat_c from entity where {_SHOWN} and lon_c between -9000 and 9000 order by entity_id limit 2000")
def viewport_limited(r: Register) -> DataFrame:
    """A viewport shows two thousand features at most, those of the smallest ids; the limit is the feature."""
    return geo.viewport(r.table("entity").where(_SHOWN), -9000, -9000, 9000, 9000).orderBy("entity_id").limit(2000).select("entity_id", "lon_c", "lat_c")


@query("""t as (select proposition_id, unnest(list_distinct(string_split(lower(title), ' '))) as word from (select distinct o.proposition_id, d.title from obs o join document d using (document_id) where membership = 'V') s), w as (select distinct lower(split_part(p_name, ' ', 1)) as word, p_brand from part)
=> select proposition_id, count(distinct p_brand) as brands from t join w using (word) group by 1""", "obs")
def array_membership(r: Register) -> DataFrame:
    """Claims joined to whatever is named in a list: the list is exploded, then an equi-join."""
    titles = r.observations.where("membership = 'V'").join(r.table("document").select("document_id", "title"), "document_id").select("proposition_id", "title").distinct()
    t = titles.select("proposition_id", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word"))
    w = r.driver("part").select(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("word"), "p_brand").distinct()
    return t.join(w, "word").groupBy("proposition_id").agg(F.count_distinct("p_brand").alias("brands"))


@query("=> select proposition_id, coalesce(p.reference_class, 'RC' || (p.entity_id % 8), 'RC6') as used_class, reading from proposition p left join base_rate b on b.reference_class = coalesce(p.reference_class, 'RC' || (p.entity_id % 8), 'RC6') and b.function_set = p.function_set and b.class = p.class")
def base_rate_readings(r: Register) -> DataFrame:
    """The reading for a claim's own reference class, else its entity's, else the common one."""
    p = r.table("proposition").withColumn("used_class", F.coalesce("reference_class", F.concat(F.lit("RC"), (F.col("entity_id") % 8).cast("string")), F.lit("RC6"))).drop("reference_class")
    return p.join(r.table("base_rate").withColumnRenamed("reference_class", "used_class"), ["used_class", "function_set", "class"], "left").select("proposition_id", "used_class", "reading")


@query("=> select class, string_agg(grade || '=' || n, ',' order by grade) as counts from (select class, grade, count(*) as n from graded group by 1, 2) t group by 1", "graded")
def grade_objects(r: Register) -> DataFrame:
    """Per class an object of grade to number, shown in the order of its keys."""
    n = r.graded.groupBy("class", "grade").agg(F.count("*").alias("n")).groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("grade", "n"))).alias("m"))
    pairs = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k).cast("string")))
    return n.select("class", F.array_join(pairs, ",").alias("counts"))


#: Precisions and the symbol they share.
_SYMBOLS = {"surveyed": "dot", "approximate_1km": "dot", "approximate_10km": "ring", "regional": "area", "admin_area": "area", "claimed_only": "ring"}


@query(f"=> select {_case('loc_precision', _SYMBOLS, chr(39) + 'none' + chr(39))} as symbol, count(*) as n from entity group by 1")
def legend_counts(r: Register) -> DataFrame:
    """Features by the symbol that shows them; precisions that share a symbol are counted together."""
    return r.table("entity").groupBy(exprs.choose(F.col("loc_precision"), _SYMBOLS, F.lit("none")).alias("symbol")).agg(F.count("*").alias("n"))


@query("=> select entity_id, assertion_id, n from (select entity_id, assertion_id, count(*) over (partition by entity_id) as n, row_number() over (partition by entity_id order by preferred desc, list_position(['surveyed', 'approximate_1km', 'approximate_10km', 'regional', 'admin_area', 'claimed_only', 'place_name_only', 'non_located'], loc_precision), assertion_id) as k from assertion where not superseded) t where k = 1")
def preferred_assertions(r: Register) -> DataFrame:
    """The location that is shown: preferred, then the most precise, then the first; n compete."""
    return geo.preferred(r.table("assertion")).select("entity_id", "assertion_id", "n")


@query("""back as (select citing, cited, exists (select 1 from citation b where b.citing = a.cited and b.cited = a.citing) as mutual from citation a) => select citing, cited, mutual, bool_or(mutual) over (partition by citing) as any_of_document, bool_or(mutual) over () as any_at_all from back""")
def mutual_citations(r: Register) -> DataFrame:
    """Edges that are answered, whether any edge of the document is, and whether any is at all (one row, joined)."""
    e = r.table("citation").select("citing", "cited")
    back = e.select(F.col("cited").alias("citing"), F.col("citing").alias("cited")).distinct().withColumn("hit", F.lit(True))
    m = e.join(back, ["citing", "cited"], "left").withColumn("mutual", F.coalesce("hit", F.lit(False))).drop("hit").withColumn("any_of_document", F.bool_or("mutual").over(Window.partitionBy("citing")))
    return m.crossJoin(F.broadcast(m.agg(F.bool_or("mutual").alias("any_at_all")))).select("citing", "cited", "mutual", "any_of_document", "any_at_all")


# ---- published projections


@query("=> select p.proposition_id, p.null_id, coalesce(n_v, 0) as n_v, a.n as shares_null from proposition p join (select null_id, count(*) as n from proposition group by 1) a using (null_id) left join (select proposition_id, count(*) filter (where membership = 'V') as n_v from obs group by 1) o on o.proposition_id = p.proposition_id where null_selected", "obs")
def alternatives(r: Register) -> DataFrame:
    """Selected alternatives of claims, with how many claims share each (four rows, so broadcast by size)."""
    p = r.table("proposition")
    n_v = r.observations.groupBy("proposition_id").agg(F.count_if(F.col("membership") == "V").alias("n_v"))
    shares = p.groupBy("null_id").agg(F.count("*").alias("shares_null"))
    return p.where("null_selected").join(shares, "null_id").join(n_v, "proposition_id", "left").select("proposition_id", "null_id", F.coalesce("n_v", F.lit(0)).alias("n_v"), "shares_null")


@query("=> select tier, channel, count(*) as documents, count(*) filter (where self_attesting) as self_attesting, count(*) filter (where echo) as echoes, count(*) filter (where causal in ('CROWD-EDITED', 'SELF-PUBLISHED')) as writable from document group by 1, 2")
def source_coverage(r: Register) -> DataFrame:
    """The catalogue of sources with its facets."""
    return r.table("document").groupBy("tier", "channel").agg(F.count("*").alias("documents"), F.count_if("self_attesting").alias("self_attesting"), F.count_if("echo").alias("echoes"), F.count_if(F.col("causal").isin("CROWD-EDITED", "SELF-PUBLISHED")).alias("writable"))


@query(f"""b as (select p.entity_id, '{{"proposition":' || p.proposition_id || ',"class":"' || p.class || '","rows":' || coalesce(n, 0) || '}}' as badge, p.proposition_id from proposition p left join (select proposition_id, count(*) as n from obs group by 1) o using (proposition_id))
=> select e.entity_id, '{{"name":"' || e.name || '","country":"' || e.country || '","badges":[' || string_agg(badge, ',' order by proposition_id) || ']}}' as detail from entity e join b using (entity_id) where {_SHOWN} group by e.entity_id, e.name, e.country""", "obs")
def entity_details(r: Register) -> DataFrame:
    """One JSON document an entity with its badges in the order of their ids."""
    n = r.observations.groupBy("proposition_id").agg(F.count("*").alias("n"))
    b = r.table("proposition").join(n, "proposition_id", "left").select("entity_id", F.struct("proposition_id", "class", F.coalesce("n", F.lit(0)).alias("rows")).alias("badge"))
    nested = b.groupBy("entity_id").agg(F.array_sort(F.collect_list("badge")).alias("badges")).join(r.table("entity").where(_SHOWN).select("entity_id", "name", "country"), "entity_id")
    badges = F.transform("badges", lambda x: F.struct(x["proposition_id"].alias("proposition"), x["class"].alias("class"), x["rows"].alias("rows")))
    return nested.select("entity_id", F.to_json(F.struct("name", "country", badges.alias("badges"))).alias("detail"))


@query("=> select proposition_id, l_d3 as filled, l_d2 - l_d3 as open, (place_weight + claim_weight) as weight, concat_ws(',', case when citogenesis then 'citogenesis' end, case when mirror_d3 then 'mirror' end, case when unrebutted_d3 then 'undercut' end, case when destroyed then 'destroyed' end, case when t1_place then 'surveyed' end) as flags from wide", "wide")
def pips(r: Register) -> DataFrame:
    """Filled and open pips, weight and the five flag slots of a proposition."""
    flags = {"citogenesis": "citogenesis", "mirror_d3": "mirror", "unrebutted_d3": "undercut", "destroyed": "destroyed", "t1_place": "surveyed"}
    return r.wide.select("proposition_id", F.col("l_d3").alias("filled"), (F.col("l_d2") - F.col("l_d3")).alias("open"), (F.col("place_weight") + F.col("claim_weight")).alias("weight"), F.concat_ws(",", *(F.when(F.col(c), F.lit(t)) for c, t in flags.items())).alias("flags"))


@query("=> select observation_id, resolvable, held, lineage_of, direct and lawful and georeferenced and resolvable and held and membership = 'V' as counts from attested", "counts")
def attested_rows(r: Register) -> DataFrame:
    a = evidence.attestations(r.observations, r.table("witness"))
    return a.select("observation_id", "resolvable", "held", "lineage_of", (F.col("direct") & F.col("lawful") & F.col("georeferenced") & F.col("resolvable") & F.col("held") & (F.col("membership") == "V")).alias("counts"))


@query("=> select proposition_id, n_direct, t1_place from wide where n_direct > 0", "wide")
def direct_path(r: Register) -> DataFrame:
    """What the second way to the best band rests on: direct witnesses and a surveyed place."""
    return r.wide.where("n_direct > 0").select("proposition_id", "n_direct", "t1_place")


@query("=> select grade, unnest(['" + "', '".join(vocab.CAUSES) + "']) as cause from (values " + ", ".join(f"('{g}')" for g in "ABCDEFRX") + ") t(grade) where exists (select 1 from grade_event)")
def seeded_transitions(r: Register) -> DataFrame:
    """A curated seed: every grade with every cause, from the vocabularies, where there are events at all."""
    grades = r.table("grade_event").limit(1).select(F.explode(F.array(*(F.lit(g) for g in "ABCDEFRX"))).alias("grade"))
    return grades.select("grade", F.explode(F.array(*(F.lit(c) for c in vocab.CAUSES))).alias("cause"))
