"""Queries on ranges: when claims of an entity were open, and which anchors an identifier's date must lie between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranges, vocab
from .register import Register
from .registry import query

_OPEN = "select o_custkey as entity_id, cast(o_orderdate as date) as lo, case when o_orderkey % 50 <> 7 then cast(o_orderdate as date) + cast(o_orderkey % 120 - 5 as int) end as hi from {}"


def _open(r: Register) -> DataFrame:
    return r.spark.sql(_OPEN.format("{orders}"), orders=r.driver("orders"))


@query(f"o as ({_OPEN.format('orders')}) => select entity_id, count(*) as claims, count(*) filter (where lo >= hi) as empty, count(*) filter (where lo <= date '1995-06-17' and coalesce(hi > date '1995-06-17', true)) as open_then, count(*) filter (where hi is null) as open_ended from o group by 1")
def open_claims(r: Register) -> DataFrame:
    """How many claims of an entity have an empty range, are open on a day, and never end."""
    lo, hi, day = F.col("lo"), F.col("hi"), F.lit("1995-06-17").cast("date")
    return _open(r).groupBy("entity_id").agg(F.count("*").alias("claims"), F.count_if(ranges.is_empty(lo, hi)).alias("empty"), F.count_if(ranges.contains(lo, hi, day)).alias("open_then"), F.count_if(hi.isNull()).alias("open_ended"))


@query(f"""o as ({_OPEN.format('orders')}), f as (select *, coalesce(hi, date '9999-12-31') as till, row_number() over (partition by entity_id order by lo, coalesce(hi, date '9999-12-31')) as k from o where hi is null or lo < hi),
b as (select *, case when lo > max(till) over (partition by entity_id order by k rows between unbounded preceding and 1 preceding) or k = 1 then 1 else 0 end as begins from f), i as (select *, sum(begins) over (partition by entity_id order by k) as island from b)
=> select entity_id, min(lo)::varchar as lo, nullif(max(till), date '9999-12-31')::varchar as hi, count(*) as parts from i group by entity_id, island""")
def activity_islands(r: Register) -> DataFrame:
    """An entity's stretches of activity: ranges of its claims that overlap or touch, melted."""
    found = ranges.islands(_open(r), ["entity_id"])
    return found.select("entity_id", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"), "parts")


_ANCHORS = "anchor as (select document_id - document_id % 50 as series, min(document_date) as lo, max(document_date) + 1 as hi from document where document_date is not null and document_id % 5 = 0 group by 1)"


@query(_ANCHORS + "=> select document_id, d.document_date::varchar as dated, lo::varchar as lo, hi::varchar as hi from document d join anchor on series = document_id - document_id % 50 where document_id % 5 <> 0 and d.document_date is not null and not (d.document_date >= lo and d.document_date < hi)")
def dates_off_anchors(r: Register) -> DataFrame:
    """Documents whose date lies outside the range that the dated anchors of their series leave."""
    d = r.table("document").where("document_date is not null").withColumn("series", F.col("document_id") - F.col("document_id") % 50)
    anchors = d.where("document_id % 5 = 0").groupBy("series").agg(F.min("document_date").alias("lo"), F.date_add(F.max("document_date"), 1).alias("hi"))
    off = d.where("document_id % 5 <> 0").join(anchors, "series").where(~ranges.contains(F.col("lo"), F.col("hi"), F.col("document_date")))
    return off.select("document_id", F.col("document_date").cast("string").alias("dated"), F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


@query("""pair as (select a.entity_id, a.proposition_id as a, b.proposition_id as b, greatest(a.lo, b.lo) as lo, least(coalesce(a.hi, date '9999-12-31'), coalesce(b.hi, date '9999-12-31')) as hi from w a join w b on a.entity_id = b.entity_id and a.class = b.class and a.proposition_id < b.proposition_id where a.lo < coalesce(b.hi, date '9999-12-31') and b.lo < coalesce(a.hi, date '9999-12-31'))
=> select a, b, lo::varchar as lo, nullif(hi, date '9999-12-31')::varchar as hi from pair""".replace("pair as", "w as (select p.entity_id, class, p.proposition_id, created_on as lo, graded_on as hi from proposition p left join rollup_before using (proposition_id) where graded_on is null or created_on < graded_on), pair as"))
def overlapping_claims(r: Register) -> DataFrame:
    """Claims of one class about one entity that were ungraded at the same time, with the time they share; an entity has few claims."""
    p = r.table("proposition").join(r.table("rollup_before").select("proposition_id", "graded_on"), "proposition_id", "left")
    w = p.select("entity_id", "class", F.col("proposition_id").alias("a"), F.col("created_on").alias("a_lo"), F.col("graded_on").alias("a_hi"))
    v = w.select("entity_id", "class", *(F.col(f"a{s}").alias(f"b{s}") for s in ("", "_lo", "_hi")))
    both = w.join(v, ["entity_id", "class"]).where(F.col("a") < F.col("b")).where(ranges.overlaps(*(F.col(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi"))))
    lo, hi = ranges.shared(*(F.col(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi")))
    return both.select("a", "b", lo.cast("string").alias("lo"), hi.cast("string").alias("hi"))


_CLASSES = ["EXIST", "EXTENT", "LOCATE", "FEATURE", "TYPOLOGY", "FUNCTION", "STATUS", "CONTROL", "IDENTITY", "HARDEN", "PROGRAM", "ORIGIN", "EVENT"]
_VOCABULARIES = {"class": _CLASSES, "grade": [*vocab.RANKED, "R", "X"], "cause": vocab.CAUSES}
_VALUES = ", ".join(f"('{name}', '{value}', {k})" for name, values in _VOCABULARIES.items() for k, value in enumerate(values, 1))


@query(f"""v(vocabulary, value, place) as (values {_VALUES}), used as (select 'class' as vocabulary, class as value from proposition union all select 'grade', grade from grade_event union all select 'cause', cause from grade_event), n as (select vocabulary, value, count(*) as n from used group by 1, 2)
=> select vocabulary, value, place, coalesce(n, 0) as used from v left join n using (vocabulary, value) union all select vocabulary, value, null, n from n where (vocabulary, value) not in (select vocabulary, value from v)""")
def vocabulary_values(r: Register) -> DataFrame:
    """Every value of the closed vocabularies in its order with how often it is used; values that none of them has come without a place."""
    known = r.spark.sql(f"select * from values {_VALUES} as v(vocabulary, value, place)")
    events = r.table("grade_event")
    used = r.table("proposition").select(F.lit("class").alias("vocabulary"), F.col("class").alias("value"))
    for c in ("grade", "cause"):
        used = used.unionByName(events.select(F.lit(c).alias("vocabulary"), F.col(c).alias("value")))
    n = used.groupBy("vocabulary", "value").agg(F.count("*").alias("n"))
    return known.join(n, ["vocabulary", "value"], "full_outer").select("vocabulary", "value", "place", F.coalesce("n", F.lit(0)).alias("used"))
