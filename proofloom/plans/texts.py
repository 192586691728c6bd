"""Queries on documents, pages, conversations and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.exprs import norm_token
from ..operators import graph, text
from ..sources import loading
from ..streaming import windows
from .register import Register
from .registry import query

_NORM = f"nullif(trim(regexp_replace(lower(translate({{}}, '{vocab.FOLD_FROM}', '{vocab.FOLD_TO}')), '[^a-z0-9]+', ' ', 'g')), '')"


@query("=> select sha256(text) as content, min(doc_id) as first_doc, count(*) as copies from documents where text is not null group by 1 having count(*) > 1")
def exact_duplicates(r: Register) -> DataFrame:
    return text.exact_duplicates(r.driver("documents"))


@query(f"=> select doc_id, md5({_NORM.format('text')}) as norm_hash from documents")
def normalised_text(r: Register) -> DataFrame:
    return r.driver("documents").select("doc_id", F.md5(norm_token(F.col("text"))).alias("norm_hash"))


@query(f"""d as (select doc_id, {_NORM.format('text')} as body from documents), b as (select item_id, {_NORM.format('text')} as span from benchmark),
m as (select doc_id, item_id, span, string_split(body, span) as parts from d join b on strpos(' ' || body || ' ', ' ' || array_to_string(string_split(span, ' ')[1:5], ' ') || ' ') > 0 and strpos(body, span) > 0)
=> select doc_id, item_id, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(span) + 1)::int as at from m, lateral (select unnest(range(1, len(parts))) as k) s""")
def benchmark_spans(r: Register) -> DataFrame:
    return text.locate_spans(r.driver("documents"), r.driver("benchmark"))


@query("""firsts as (select min(doc_id) as doc_id, any_value(text) as text from documents where text is not null group by sha256(text)), f as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '(\\d{3,})', 1))) as fact from firsts),
n as (select fact, count(*) as n, min(doc_id) as first_doc from f group by 1), e as (select distinct f.doc_id as x, first_doc as y from f join n using (fact) where n between 2 and greatest(2, (select count(*) from documents) // 20) and f.doc_id <> first_doc),
both_e as (select x, y from e union select y, x from e), rc(x, y) as (select distinct x, x from both_e union select rc.x, b.y from rc join both_e b on rc.y = b.x)
=> select x as doc_id, min(y) as root from rc group by 1""")
def shared_facts(r: Register) -> DataFrame:
    """Documents of one lineage by the rare long numbers they share; a fact of more than a twentieth of all documents is no evidence."""
    return text.fact_lineages(r.driver("documents"), 20, graph.components)


@query("""n as (select min(p_partkey) as id, coalesce(NORMNAME, '') as norm from (select p_partkey, p_name || ' ' || p_type as name from part) q group by 2), p as (select id, '  ' || norm || ' ' as s from n),
t as (select distinct id, substr(s, i::bigint, 3) as gram from p, range(1, 400) r(i) where i <= length(s) - 2), c as (select id, count(*) as n from t group by 1),
j as (select x.id as a, y.id as b, count(*) as common from t x join t y on x.gram = y.gram and x.id < y.id group by 1, 2)
=> select a, b, common from j join c ca on ca.id = a join c cb on cb.id = b where common * 100 >= 60 * (ca.n + cb.n - common)""".replace("NORMNAME", _NORM.format("name")))
def similar_names(r: Register) -> DataFrame:
    """Pairs of different names, each named by the least part that has it."""
    return text.similar_names(text.name_classes(_names(r)), 60)


def _names(r: Register) -> DataFrame:
    return r.driver("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))


@query("""n as (select p_partkey as id, coalesce(NORMNAME, '') as norm from (select p_partkey, p_name || ' ' || p_type as name from part) q) => select id, min(id) over (partition by norm) as class from n""".replace("NORMNAME", _NORM.format("name")))
def name_membership(r: Register) -> DataFrame:
    """Which class of equal names each part is in."""
    return text.name_classes(_names(r)).select("id", "class")


@query("=> select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host from pages")
def page_hosts(r: Register) -> DataFrame:
    return r.driver("pages").select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"))


@query("=> select conv_id, count(*) as turns, count(distinct role) as roles, sum(length(text))::bigint as chars, arg_min(role, turn) as opens from conversations group by 1")
def conversation_summary(r: Register) -> DataFrame:
    return r.driver("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"), F.min_by("role", "turn").alias("opens"))


@query("=> select d.lang, d.source, count(*) as docs, count(l.doc_id) as reviewed, coalesce(sum(l.quality), 0)::bigint as good, coalesce(sum(l.toxic), 0)::bigint as toxic from documents d left join labels l using (doc_id) group by 1, 2")
def source_review(r: Register) -> DataFrame:
    labels = r.driver("labels").withColumn("hit", F.lit(1))
    d = r.driver("documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    return d.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.count("hit").alias("reviewed"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


@query("=> select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def part_slugs(r: Register) -> DataFrame:
    return r.driver("part").select("p_partkey", loading.slug(F.col("p_name")).alias("slug"))


@query("=> select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from events group by 1, 2")
def streamed_daily_counts(r: Register) -> DataFrame:
    return windows.daily_counts(r.spark, r.sf_dir)


@query("=> select user_id, arg_max(event_type, event_id) as last_type, max(event_id) as last_event, count(*) as events from events group by 1")
def streamed_latest_state(r: Register) -> DataFrame:
    return windows.latest_state(r.spark, r.sf_dir)


@query("=> select membership, count(*) as n, sum(signed_weight)::bigint as weight from obs group by 1", "obs")
def streamed_membership(r: Register) -> DataFrame:
    from ..streaming import register as streams

    return streams.membership(r.spark, r.sf_dir).groupBy("membership").agg(F.count("*").alias("n"), F.sum("signed_weight").alias("weight"))


@query("=> select a.user_id, a.event_id as lead_id, b.event_id as receipt_id from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour")
def streamed_leads_with_receipts(r: Register) -> DataFrame:
    from ..streaming import register as streams

    return streams.leads_with_receipts(r.spark, r.sf_dir, "view", "purchase")
