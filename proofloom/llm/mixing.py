"""Operator 8, mixing sources to target weights with DataFrame functions alone.

Documents hang in a tree of domain, language and source. A token budget goes down the tree by the
children's weights; a child takes at most what it has (its tokens times max_epochs), and what it
cannot take goes to its siblings before it goes back to an ancestor: since a node's own limit is the
sum of its children's, what a node is given its children can always take. Each leaf then takes
whole seeded epochs and a token-prefix of one more: in epoch e documents stand in the order of
md5(seed|e|doc_id), ties by doc_id, and a document is taken when the prefix reaches into it.

Shares are whole tokens: what rounding leaves over goes to the children with the largest
remainders, ties by name. Null domain, language or source is the leaf part `unknown`; null and empty
texts have no tokens and are never taken; a document repeated in the table counts each time; an
empty table gives no rows; weights must be positive. Other columns are ignored by the plan and kept by
`mix`. A hot leaf is never in one task: prefix sums go over md5 bins first and only the bin in
which the budget ends is ordered document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEED = 17
MAX_EPOCHS = 2
#: Part of all tokens that is asked for, in percent.
BUDGET_PERCENT = 60
#: Hexadecimal digits of md5 that name a bin.
BIN_DIGITS = 3
#: Target weights of languages and domains in the query; others weigh 1.
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
DOMAIN_WEIGHTS = {"d0": 3, "d1": 2, "d2": 2, "d3": 1}


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4, `unknown` without a number."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string"))).otherwise("unknown")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = None
    for k, v in weights.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    return F.lit(1) if out is None else out.otherwise(1)


def share(nodes: DataFrame, parent: list[str], name: str, given: str, limit: str, weight: str, out: str) -> DataFrame:
    """Shares `given` (the same in all rows of a parent) among its children by weight, each up to its limit: filling to a level.

    Children are ordered by limit per weight; those that would take less than the level take their
    limit, the others the level times their weight. All sums are exact decimals.
    """
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    up = Window.partitionBy(*parent).orderBy("__ratio", name)
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("__ratio", F.col(limit) / F.col(weight))
    n = n.withColumn("__full", F.coalesce(F.sum(limit).over(before), F.lit(0))).withColumn("__rest", F.sum(weight).over(after))
    # full if limit / weight <= (given - what fuller ones take) / weights that are left
    n = n.withColumn("__isfull", dec(limit) * dec("__rest") <= (dec(given) - dec("__full")) * dec(weight))
    # children after the first that is not full are not full either
    n = n.withColumn("__isfull", F.min(F.col("__isfull").cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    whole = Window.partitionBy(*parent)
    n = n.withColumn("__pool", F.greatest(F.lit(0), F.col(given) - F.coalesce(F.sum(F.when(F.col("__isfull"), F.col(limit))).over(whole), F.lit(0)))).withColumn("__weights", F.coalesce(F.sum(F.when(~F.col("__isfull"), F.col(weight))).over(whole), F.lit(0)))
    exact = dec("__pool") * dec(weight)
    n = n.withColumn("__floor", F.when(F.col("__isfull"), F.col(limit)).otherwise(F.expr(f"cast(div(cast(__pool as decimal(38,0)) * {weight}, __weights) as bigint)")))
    n = n.withColumn("__over", F.when(~F.col("__isfull"), (exact % dec("__weights"))).otherwise(F.lit(-1).cast("decimal(38,0)")))
    n = n.withColumn("__left", F.col("__pool") - F.sum(F.when(F.col("__isfull"), F.lit(0)).otherwise(F.col("__floor"))).over(whole))
    n = n.withColumn("__rank", F.row_number().over(Window.partitionBy(*parent).orderBy(F.col("__over").desc(), name)))
    n = n.withColumn(out, F.col("__floor") + F.when(~F.col("__isfull") & (F.col("__rank") <= F.col("__left")), 1).otherwise(0))
    return n.drop("__ratio", "__full", "__rest", "__isfull", "__pool", "__weights", "__floor", "__over", "__left", "__rank")


def budgets(leaves: DataFrame, budget: Column, max_epochs: int, language_weights: dict[str, int], domain_weights: dict[str, int], source_weights: dict[str, int]) -> DataFrame:
    """leaves (domain, lang, source, tokens) with each leaf's budget; budget is an expression over total (all tokens)."""
    n = leaves.withColumn("leaf_limit", F.col("tokens") * max_epochs)
    by_lang = n.groupBy("domain", "lang").agg(F.sum("leaf_limit").alias("lang_limit"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("lang_limit").alias("domain_limit"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    top = by_domain.crossJoin(F.broadcast(total)).withColumn("given", F.least(budget, F.col("total") * max_epochs)).withColumn("root", F.lit(0)).withColumn("w", weight_of(F.col("domain"), domain_weights))
    top = share(top, ["root"], "domain", "given", "domain_limit", "w", "domain_budget").select("domain", "domain_budget")
    mid = by_lang.join(top, "domain").withColumn("w", weight_of(F.col("lang"), language_weights))
    mid = share(mid, ["domain"], "lang", "domain_budget", "lang_limit", "w", "lang_budget").select("domain", "lang", "lang_budget")
    low = n.join(mid, ["domain", "lang"]).withColumn("w", weight_of(F.col("source"), source_weights))
    return share(low, ["domain", "lang"], "source", "lang_budget", "leaf_limit", "w", "leaf_budget").select("domain", "lang", "source", "tokens", "leaf_budget")


def n_tokens(text: Column) -> Column:
    """Words of a text: runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def plan(
    docs: DataFrame,
    budget: Column | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    language_weights: dict[str, int] | None = None,
    domain_weights: dict[str, int] | None = None,
    source_weights: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Documents that are taken: doc_id, domain, lang, source, tokens, epochs (whole passes), prefix_tokens (of one more pass) and taken_tokens."""
    budget = F.floor(F.col("total") * BUDGET_PERCENT / 100).cast("long") if budget is None else budget
    source = F.col(f"`{source_col}`")
    light = common.cut(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"), domain_of(source).alias("domain"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("unknown")).alias("lang"),
            F.coalesce(source, F.lit("unknown")).alias("source"), n_tokens(F.col(f"`{text_col}`")).alias("tokens"),
        ).where("tokens > 0"),
        "mixing",
    )
    leaf = ["domain", "lang", "source"]
    leaves = light.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    given = budgets(leaves, budget, max_epochs, language_weights or {}, domain_weights or {}, source_weights or {})
    given = given.withColumn("epochs", F.expr("div(leaf_budget, tokens)")).withColumn("prefix", F.col("leaf_budget") % F.col("tokens")).drop("tokens")
    given = common.cut(given, "budgets")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = light.join(given, leaf).withColumn("place", order).withColumn("bin", F.substring("place", 1, BIN_DIGITS))
    bins = placed.groupBy(*leaf, "bin").agg(F.sum("tokens").alias("bin_tokens"))
    running = Window.partitionBy(*leaf).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_tokens").over(running), F.lit(0)))
    placed = placed.join(bins, [*leaf, "bin"])
    inside = (F.col("bin_start") < F.col("prefix")) & (F.col("bin_start") + F.col("bin_tokens") > F.col("prefix"))
    clear = placed.where(~inside).withColumn("prefix_tokens", F.when(F.col("bin_start") < F.col("prefix"), F.col("tokens")).otherwise(F.lit(0)))
    within = Window.partitionBy(*leaf, "bin").orderBy("place", F.asc_nulls_first("doc_id"), "tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(inside).withColumn("start", F.col("bin_start") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    edge = edge.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("prefix") - F.col("start")))).drop("start")
    out = clear.unionByName(edge).withColumn("taken_tokens", F.col("epochs") * F.col("tokens") + F.col("prefix_tokens"))
    return out.where("taken_tokens > 0").select("doc_id", *leaf, "tokens", "epochs", "prefix_tokens", "taken_tokens")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with whole passes and the tokens of one more."""
    return plan(common.read(spark, sf_dir, "documents"), language_weights=LANGUAGE_WEIGHTS, domain_weights=DOMAIN_WEIGHTS)


def _level(parent: str, name: str, given: str, limit: str, weight: str, source: str) -> str:
    """DuckDB: the same filling as `share`, written as the largest level at which all fits."""
    return f"""
    select *, given_floor + case when not is_full and row_number() over (partition by {parent} order by over_ desc, {name}) <= pool - floors then 1 else 0 end as got from (
    select *, sum(case when is_full then 0 else given_floor end) over (partition by {parent}) as floors from (
    select *, case when is_full then {limit} else (pool * {weight}) // weights end as given_floor, case when is_full then -1 else (pool * {weight}) % weights end as over_ from (
    select *, greatest(0, {given} - coalesce(sum(case when is_full then {limit} end) over (partition by {parent}), 0)) as pool, coalesce(sum(case when not is_full then {weight} end) over (partition by {parent}), 0) as weights from (
    select *, min(case when fits then 1 else 0 end) over (partition by {parent} order by {limit}::double / {weight}, {name} rows unbounded preceding) = 1 as is_full from (
    select *, {limit}::hugeint * sum({weight}) over (partition by {parent} order by {limit}::double / {weight}, {name} rows between current row and unbounded following)
      <= ({given} - coalesce(sum({limit}) over (partition by {parent} order by {limit}::double / {weight}, {name} rows between unbounded preceding and 1 preceding), 0))::hugeint * {weight} as fits
    from {source})))))"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


OP8_SQL = f"""
with light as (
  select doc_id, case when regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' then 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4) else 'unknown' end as domain,
    coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source, len(regexp_extract_all(text, '\\S+'))::bigint as tokens
  from documents where len(regexp_extract_all(text, '\\S+')) > 0),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, (sum(tokens) * {MAX_EPOCHS})::bigint as lim from light group by all),
langs as (select domain, lang, sum(lim)::bigint as lim, {_case('lang', LANGUAGE_WEIGHTS)} as w from leaves group by domain, lang),
domains as (select domain, sum(lim)::bigint as lim, {_case('domain', DOMAIN_WEIGHTS)} as w, 0 as root, (select (sum(tokens) * {BUDGET_PERCENT})::bigint // 100 from leaves) as given from langs group by domain),
t as ({_level('root', 'domain', 'given', 'lim', 'w', 'domains')}),
m as ({_level('domain', 'lang', 'given', 'lim', 'w', '(select l.*, t.got as given from langs l join t using (domain))')}),
b as ({_level('domain, lang', 'source', 'given', 'lim', 'w', '(select l.*, 1 as w, m.got as given from leaves l join m using (domain, lang))')}),
placed as (select light.*, got // b.tokens as epochs, got % b.tokens as prefix, sum(light.tokens) over (partition by domain, lang, source order by md5('{SEED}|' || (got // b.tokens)::bigint || '|' || doc_id), doc_id, light.tokens rows unbounded preceding) - light.tokens as start
  from light join b using (domain, lang, source))
select doc_id, domain, lang, source, tokens, epochs::bigint as epochs, greatest(0, least(tokens, prefix - start))::bigint as prefix_tokens, (epochs * tokens + greatest(0, least(tokens, prefix - start)))::bigint as taken_tokens
from placed where epochs * tokens + greatest(0, least(tokens, prefix - start)) > 0"""
