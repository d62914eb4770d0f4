"""Joins, overlays and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.aggregates import STAGES_SQL, stages
from sievework.catalog.base import query
from sievework.catalog.fields import F02_SQL, named
from sievework.catalog.web import norm_cte
from sievework.functions.fields import basic_clean_name
from sievework.operators import joins


@query(
    "j01_hits_with_pages",
    f"""with {norm_cte()}, n as (select page_id, url_norm from norm)
    select h.page_id % 9 as query_id, h.page_id as rank, h.url_norm, p.page_id from n h
    join (select url_norm, min(page_id) as page_id from n group by 1) p using (url_norm)""",
)
def j01(t):
    """Hits carry upper-case hosts and a tracking parameter; they still find their page."""
    pages = t("pages").select("page_id", "url")
    marked = F.when(F.col("url").contains("?"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("&gclid=7"))).otherwise(
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("?gclid=7#x"))
    )
    hits = pages.select((F.col("page_id") % 9).alias("query_id"), F.col("page_id").alias("rank"), marked.alias("url"))
    return joins.hits_with_pages(hits, pages, order="page_id").select("query_id", "rank", "url_norm", "page_id")


@query(
    "j02_left_anti_new",
    "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
)
def j02(t):
    known = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.only_new(t("customer"), known, F.col("c_custkey"), F.col("c_custkey")).select("c_custkey", "c_name")


@query(
    "j03_with_cache",
    """select c_custkey, case when c_custkey % 3 = 0 then 'cached' else concat('new ', c_name) end as result from customer""",
)
def j03(t):
    items = t("customer").select("c_custkey", "c_name")
    cache = items.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("cached").alias("result"))
    return joins.with_cache(items, cache, ["c_custkey"], lambda d: d.select("c_custkey", F.concat(F.lit("new "), "c_name").alias("result")))


@query(
    "j04_overlay",
    """with c as (select o_custkey, arg_max(o_orderpriority, o_orderkey) as seg from orders group by 1)
    select c_custkey, coalesce(seg, c_mktsegment) as c_mktsegment, c_name from customer left join c on c_custkey = o_custkey""",
)
def j04(t):
    changed = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return joins.overlay(t("customer").select("c_custkey", "c_mktsegment", "c_name"), changed, "c_custkey", "o_orderkey", ["c_mktsegment"])


@query(
    "j05_overlay_by_index",
    """with r as (select s_suppkey as i, case when (s_suppkey // 5) % 4 = 3 then s_name when s_suppkey % 7 = 0 then '' else concat('ok ', s_name) end as value from supplier),
    x as (select distinct s_suppkey // 5 as chunk from supplier)
    select i as s_suppkey, value from r where value <> '' union all select -1, concat('extra ', chunk) from x where chunk % 4 <> 3""",
)
def j05(t):
    rows = t("supplier").select("s_suppkey", "s_name", F.floor(F.col("s_suppkey") / 5).alias("chunk"))
    fixed = F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit("ok "), "s_name"))
    listed = F.array_sort(F.collect_list(F.struct("s_suppkey", fixed.alias("v"))))
    chunks = rows.groupBy("chunk").agg(listed.alias("m")).select(
        "chunk",
        (F.col("chunk") % 4 != 3).alias("ok"),
        F.transform("m", lambda x: x["s_suppkey"]).alias("indices"),
        F.concat(F.transform("m", lambda x: x["v"]), F.array(F.concat(F.lit("extra "), F.col("chunk").cast("string")))).alias("values"),
    )
    original = rows.select("s_suppkey", F.col("s_name").alias("value"))
    return joins.overlay_by_index(original, "s_suppkey", chunks, "value").fillna(-1, ["s_suppkey"])


@query(
    "j06_stage_membership",
    f"""with f as (select name, bool_or(stage = 'Potential') as p, bool_or(stage = 'LLM Extracted') as l, bool_or(stage = 'Validated') as v, bool_or(stage = 'Final') as f from {STAGES_SQL} group by 1)
    select name, if(p, 'Yes', 'No') as potential, if(l, 'Yes', 'No') as llm_extracted, if(v, 'Yes', 'No') as validated, if(p and not f, 'Yes', 'No') as eliminated, if(f, 'Yes', 'No') as final from f""",
)
def j06(t):
    return joins.stage_membership(stages(t))


@query(
    "j07_names_with_reports",
    f"""with d as (select name, count(*) as total, strftime(min(ts), '%Y-%m-%d') as a, strftime(max(ts), '%Y-%m-%d') as b from {STAGES_SQL} group by 1)
    select distinct s.name, s.stage as url, 'No specific context found' as context, 'No keyword data available' as keywords,
      concat('Total mentions: ', total, ', First mention: ', a, ', Last mention: ', b) as trend from {STAGES_SQL} s join d using (name)""",
)
def j07(t):
    from sievework.operators import reports

    s = stages(t)
    none = s.select("name", F.col("stage").alias("url"), F.lit(None).cast("string").alias("context")).filter("false")
    words = s.select("name", F.lit("x").alias("top_keywords")).filter("false")
    return reports.context_report(s.select("name", F.col("stage").alias("url")), none, words, reports.mention_trends(s))


@query(
    "j08_rows_of_names",
    f"""with n as (select c_custkey, c_acctbal, {F02_SQL} as k from customer), d as (select distinct k from n)
    select k as canonical, arg_min(c_custkey, c_custkey) as c_custkey, arg_min(c_acctbal, c_custkey) as c_acctbal from n group by 1""",
)
def j08(t):
    rows = named(t).select("c_custkey", "c_acctbal", "name")
    canonical = rows.select(basic_clean_name(F.col("name")).alias("canonical")).distinct()
    out = joins.rows_of_names(canonical, rows, F.col("canonical"), basic_clean_name(F.col("name")), "c_custkey")
    return out.select("canonical", "c_custkey", "c_acctbal")


@query(
    "j13_name_in_url",
    "select page_id, url from pages where contains(lower(url), lower(split_part(split_part(url, '//', 2), '.', 2)))",
)
def j13(t):
    pages = t("pages").select("page_id", "url", F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("."), F.lit(2)).alias("name"))
    return joins.name_in_url(pages, "name", "url").select("page_id", "url")


@query(
    "x01_union_by_key_set",
    """select s_name as name, 'supplier' as kind, s_acctbal as balance, '' as segment from supplier
    union all select c_name, 'customer', c_acctbal, c_mktsegment from customer""",
)
def x01(t):
    a = t("supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    b = t("customer").select(F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return joins.union_by_key_set([a, b], "name").fillna("", ["segment"])


@query(
    "x02_difference",
    f"select distinct name from {STAGES_SQL} where stage = 'Potential' except select name from {STAGES_SQL} where stage = 'Final'",
)
def x02(t):
    s = stages(t)
    return s.filter("stage = 'Potential'").select("name").subtract(s.filter("stage = 'Final'").select("name"))


@query(
    "x03_intersection",
    f"select name from {STAGES_SQL} where stage = 'Validated' intersect select name from {STAGES_SQL} where stage = 'Final'",
)
def x03(t):
    s = stages(t)
    return s.filter("stage = 'Validated'").select("name").intersect(s.filter("stage = 'Final'").select("name"))


@query("x04_concatenation", "select o_orderkey as key from orders union all select l_orderkey from lineitem")
def x04(t):
    return t("orders").select(F.col("o_orderkey").alias("key")).unionAll(t("lineitem").select("l_orderkey"))
