"""Reports. Events stand for logs: the user is the name, the type the stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework import rules
from sievework.catalog.base import like_any, query
from sievework.operators import extract, joins, reports
from sievework.functions.text import clean_text

STAGE = "case event_type when 'view' then 'Potential' when 'click' then 'LLM Extracted' when 'signup' then 'Validated' when 'purchase' then 'Final' else 'Other' end"
STATUS = "case event_type when 'error' then 'failed' when 'signup' then 'blocked' else 'processed' end"


def stages(t):
    return t("events").select(F.concat(F.lit("U"), "user_id").alias("name"), F.expr(STAGE).alias("stage"), "ts", "event_id")


STAGES_SQL = f"(select concat('U', user_id) as name, {STAGE} as stage, ts, event_id from events)"


def url_log(t):
    return t("events").select(
        F.concat(F.lit("u"), (F.col("user_id") * 7 + F.col("event_id") % 5).cast("string")).alias("url"), F.expr(STATUS).alias("status"), "value", "ts"
    )


URL_LOG = f"(select concat('u', user_id * 7 + event_id % 5) as url, {STATUS} as status, value, ts from events)"


@query(
    "a01_url_metrics",
    f"""with s as (select count(distinct url) filter (status = 'processed') as processed, count(distinct url) filter (status = 'failed') as failed,
      count(distinct url) filter (status = 'blocked') as blocked from {URL_LOG})
    select *, round(processed / greatest(1, processed + failed) * 100, 6) as success_rate from s""",
)
def a01(t):
    return reports.url_metrics(url_log(t)).withColumn("success_rate", F.round("success_rate", 6))


@query("a02_funnel", f"select stage, count(distinct name) as names from {STAGES_SQL} group by 1")
def a02(t):
    return reports.funnel(stages(t))


@query(
    "a02_funnel_summary",
    f"""with f as (select name, max(cast(stage = 'Potential' as int)) as p, max(cast(stage = 'Final' as int)) as f from {STAGES_SQL} group by 1),
    s as (select sum(p) as potential, sum(f) as final, sum(case when p = 1 and f = 0 then 1 else 0 end) as eliminated from f)
    select *, round(final / greatest(1, potential) * 100, 6) as conversion_rate from s""",
)
def a02_summary(t):
    return reports.funnel_summary(stages(t)).withColumn("conversion_rate", F.round("conversion_rate", 6))


@query(
    "a03_extraction_success",
    """with s as (select event_type as source, count(*) as attempts, count(*) filter (value > 10) as successes, count(*) filter (event_id % 7 = 0) as fallbacks
      from events group by 1) select *, round(successes / greatest(1, attempts) * 100, 6) as success_rate from s""",
)
def a03(t):
    log = t("events").select(F.col("event_type").alias("source"), (F.col("value") > 10).alias("ok"), (F.col("event_id") % 7 == 0).alias("fb"))
    return reports.extraction_success(log, fallback="fb").withColumn("success_rate", F.round("success_rate", 6))


@query(
    "a04_field_completion",
    """with c as (select p_name, max(cast(p_partkey % 4 <> 0 as int)) as p_brand, max(cast(p_size % 2 = 0 as int)) as p_type, 1 as p_size from part group by 1)
    select unnest(['p_brand', 'p_type', 'p_size']) as field, unnest([sum(p_brand), sum(p_type), sum(p_size)]) as filled,
      unnest([round(sum(p_brand) / count(*) * 100, 6), round(sum(p_type) / count(*) * 100, 6), round(sum(p_size) / count(*) * 100, 6)]) as completion from c""",
)
def a04(t):
    part = t("part").select(
        "p_name",
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("  ").alias("p_type"),
        "p_size",
    )
    return reports.field_completion(part, "p_name", ["p_brand", "p_type", "p_size"]).withColumn("completion", F.round("completion", 6))


@query(
    "a05_timing_stats",
    """select event_type, round(avg(value), 6) as mean_seconds, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) as elapsed_seconds from events group by 1""",
)
def a05(t):
    out = reports.timing_stats(t("events"), "event_type", "value", "ts")
    return out.select("event_type", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("elapsed_seconds", 3).alias("elapsed_seconds"))


_FINAL = f"(select distinct name from {STAGES_SQL} where stage = 'Final')"


def _final(t):
    return stages(t).filter("stage = 'Final'").select("name")


@query(
    "a06_mention_trends",
    f"""with d as (select name, strftime(ts, '%Y-%m-%d') as day, count(*) as n from {STAGES_SQL} where name in {_FINAL} group by 1, 2)
    select name, sum(n) as total, min(day) as first_day, max(day) as last_day, string_agg(concat(day, '=', n), ', ' order by day) as daily from d group by 1""",
)
def a06(t):
    trends = reports.mention_trends(stages(t), _final(t))
    days = F.transform(F.map_entries("daily"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return trends.withColumn("daily", F.array_join(days, ", "))


def _keyword_scores(t):
    return t("events").select(
        F.concat(F.lit("U"), "user_id").alias("name"), F.concat(F.lit("k"), (F.col("event_id") % 11).cast("string")).alias("keyword"),
        F.least(F.lit(1.0), F.floor("value") / 100.0).alias("score"), "event_id",
    )


_SCORES = """(select concat('U', user_id) as name, concat('k', event_id % 11) as keyword, arg_max(least(1.0, floor(value) / 100.0), event_id) as score from events group by 1, 2)"""


@query(
    "a07_top_keywords",
    f"""with s as (select *, row_number() over (partition by name order by score desc, keyword) as rn, count(*) over (partition by name) as c from {_SCORES} where name in {_FINAL})
    select name, any_value(c) as keyword_count, string_agg(concat(keyword, ' (', printf('%.2f', score), ')'), ', ' order by rn) as top_keywords from s where rn <= 5 group by 1""",
)
def a07(t):
    return reports.top_keywords(_keyword_scores(t), _final(t), 5, order="event_id")


@query("a08_query_effectiveness", "select event_type as query, count(distinct user_id) as names from events group by 1")
def a08(t):
    return reports.query_effectiveness(t("events").select(F.col("event_type").alias("query"), F.col("user_id").alias("name")))


@query(
    "a08_query_effectiveness_summary",
    "select count(*) as queries, round(avg(n), 6) as mean_names from (select event_type, count(distinct user_id) as n from events group by 1)",
)
def a08_summary(t):
    hits = t("events").select(F.col("event_type").alias("query"), F.col("user_id").alias("name"))
    return reports.query_effectiveness_summary(hits).withColumn("mean_names", F.round("mean_names", 6))


@query("a09_edge_tables", "select l_suppkey, l_returnflag, count(*) as weight from lineitem group by 1, 2")
def a09(t):
    return reports.edge_table(t("lineitem"), "l_suppkey", "l_returnflag")


@query(
    "a10_api_usage",
    """with d as (select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as calls, count(*) filter (event_type = 'error') as errors from events group by 1, 2)
    select *, sum(calls) over (partition by user_id) as total_calls from d""",
)
def a10(t):
    return reports.api_usage(t("events").withColumn("failed", F.col("event_type") == "error"), "user_id")


CODE = "case when event_type = 'error' then case event_id % 3 when 0 then 403 when 1 then 429 else 429 end when event_type = 'signup' then 500 else 200 end"


def call_log(t):
    return t("events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 20).alias("key"), "ts", F.expr(CODE).alias("code"), F.col("event_id").alias("order"))


@query(
    "a11_key_cooldowns",
    f"""with e as (select user_id % 20 as key, ts, event_id as "order", {CODE} as code from events),
    n as (select *, row_number() over (partition by key order by ts, "order") as error_no from e where code >= 400)
    select key, "order", error_no, cast(least(60 * pow(2, error_no % 5), 3600) as int) as cooldown_s from n where code = 429""",
)
def a11(t):
    return reports.key_cooldowns(call_log(t)).drop("until")


@query(
    "a11_key_availability",
    f"""with e as (select user_id % 20 as key, ts, event_id as o, {CODE} as code from events where ts <= timestamp '2024-01-05 12:00:00'),
    n as (select *, row_number() over (partition by key order by ts, o) as no from e where code >= 400),
    u as (select key, arg_max(epoch_us(ts) + cast(least(60 * pow(2, no % 5), 3600) as bigint) * 1000000, no) as until from n where code = 429 group by 1),
    d as (select key, count(*) filter (ts >= timestamp '2024-01-05') as used_today, count(*) filter (ts >= timestamp '2024-01-05' and code = 403) as ex from e group by 1)
    select d.key, used_today, coalesce(until > epoch_us(timestamp '2024-01-05 12:00:00'), false) as cooling,
      not coalesce(until > epoch_us(timestamp '2024-01-05 12:00:00'), false) and ex = 0 and used_today < 30 as available from d left join u using (key)""",
)
def a11_state(t):
    return reports.key_availability(call_log(t), F.lit("2024-01-05 12:00:00").cast("timestamp"), 30)


@query(
    "a12_startups_report",
    """select concat('U', user_id) as name, """
    + ", ".join(
        f"coalesce(arg_max(case when event_type = '{e}' then cast(event_id as varchar) end, case when event_type = '{e}' then event_id end), '') as \"{e}\""
        for e in ("click", "error", "purchase", "signup", "view")
    )
    + " from events group by 1",
)
def a12(t):
    values = t("events").select(
        F.concat(F.lit("U"), "user_id").alias("name"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("order")
    )
    return reports.companies_report(values, ["view", "click", "purchase", "signup", "error"])


def _summary(t):
    return reports.summary_report(
        {
            "url_metrics": reports.url_metrics(url_log(t)),
            "startup_metrics": reports.funnel_summary(stages(t)),
            "query_metrics": reports.query_effectiveness_summary(
                t("events").select(F.col("event_type").alias("query"), F.col("user_id").alias("name"))
            ),
        }
    )


def _summary_sql(digits: int) -> str:
    return f"""with u as (select count(distinct url) filter (status = 'processed') as p, count(distinct url) filter (status = 'failed') as f, count(distinct url) filter (status = 'blocked') as b from {URL_LOG}),
    n as (select name, max(cast(stage = 'Potential' as int)) as p, max(cast(stage = 'Final' as int)) as f from {STAGES_SQL} group by 1),
    s as (select sum(p) as p, sum(f) as f, sum(case when p = 1 and f = 0 then 1 else 0 end) as e from n),
    q as (select count(*) as c, avg(k) as m from (select event_type, count(distinct user_id) as k from events group by 1)),
    r as (select 'url_metrics' as category, unnest(['processed', 'failed', 'blocked', 'success_rate']) as metric, unnest([p, f, b, p / greatest(1, p + f) * 100]) as value from u
      union all select 'startup_metrics', unnest(['potential', 'final', 'eliminated', 'conversion_rate']), unnest([p, f, e, f / greatest(1, p) * 100]) from s
      union all select 'query_metrics', unnest(['queries', 'mean_names']), unnest([c, m]) from q)
    select category, metric, round(cast(value as double), {digits}) as value from r"""


@query("a13_summary_report", _summary_sql(6))
def a13(t):
    return _summary(t).withColumn("value", F.round("value", 6))


@query("a14_url_report", f"select url, status, case when status = 'blocked' then 'N/A' else printf('%.2f', value) end as seconds from {URL_LOG}")
def a14(t):
    log = url_log(t).withColumn("s", F.when(F.col("status") != "blocked", F.col("value")))
    return reports.url_report(log, "url", "status", "s").withColumn("seconds", F.replace("seconds", F.lit(","), F.lit("")))


@query("a15_context_report")
def a15(t):
    """Names are first words of documents, pages are documents of the same source."""
    docs = t("documents", True).select("doc_id", "text", F.split_part("text", F.lit(" "), F.lit(1)).alias("name")).filter("length(name) > 3")
    pairs = docs.select("name", F.col("doc_id").alias("url"))
    pages = docs.select(F.col("doc_id").alias("url"), F.col("text").alias("content"))
    contexts = extract.mention_context(pairs, pages)
    scored = extract.keyword_relevance(contexts.withColumn("q", F.lit("that with theon")), "name", "context", F.col("q"), ["url"])
    words = reports.top_keywords(scored.select("name", "keyword", "score"))
    times = pairs.join(t("events").select(F.col("event_id").alias("url"), "ts"), "url").select("name", "ts")
    return reports.context_report(pairs, contexts, words, reports.mention_trends(times))


FACTS = """(select s_suppkey as company, 'Name' as field, case when s_suppkey % 3 = 0 then '' else s_name end as value, 1 as priority from supplier
  union all select s_suppkey, 'Name', upper(s_name), 2 from supplier
  union all select s_suppkey, 'Location', case when s_suppkey % 2 = 0 then n_name end, 3 from supplier join nation on s_nationkey = n_nationkey
  union all select s_suppkey, 'Location', r_name, 4 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select s_suppkey, 'Funding', case when s_suppkey % 5 = 0 then '  ' else cast(s_nationkey as varchar) end, 5 from supplier)"""


def facts(t):
    s, n, r = t("supplier"), t("nation"), t("region")
    located = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    key = F.col("s_suppkey")

    def rows(df, field, value, priority):
        return df.select(key.alias("company"), F.lit(field).alias("field"), value.alias("value"), F.lit(priority).alias("priority"))

    out = rows(s, "Name", F.when(key % 3 == 0, "").otherwise(F.col("s_name")), 1)
    out = out.unionByName(rows(s, "Name", F.upper("s_name"), 2))
    out = out.unionByName(rows(located, "Location", F.when(key % 2 == 0, F.col("n_name")), 3))
    out = out.unionByName(rows(located, "Location", F.col("r_name"), 4))
    return out.unionByName(rows(s, "Funding", F.when(key % 5 == 0, "  ").otherwise(F.col("s_nationkey").cast("string")), 5))


@query(
    "a16_merge_facts",
    f"""select company, coalesce(arg_min(value, priority) filter (field = 'Name' and trim(value) <> ''), '') as name,
      coalesce(arg_min(value, priority) filter (field = 'Location' and trim(value) <> ''), '') as location,
      coalesce(arg_min(value, priority) filter (field = 'Funding' and trim(value) <> ''), '') as funding from {FACTS} group by 1""",
)
def a16(t):
    return joins.merge_facts(facts(t), ["Name", "Location", "Funding"]).fillna("", ["name", "location", "funding"])


@query(
    "a17_combine_snippets",
    """with l as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) as rank from lineitem)
    select l_suppkey, concat('General information for ', l_suppkey, ':', chr(10), chr(10), string_agg(concat('Title: ', l_returnflag, chr(10), 'URL: ', l_orderkey, chr(10), 'Snippet: ', l_linestatus, chr(10), chr(10)), '' order by rank)) as combined
    from l group by 1""",
)
def a17(t):
    from sievework.operators.positions import with_position

    ranked = with_position(t("lineitem"), "l_orderkey", ["l_suppkey"], ["l_linenumber", "l_partkey", "l_quantity"], out="rank")
    return reports.combine_snippets(ranked, "l_suppkey", "rank", F.col("l_returnflag"), F.col("l_orderkey").cast("string"), F.col("l_linestatus"))


@query(
    "a18_missing_fields",
    """select p_partkey, concat_ws(', ', case when p_partkey % 2 = 0 then 'Location' end, 'Founded Year', case when p_partkey % 3 = 0 then 'Industry' end,
      'Funding', 'Company Description', 'Products/Services') as missing from part""",
)
def a18(t):
    part = t("part").select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 1, F.col("p_name")).alias("loc"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).otherwise(" ").alias("ind")
    )
    return part.select("p_partkey", F.array_join(reports.missing_fields({"Location": "loc", "Industry": "ind"}), ", ").alias("missing"))


@query(
    "a19_result_stats",
    r"""with s as (select count(*) as results, sum(length(text)) as raw_length, sum(length(trim(regexp_replace(text, '\s+', ' ', 'g')))) as clean_length from documents)
    select *, round((raw_length - clean_length) / greatest(1, raw_length) * 100, 2) as reduction from s""",
)
def a19(t):
    return reports.result_stats(t("documents"), F.length("text"), F.length(clean_text(F.col("text"))))


@query("a20_dashboard_rows", _summary_sql(1))
def a20(t):
    return reports.dashboard_rows(_summary(t))


@query(
    "a20_dashboard_top",
    f"""with d as (select name, count(*) as total, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day from {STAGES_SQL}
      where name in {_FINAL} group by 1 order by name limit 5),
    s as (select *, row_number() over (partition by name order by score desc, keyword) as rn from {_SCORES} where name in {_FINAL})
    select d.*, coalesce((select string_agg(concat(keyword, ' (', printf('%.2f', score), ')'), ', ' order by rn) from s where s.name = d.name and rn <= 3), '') as top_keywords from d""",
)
def a20_top(t):
    return reports.dashboard_top(reports.mention_trends(stages(t), _final(t)), reports.top_keywords(_keyword_scores(t), _final(t), 5, order="event_id"))


_MSG = "case event_id % 6 when 0 then 'HTTP 503 from host' when 1 then 'Read TIMEOUT' when 2 then 'bad key' when 3 then 'Rate Limit hit' when 4 then concat('failed after ', value) else 'not found' end"


@query(
    "a21_error_classes",
    f"""select case when {like_any('lower(m)', rules.TRANSIENT_ERRORS)} then 'transient' else 'permanent' end as error_class, count(*) as errors
    from (select {_MSG} as m from events) group by 1""",
)
def a21(t):
    return reports.error_classes(t("events").select(F.expr(_MSG).alias("m")), "m")
