"""Sources and sinks, round-tripped through files where they write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import rules
from sievework.catalog.base import query
from sievework.operators import joins
from sievework.operators.keys import last_per_key
from sievework.sources import companies as files
from sievework.sources import tables


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of the session; of this machine only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="sievework-files-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _company_rows(t) -> DataFrame:
    key = F.col("c_custkey")
    return t("customer").select(
        F.when(key % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("Company Name"),
        F.col("c_mktsegment").alias("Industry"),
        F.when(key % 4 != 0, (1900 + key % 100).cast("string")).alias("Founded Year"),
        F.concat(F.lit("https://x.org/"), key.cast("string")).alias("Original URL"),
        key.alias("pos"),
    )


@query(
    "s01_read_companies",
    "select c_custkey as pos, c_name as company_name, c_mktsegment as industry from customer where c_custkey % 10 <> 0",
)
def s01(t):
    rows = _company_rows(t)
    path = scratch(rows.sparkSession, "companies")
    rows.write.csv(path, header=True, escape='"')
    read = files.read_companies(rows.sparkSession, path)
    return read.select(F.col("pos").cast("long").alias("pos"), F.col("Company Name").alias("company_name"), F.col("Industry").alias("industry"))


@query("s02_validate_company_csv", "select 'no column ''Name'' or ''Company Name''' as problem, (select count(*) from nation) as rows")
def s02(t):
    nation = t("nation").select("n_name")
    spark = nation.sparkSession
    path = scratch(spark, "nations")
    nation.write.csv(path, header=True)
    problems = files.validate_company_csv(spark, path)
    return nation.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*[F.lit(p) for p in problems])).alias("problem"), "rows")


@query("s03_read_name_list", "select trim(c_name) as name from customer where c_custkey % 10 <> 0")
def s03(t):
    rows = _company_rows(t).select(F.col("Company Name").alias("value"))
    path = scratch(rows.sparkSession, "names")
    rows.write.text(path)
    return tables.read_name_list(rows.sparkSession, path)


@query("s04_query_list", "select p_name as query from part where p_partkey % 3 = 0")
def s04(t):
    part = t("part").select(
        F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("# "), "p_name")).when(F.col("p_partkey") % 3 == 2, " ").otherwise(F.col("p_name")).alias("query"),
        F.col("p_partkey").alias("pos"),
    )
    path = scratch(part.sparkSession, "queries")
    tables.write_query_list(part, path)
    return tables.read_query_list(part.sparkSession, path)


@query(
    "s05_checkpoint_round_trip",
    """select case when c_custkey % 10 = 0 then '  ' else concat(' ', c_name, ' ') end as company_name, c_mktsegment as industry from customer""",
)
def s05(t):
    rows = _company_rows(t)
    spark = rows.sparkSession
    path = files.write_checkpoint(rows, scratch(spark, "run"), "discovery", 3, "20240101_000000")
    back = files.read_checkpoint(spark, path)
    return back.select(F.col("Company Name").alias("company_name"), F.col("Industry").alias("industry"))


@query("s06_read_checkpoint", "select c_name as company_name, cast(c_custkey as varchar) as pos from customer")
def s06(t):
    """Columns come back as text; a missing checkpoint adds no rows."""
    rows = t("customer").select(F.col("c_name").alias("Company Name"), F.col("c_custkey").alias("pos"))
    spark = rows.sparkSession
    missing = files.read_checkpoint(spark, scratch(spark, "missing"))
    there = files.read_checkpoint(spark, files.write_checkpoint(rows, scratch(spark, "run"), "validation", stamp="20240102_030405"))
    both = missing.unionByName(there, allowMissingColumns=True)
    return both.select(F.col("Company Name").alias("company_name"), "pos")


_PATHS = "concat('out/run_', case event_type when 'view' then 'discovery' when 'click' then 'enrichment' else 'validation' end, '_batch', user_id, '_', strftime(ts, '%Y%m%d_%H%M%S'), '.csv')"


@query("s07_latest_checkpoint", f"select arg_max(p, (regexp_extract(p, '(\\d{{8}}_\\d{{6}})'), p)) as path from (select {_PATHS} as p from events where event_type = 'click')")
def s07(t):
    phase = F.when(F.col("event_type") == "view", "discovery").when(F.col("event_type") == "click", "enrichment").otherwise("validation")
    path = F.concat(
        F.lit("out/run_"), phase, F.lit("_batch"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".csv")
    )
    return files.latest_checkpoint(t("events").select(path.alias("path")), "enrichment")


@query("s08_resume_phase", "select case when count(*) = 0 then 'discovery' when max(cast(c_custkey % 4 <> 0 as int)) = 1 then 'validation' else 'enrichment' end as phase from customer")
def s08(t):
    return files.resume_phase(_company_rows(t))


@query(
    "s09_export_csv",
    "select "
    + ", ".join(
        {
            "Company Name": "case when c_custkey % 10 = 0 then '  ' else concat(' ', c_name, ' ') end",
            "Industry": "c_mktsegment",
            "Founded Year": "case when c_custkey % 4 <> 0 then cast(1900 + c_custkey % 100 as varchar) else '' end",
            "Source URL": "concat('https://x.org/', c_custkey)",
        }.get(c, "''")
        + f' as "{rules.snake(c)}"'
        for c in rules.EXPORT_COLUMNS
    )
    + " from customer",
)
def s09(t):
    rows = _company_rows(t)
    spark = rows.sparkSession
    path = scratch(spark, "export")
    files.export_companies_csv(rows, path)
    back = spark.read.csv(path, header=True, escape='"', nullValue="\u0000")
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(rules.snake(c)) for c in rules.EXPORT_COLUMNS])


_KNOWN = "(select lower(s_name) as k from supplier union select lower(c_name) from customer where c_custkey % 2 = 0)"


@query(
    "s10_append_new_companies",
    f"""with r as (select o_orderkey, case when o_custkey % 9 = 0 then ' ' else upper(c_name) end as name from orders join customer on o_custkey = c_custkey)
    select min(o_orderkey) as pos, arg_min(name, o_orderkey) as name, 'run 1' as batch_info from r where trim(name) <> '' and lower(name) not in (select k from {_KNOWN}) group by lower(trim(name))""",
)
def s10(t):
    c = t("customer")
    found = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("pos"), F.when(F.col("o_custkey") % 9 == 0, " ").otherwise(F.upper("c_name")).alias("name")
    )
    target = t("supplier").select(F.col("s_name").alias("name")).unionByName(c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("name")))
    return joins.append_new(found, target, "name", "pos", "run 1")


@query(
    "s11_merge_append",
    """with t as (select c_custkey as pos, c_name as name from customer where c_custkey % 2 = 0), s as (select c_custkey as pos, case when c_custkey % 7 = 0 then '' else upper(c_name) end as name from customer)
    select pos, name, '' as source_file from t union all select pos, name, 'new.csv' from s where name = '' or lower(name) not in (select lower(name) from t)""",
)
def s11(t):
    c = t("customer")
    target = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"))
    source = c.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.upper("c_name")).alias("name"))
    return joins.merge_append(source, target, "name", "pos", "new.csv").fillna("", ["source_file"])


@query("s12_dedupe_to_version", "select min(p_partkey) as pos, p_name as company_name from part group by p_name")
def s12(t):
    rows = t("part").select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" Inc.")).alias("Company Name"))
    spark = rows.sparkSession
    old, new = scratch(spark, "parts"), scratch(spark, "parts-v2")
    rows.write.parquet(old)
    files.dedupe_to_version(spark, old, new, "pos")
    return spark.read.parquet(new).select("pos", F.regexp_replace("Company Name", r" Inc\.$", "").alias("company_name"))


@query("s13_csv_text", "select concat(n_nationkey, ',', n_name, ',', n_regionkey) as line from nation")
def s13(t):
    return files.csv_text(t("nation").select("n_nationkey", "n_name", "n_regionkey"))


@query(
    "s14_export_json",
    """select p_name as company, concat('{"basic_info":{"location":"', arg_max(p_brand, p_partkey), '"},"detailed_info":{"kind":"', arg_max(p_type, p_partkey), '"},"meta":{"source":"table"}}') as json
    from part group by p_name""",
)
def s14(t):
    rows = t("part").select(
        F.col("p_name").alias("Company Name"), F.col("p_brand").alias("Location"), F.col("p_type").alias("Kind"), F.lit("table").alias("Source"), F.col("p_partkey").alias("pos")
    )
    return files.json_rows(rows, "pos")


@query(
    "s15_chunk_files",
    "select text as chunk, doc_id as chunk_index, concat('https://d.org/', doc_id) as url, lang as title from documents",
)
def s15(t):
    source = F.struct(F.concat(F.lit("https://d.org/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("title"), F.lit("q").alias("search_query"))
    rows = t("documents").select(F.col("text").alias("chunk"), F.col("doc_id").cast("int").alias("chunk_index"), F.lit(1).alias("total_chunks"), F.array(source).alias("sources"))
    path = scratch(rows.sparkSession, "chunks")
    tables.write_chunks(rows, path)
    return tables.read_chunks(rows.sparkSession, path).select("chunk", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("sources")[0]["url"].alias("url"), F.col("sources")[0]["title"].alias("title"))


def _kv_rows(t):
    return t("events").select(
        F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_type").alias("metric_name"), F.col("props").alias("metric_value"),
        F.col("ts").alias("updated_at"), "event_id",
    )


@query(
    "s16_kv_tables",
    """select concat('s', user_id) as session_id, event_type as metric_name, arg_max(props, ts) as metric_value from events group by 1, 2""",
)
def s16(t):
    rows = _kv_rows(t).drop("event_id")
    spark = rows.sparkSession
    root = scratch(spark, "kv")
    tables.write_kv(spark, root, "metrics", rows)
    tables.write_kv(spark, root, "metrics", rows.filter("metric_name = 'view'"))
    return tables.read_kv(spark, root, "metrics").select("session_id", "metric_name", "metric_value")


@query(
    "s17_kv_upsert",
    "select user_id, max(event_id) as event_id, arg_max(props, event_id) as data from events group by user_id",
)
def s17(t):
    rows = t("events").select("user_id", "event_id", F.col("props").alias("data"))
    old = last_per_key(rows.filter("event_id % 2 = 0"), ["user_id"], "event_id")
    # what is newer than the stored row is written over it
    newer = rows.join(old.select("user_id", F.col("event_id").alias("_old")), "user_id", "left")
    newer = newer.filter("_old is null or event_id > _old").drop("_old")
    return joins.kv_upsert(old, newer, ["user_id"], "event_id")


@query(
    "s18_kv_lookup",
    "select event_id, json_extract_string(props, '$.k') as k from events where user_id in (select s_suppkey from supplier)",
)
def s18(t):
    table = t("events").select("event_id", "user_id", F.col("props").alias("data"))
    wanted = t("supplier").select(F.col("s_suppkey").alias("user_id"))
    return joins.kv_lookup(table, wanted, ["user_id"]).select("event_id", F.col("data")["k"].alias("k"))


@query("s19_kv_scan_expand", "select event_id, event_type as name, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def s19(t):
    table = t("events").select("event_id", F.col("event_type").alias("name"), F.col("props").alias("data"))
    return joins.kv_scan_expand(table, "struct<k:bigint,name:string>", ["event_id", "name"])


@query("s20_latest_session", "select event_id as session_id, event_type as status from events order by ts desc, event_id desc limit 1")
def s20(t):
    return joins.latest_session(t("events").select(F.col("event_id").alias("session_id"), F.col("event_type").alias("status"), "ts")).drop("ts")


@query("s21_map_lines", "select upper(c_name) as value from customer")
def s21(t):
    rows = t("customer").select(F.col("c_name").alias("value"))
    path = scratch(rows.sparkSession, "lines")
    rows.write.text(path)
    return tables.map_lines(rows.sparkSession, path, F.upper)


@query(
    "s22_search_hits",
    """with r as (select o_custkey as query_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders)
    select query_id, cast(rank as int) as rank, concat('u', o_orderkey) as url from r where rank > 2 and rank <= 7""",
)
def s22(t):
    from sievework.operators.positions import with_position

    ranked = with_position(t("orders").select("o_custkey", "o_orderkey"), "o_orderkey", ["o_custkey"], out="rank")
    name = F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))
    odd = F.col("o_orderkey") % 2 == 1
    hits = ranked.select(
        F.col("o_custkey").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.when(odd, name).alias("url"), F.when(~odd, name).otherwise("").alias("link")
    )
    return tables.search_hits(hits, 2, 5)


@query(
    "s23_run_summary",
    """select 'run-1' as session_id, 'completed' as status, concat('{"processed":', count(*), ',"from_cache":', count(*) filter (c_custkey % 3 = 0), ',"new":', count(*) - count(*) filter (c_custkey % 3 = 0), '}') as data from customer""",
)
def s23(t):
    rows = t("customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("cached"))
    spark = rows.sparkSession
    root = scratch(spark, "sessions")
    tables.write_with_summary(spark, rows, "cached", f"{root}/result", root, "run-1")
    return tables.read_kv(spark, root, "sessions").select("session_id", "status", "data")
