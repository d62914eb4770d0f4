"""ST1-ST9: streaming jobs run to the end of the table, results read back from their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.catalog.base import ORACLE, QUERIES
from sievework.catalog.sources import scratch
from sievework.catalog.windowing import SERIES
from sievework.streaming import feeds, monitors
from sievework.sources import tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_query(key: str, sql: str | None = None):
    """Register ``fn(spark, stream_of)``, where ``stream_of(name)`` reads a table as a stream."""

    def add(fn):
        def run(spark, sf_dir) -> DataFrame:
            def stream_of(name):
                schema = tables.load(spark, sf_dir, name).schema
                return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)

            return fn(spark, stream_of)

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def to_table(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path, log = scratch(spark, name), scratch(spark, name + "-log")
    feeds.run_to_end(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append"))
    return spark.read.schema(stream.schema).parquet(path)


@stream_query(
    "st1_company_feed",
    "select min(p_partkey) as pos, arg_min(p_name, p_partkey) as company_name from part group by lower(trim(p_name))",
)
def st1(spark, stream_of):
    rows = stream_of("part").select(F.col("p_name").alias("Company Name"), F.col("p_partkey").alias("pos"))
    path, log = scratch(spark, "feed"), scratch(spark, "feed-log")
    feeds.run_to_end(feeds.company_feed(rows, path, log))
    return spark.read.parquet(path).select("pos", F.col("Company Name").alias("company_name"))


@stream_query("st2_unseen_urls", "select distinct concat('https://p.org/', lower(p_name)) as url from part")
def st2(spark, stream_of):
    url = F.concat(F.lit("https://p.org/"), F.lower("p_name"))
    return to_table(feeds.unseen_urls(stream_of("part").select(url.alias("url")), "url").select("url"), "unseen")


@stream_query(
    "st3_daily_mentions",
    """select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events
    where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2""",
)
def st3(spark, stream_of):
    """Days that are complete once the watermark has passed."""
    return to_table(feeds.daily_mentions(stream_of("events"), "user_id", "ts"), "mentions")


#: rows of complete days, and for each the run it belongs to: two days without rows of its key end a run
DAY_RUNS = """d as (select *, {key} as key, date_trunc('day', ts) as day from events),
      b as (select *, case when date_diff('day', lag(day) over w, day) <= 2 then 0 else 1 end as start from d
        where day + interval 1 day <= (select max(ts) - interval 1 hour from events) window w as (partition by key order by ts, event_id)),
      g as (select *, sum(start) over (partition by key order by ts, event_id rows unbounded preceding) as run from b)"""


@stream_query(
    "st4_rolling_monitor",
    f"""with {DAY_RUNS.format(key=SERIES)}, s as (select *, row_number() over w as pos, avg(value) over (w rows between 4 preceding and current row) as m
      from g window w as (partition by key, run order by ts, event_id))
    select key as metric, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, value, case when pos > 5 then round(m, 6) else -1 end as rolling from s""",
)
def st4(spark, stream_of):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream_of("events").select(
        F.lit("h").alias("host"), F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("metric"), "ts", F.col("event_id").alias("order"), "value"
    )
    out = to_table(monitors.rolling_monitor(rows, idle="2 days"), "rolling")
    return out.select("metric", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "value", F.coalesce(F.round("rolling", 6), F.lit(-1.0)).alias("rolling"))


@stream_query(
    "st5_phase_tracker",
    f"""with {DAY_RUNS.format(key="user_id")}, s as (select *, lag(event_type) over (partition by key, run order by ts, event_id) as p from g),
    c as (select *, lead(ts) over (partition by key, run order by ts, event_id) as nxt from s where p is null or p <> event_type)
    select concat('U', user_id) as run, event_type as phase, round((epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) as seconds from c where nxt is not null""",
)
def st5(spark, stream_of):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream_of("events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("run"), "ts", F.col("event_id").alias("order"), F.col("event_type").alias("phase"))
    return to_table(monitors.phase_monitor(rows, idle="2 days"), "phases").select("run", "phase", F.round("seconds", 3).alias("seconds"))


@stream_query(
    "st6_upsert_feed",
    "select concat('s', user_id) as session_id, arg_max(event_type, ts) as status, arg_max(props, ts) as data from events group by 1",
)
def st6(spark, stream_of):
    rows = stream_of("events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("status"), F.col("props").alias("data"), F.col("ts").alias("updated_at")
    )
    root, log = scratch(spark, "kv"), scratch(spark, "kv-log")
    feeds.run_to_end(feeds.upsert_feed(rows, root, "sessions", ["session_id"], log))
    return tables.read_kv(spark, root, "sessions").select("session_id", "status", "data")


@stream_query("st7_live_counters", "select event_type as stage, count(*) as n from events group by 1")
def st7(spark, stream_of):
    counts = feeds.live_counters(stream_of("events").select(F.col("event_type").alias("stage")), "stage")
    path, log = scratch(spark, "counters"), scratch(spark, "counters-log")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(path)

    feeds.run_to_end(counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", log))
    return spark.read.parquet(path)


@stream_query(
    "st8_call_rate",
    """with t as (select event_type as key, epoch_us(ts) // 10000000 * 10 as tick, count(*) as n from events group by 1, 2),
    w as (select key, tick - o as s, n from t, (select unnest(range(0, 60, 10)) as o))
    select key, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') as from_ts, strftime(make_timestamp((s + 60) * 1000000), '%Y-%m-%d %H:%M:%S') as to_ts, sum(n) as calls
    from w where s + 60 <= (select max(epoch_us(ts)) / 1e6 - 60 from events) group by key, s""",
)
def st8(spark, stream_of):
    """Windows that are complete once the watermark has passed."""
    out = to_table(feeds.call_rate(stream_of("events").select(F.col("event_type").alias("key"), "ts"), "key", "ts", step="10 seconds"), "rate")
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.select("key", F.date_format("from_ts", stamp).alias("from_ts"), F.date_format("to_ts", stamp).alias("to_ts"), "calls")


@stream_query(
    "st9_activity_sessions",
    """with s as (select user_id, event_type, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as start from events window w as (partition by user_id order by ts, event_id)),
    g as (select *, sum(start) over (partition by user_id order by ts rows unbounded preceding) as run from s)
    select user_id, count(*) as events, arg_max(event_type, ts) as last_status from g group by user_id, run
    having max(ts) + interval 30 minutes <= (select max(ts) - interval 1 hour from events)""",
)
def st9(spark, stream_of):
    out = feeds.activity_sessions(stream_of("events"), "user_id", "ts", "event_type")
    return to_table(out, "sessions").select("user_id", "events", "last_status")
