"""first/last, top-k, batches, positions and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.base import query
from sievework.operators import keys, windows
from sievework.operators.positions import with_position


@query("w01_first_per_key", "select min(p_partkey) as p_partkey, p_name, arg_min(p_brand, p_partkey) as p_brand from part group by p_name")
def w01(t):
    return keys.first_per_key(t("part").select("p_partkey", "p_name", "p_brand"), ["p_name"], "p_partkey")


@query(
    "w02_last_per_key",
    "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id",
)
def w02(t):
    return keys.last_per_key(t("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


SERIES = "concat(event_type, user_id % 10)"


def samples(t):
    return t("events").select(
        F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("series"), "event_id", "ts", "value"
    )


@query(
    "w04_rolling_mean",
    f"""with s as (select event_id, row_number() over w as pos, avg(value) over (w rows between 4 preceding and current row) as m
      from (select *, {SERIES} as series from events) window w as (partition by series order by ts, event_id))
    select event_id, pos, case when pos > 5 then round(m, 6) else -1 end as rolling from s""",
)
def w04(t):
    out = windows.rolling_mean(samples(t), ["series"], "ts", "value", ties=["event_id"])
    return out.select("event_id", "pos", F.coalesce(F.round("rolling", 6), F.lit(-1.0)).alias("rolling"))


@query(
    "w04_alerts",
    """with s as (select event_id, event_type, row_number() over w as pos, avg(value * 10) over (w rows between 4 preceding and current row) as m
      from events window w as (partition by event_type order by ts, event_id))
    select event_id, case when m > 90 then 'high cpu' else 'low cpu' end as alert from s where pos > 5 and (m > 90 or (m < 30 and event_type <> 'view'))""",
)
def w04_alerts(t):
    rows = t("events").select("event_type", "event_id", "ts", (F.col("value") * 10).alias("value"))
    out = windows.rolling_mean(rows, ["event_type"], "ts", "value", ties=["event_id"])
    phase = F.when(F.col("event_type") == "view", "initialization").otherwise("crawling")
    return out.select("event_id", windows.alert(F.lit("cpu"), F.col("rolling"), phase).alias("alert")).filter("alert is not null")


@query(
    "w05_phase_durations",
    """with s as (select user_id, event_type, ts, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events)
    select user_id, event_type, round(sum(epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) as seconds from s where nxt is not null group by 1, 2""",
)
def w05(t):
    out = windows.phase_durations(t("events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], "ts", "event_type", ["event_id"])
    return out.withColumn("seconds", F.round("seconds", 3))


@query(
    "w06_limit_per_query",
    """with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders)
    select o_custkey, o_orderkey, rn, cast(floor((rn - 1) / 3) as int) as slice from r where rn <= 6""",
)
def w06(t):
    return keys.limit_per_query(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3, 10)


@query("w07_batch_ids", "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 100 as batch from orders")
def w07(t):
    return keys.batch_ids(t("orders").select("o_orderkey"), "o_orderkey", 100)


@query("w08_take_until_sufficient", "select p_partkey, p_name from part where p_size > 25 order by p_partkey limit 40")
def w08(t):
    return keys.take_until_sufficient(t("part").select("p_partkey", "p_name", "p_size"), F.col("p_size") > 25, "p_partkey", 10, 40).drop("p_size")


@query("w09_top_by_priority", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def w09(t):
    return keys.top_by_priority(t("orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), "o_orderkey", 25)


@query(
    "w10_rates",
    f"""with s as (select event_id, value, ts, lag(value) over w as pv, lag(ts) over w as pt from (select *, {SERIES} as series from events) window w as (partition by series order by ts, event_id))
    select event_id, coalesce(round((value - pv) / ((epoch_us(ts) - epoch_us(pt)) / 1e6), 6), -1) as rate from s""",
)
def w10(t):
    out = windows.rates(samples(t), ["series"], "ts", "value", ["event_id"])
    return out.select("event_id", F.coalesce(F.round("rate", 6), F.lit(-1.0)).alias("rate"))


@query(
    "w11_progress",
    """with n as (select event_id, row_number() over (order by ts, event_id) as done, count(*) over () as n, epoch_us(ts) as t, min(epoch_us(ts)) over () as t0 from events),
    r as (select *, (t - t0) / 1e6 as el from n)
    select event_id, done, round(done / n * 100, 6) as percent, round(case when el > 0 then done / el else 0 end, 6) as per_second,
      round(case when el > 0 then (n - done) / (done / el) else 0 end, 3) as seconds_left from r""",
)
def w11(t):
    out = windows.progress(t("events").select("event_id", "ts"), "ts", ["event_id"])
    return out.select(
        "event_id", "done", F.round("percent", 6).alias("percent"), F.round("per_second", 6).alias("per_second"), F.round("seconds_left", 3).alias("seconds_left")
    )


@query(
    "w12_calls_in_last_minute",
    """with s as (select event_type as key, epoch_us(ts) // 1000000 as second, count(*) as calls from events group by 1, 2)
    select key, second, calls, sum(calls) over (partition by key order by second range between 59 preceding and current row) as trailing,
      sum(calls) over (partition by key order by second range between 59 preceding and current row) > 1 as over_limit from s""",
)
def w12(t):
    return windows.calls_in_last_minute(t("events").select(F.col("event_type").alias("key"), "ts"), "key", "ts", 1)


@query("w13_sorted_export", "select c_name, c_mktsegment from customer order by c_name")
def w13(t):
    return t("customer").select("c_name", "c_mktsegment").orderBy("c_name")


@query("w13_positions_by_name", "select c_custkey, row_number() over (order by c_name desc, c_custkey) as pos from customer")
def w13_positions(t):
    return with_position(t("customer").select("c_custkey", "c_name"), "c_name", ties=["c_custkey"], descending=True).drop("c_name")
