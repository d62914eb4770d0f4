"""Time-series jobs over resource samples and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.positions import BLOCK, block_window, in_blocks, keep_home, micros, with_neighbours, with_position


def alert(metric: Column, mean: Column, phase: Column) -> Column:
    """Fixed limits: CPU 90/30 %, memory 80 %, disk write 10 MB/s, network 5 MB/s / 50 KB/s."""
    return (
        F.when((metric == "cpu") & (mean > 90), "high cpu")
        .when((metric == "cpu") & (mean < 30) & (phase != "initialization"), "low cpu")
        .when((metric == "memory") & (mean > 80), "high memory")
        .when((metric == "disk_write") & (mean > 10 * 1024 * 1024), "high disk write")
        .when((metric == "net_recv") & (mean > 5 * 1024 * 1024), "high network")
        .when((metric == "net_recv") & (mean < 50 * 1024) & phase.isin("crawling", "enrichment"), "low network")
    )


def rolling_mean(
    samples: DataFrame, keys: list[str], ts: str, value: str, n: int = 5, ties: list[str] | None = None, block: int = BLOCK
) -> DataFrame:
    """Mean of the last n samples, once there are more than n."""
    placed = with_position(samples, ts, keys, ties, out="pos")
    spread = in_blocks(placed, "pos", before=n - 1, block=block)
    w = block_window(keys, "pos").rowsBetween(-(n - 1), 0)
    mean = F.avg(value).over(w)
    return keep_home(spread.withColumn("rolling", F.when(F.col("pos") > n, mean)))


def phase_durations(events: DataFrame, keys: list[str], ts: str, phase: str, ties: list[str] | None = None) -> DataFrame:
    """Seconds per phase, from each event to the next; repeats of a phase add up."""
    steps = with_neighbours(events, ts, keys, following={"_next": ts}, ties=ties)
    gap = micros("_next") - micros(ts)
    return steps.filter(F.col("_next").isNotNull()).groupBy(*keys, phase).agg((F.sum(gap) / 1e6).alias("seconds"))


def rates(samples: DataFrame, keys: list[str], ts: str, counter: str, ties: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Change per second since the previous sample of the same series."""
    steps = with_neighbours(samples, ts, keys, previous={"_ts": ts, "_c": counter}, ties=ties, block=block)
    seconds = (micros(ts) - micros("_ts")) / 1e6
    rate = F.when(seconds > 0, (F.col(counter) - F.col("_c")) / seconds)
    return steps.withColumn("rate", rate).drop("_ts", "_c")


def progress(items: DataFrame, ts: str, ties: list[str]) -> DataFrame:
    """Done, percent, items per second and seconds left after each item."""
    placed = with_position(items, ts, None, ties, out="done")
    total = items.agg(F.count(F.lit(1)).alias("n"), F.min(micros(ts)).alias("t0")).first()
    elapsed = (micros(ts) - F.lit(total["t0"])) / 1e6
    rate = F.when(elapsed > 0, F.col("done") / elapsed).otherwise(0.0)
    left = F.when(rate > 0, (F.lit(total["n"]) - F.col("done")) / rate).otherwise(0.0)
    return placed.withColumns(
        {"percent": F.col("done") / F.lit(total["n"]) * 100, "per_second": rate, "seconds_left": left}
    )


def calls_in_last_minute(log: DataFrame, key: str, ts: str, limit: int, span: int = 60, block_seconds: int = 3600) -> DataFrame:
    """(key, second, calls, trailing, over_limit) per second with calls.

    Calls are counted per second before the shuffle; the trailing frame runs on hour blocks
    that carry the last minute of the block before.
    """
    per_second = log.groupBy(key, F.unix_seconds(F.col(ts).cast("timestamp")).alias("second")).agg(F.count(F.lit(1)).alias("calls"))
    home = F.floor(F.col("second") / block_seconds)
    late = F.col("second") % block_seconds >= block_seconds - (span - 1)
    spread = per_second.withColumns({"_at": home, "_block": F.explode(F.array_compact(F.array(home, F.when(late, home + 1))))})
    w = Window.partitionBy(key, "_block").orderBy("second").rangeBetween(-(span - 1), 0)
    counted = spread.withColumn("trailing", F.sum("calls").over(w)).filter(F.col("_block") == F.col("_at"))
    return counted.select(key, "second", "calls", "trailing", (F.col("trailing") > limit).alias("over_limit"))
