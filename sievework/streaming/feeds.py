"""Structured Streaming forms of the incremental jobs (ST1-ST3, ST6-ST9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.utils import AnalysisException

from sievework.functions import urls
from sievework.operators.joins import append_new, trimmed_key
from sievework.operators.keys import last_per_key
from sievework.sources.tables import bucket_of, is_missing, touched, write_kv


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Event time must carry a zone before a watermark can be set."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def company_feed(stream: DataFrame, target: str, checkpoint: str, name: str = "Company Name", order: str = "pos", buckets: int = 64):
    """ST1: append only new names. A batch looks only into the buckets that its names fall into.

    Rows lie in folders by name bucket and batch. A batch that is run again replaces its own folders. ``buckets``
    belongs to the target: it has to stay as it was at the first write.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("name_bucket", bucket_of([trimmed_key(F.col(name))], buckets))
        try:
            stored = spark.read.parquet(target).filter(F.col("name_bucket").isin(touched(rows, "name_bucket")))
            known = stored.filter(F.col("batch_id") != batch_id).select(name)
        except AnalysisException as problem:
            if not is_missing(problem):
                raise
            known = spark.createDataFrame([], f"`{name}` string")
        fresh = append_new(rows, known, name, order, f"batch {batch_id}").withColumn("batch_id", F.lit(batch_id))
        writer = fresh.hint("rebalance", "name_bucket").write.partitionBy("name_bucket", "batch_id")
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def unseen_urls(stream: DataFrame, url: str, ts: str | None = None, horizon: str = "7 days") -> DataFrame:
    """ST2: first row of each fingerprint; with ``ts`` the state is kept for ``horizon`` only."""
    marked = stream.withColumn("url_fp", urls.fingerprint(F.col(url)))
    if ts is None:
        return marked.dropDuplicates(["url_fp"])
    return _timed(marked, ts).withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["url_fp"])


def daily_mentions(stream: DataFrame, name: str, ts: str, late: str = "1 hour") -> DataFrame:
    """ST3: mentions per name and day; rows later than ``late`` are dropped."""
    counts = _timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), name).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(name, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def upsert_feed(stream: DataFrame, root: str, table: str, keys: list[str], checkpoint: str, order: str = "updated_at"):
    """ST6: the latest row per key of each batch goes into the key-value table, into the buckets of its keys only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_kv(batch.sparkSession, root, table, last_per_key(batch, keys, order))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_counters(stream: DataFrame, stage: str) -> DataFrame:
    """ST7: running count per stage, for complete mode."""
    return stream.groupBy(stage).agg(F.count(F.lit(1)).alias("n"))


def observed_counters(stream: DataFrame, name: str, stage: str, stages: list[str]) -> DataFrame:
    """ST7: the stream itself, with its rows of each stage counted for every micro-batch, besides ``rows``, for a listener."""
    counts = [F.count_if(F.col(stage) == s).alias(s) for s in stages]
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *counts)


class CounterListener(StreamingQueryListener):
    """ST7: keeps the last observed metrics of each named ``observe``, and their totals over all micro-batches."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}
        self.totals: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.latest[name] = row.asDict()
            total = self.totals.setdefault(name, {})
            for metric, value in self.latest[name].items():
                total[metric] = total.get(metric, 0) + value

    def onQueryTerminated(self, event) -> None:
        pass


def call_rate(stream: DataFrame, key: str, ts: str, late: str = "1 minute", span: str = "60 seconds", step: str = "1 second") -> DataFrame:
    """ST8: calls per key in sliding minutes.

    Calls are counted per step first, so a row is not copied into every sliding window.
    """
    tick = F.window(ts, step)
    per_step = _timed(stream, ts).withWatermark(ts, late).groupBy(tick.alias("tick"), key).agg(F.count(F.lit(1)).alias("calls"))
    sliding = per_step.groupBy(F.window(F.window_time("tick"), span, step).alias("w"), key).agg(F.sum("calls").alias("calls"))
    return sliding.select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "calls")


def activity_sessions(stream: DataFrame, key: str, ts: str, status: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """ST9: sessions of activity with their last status."""
    return (
        _timed(stream, ts).withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("events"), F.max_by(status, ts).alias("last_status"))
        .select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events", "last_status")
    )


def run_to_end(writer, timeout: int | None = None) -> None:
    """Process what is there, then stop; with ``timeout`` a stream that takes more seconds is stopped and fails."""
    query = writer.trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("stream did not finish")
