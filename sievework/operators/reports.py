"""Aggregates and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import rules
from sievework.functions.text import contains_any, is_blank
from sievework.operators.keys import join_totals, limit_per_key
from sievework.operators.positions import micros, with_position


def percent(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole) * 100


def distinct_count_by(df: DataFrame, group: list[str], item: str, out: str = "n") -> DataFrame:
    """Distinct items per group in two aggregates, so that a hot group is counted in parallel."""
    return df.select(*group, item).filter(F.col(item).isNotNull()).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias(out))


def url_metrics(log: DataFrame, url: str = "url", status: str = "status") -> DataFrame:
    """A01."""
    per_url = log.groupBy(url).agg(
        *[F.max((F.col(status) == s).cast("int")).alias(s) for s in ("processed", "failed", "blocked")]
    )
    sums = per_url.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("processed", "failed", "blocked")])
    return sums.withColumn("success_rate", percent(F.col("processed"), F.col("processed") + F.col("failed")))


def funnel(events: DataFrame, name: str = "name", stage: str = "stage") -> DataFrame:
    """Distinct names per stage."""
    return distinct_count_by(events, [stage], name, "names")


def funnel_summary(events: DataFrame, name: str = "name", stage: str = "stage") -> DataFrame:
    """Potential, final and eliminated names, and the conversion rate."""
    flags = events.groupBy(name).agg(
        F.max((F.col(stage) == "Potential").cast("int")).alias("p"), F.max((F.col(stage) == "Final").cast("int")).alias("f")
    )
    sums = flags.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("potential"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("final"),
        F.coalesce(F.sum(F.when((F.col("p") == 1) & (F.col("f") == 0), 1).otherwise(0)), F.lit(0)).alias("eliminated"),
    )
    return sums.withColumn("conversion_rate", percent(F.col("final"), F.col("potential")))


def extraction_success(events: DataFrame, source: str = "source", ok: str = "ok", fallback: str | None = None) -> DataFrame:
    """A03."""
    aggs = [F.count(F.lit(1)).alias("attempts"), F.count_if(F.col(ok)).alias("successes")]
    if fallback:
        aggs.append(F.count_if(F.col(fallback)).alias("fallbacks"))
    out = events.groupBy(source).agg(*aggs)
    return out.withColumn("success_rate", percent(F.col("successes"), F.col("attempts")))


def field_completion(companies: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """Share of distinct companies with a value, per field."""
    per_company = companies.groupBy(name).agg(*[F.max((~is_blank(F.col(f).cast("string"))).cast("int")).alias(f) for f in fields])
    sums = per_company.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields])
    long = sums.unpivot(["n"], fields, "field", "filled")
    return long.select("field", "filled", percent(F.col("filled"), F.col("n")).alias("completion"))


def timing_stats(log: DataFrame, kind: str, seconds: str, ts: str) -> DataFrame:
    """Mean seconds per kind of work, with the span of the whole log."""
    per = log.groupBy(kind).agg(F.avg(seconds).alias("mean_seconds"), F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    span = micros("_b") - micros("_a")
    return per.select(kind, "mean_seconds", (span / 1e6).alias("elapsed_seconds"))


def mention_trends(mentions: DataFrame, final: DataFrame | None = None, name: str = "name", ts: str = "ts") -> DataFrame:
    """(name, total, first_day, last_day, daily map)."""
    if final is not None:
        mentions = mentions.join(final.select(name).distinct(), name, "left_semi")
    days = mentions.groupBy(name, F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy(name).agg(
        F.sum("n").alias("total"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "n")))).alias("daily"),
    )


def top_keywords(scores: DataFrame, final: DataFrame | None = None, k: int = 5, name: str = "name", order: str | None = None) -> DataFrame:
    """(name, keyword_count, top_keywords) with text such as "energy (0.40), ..."."""
    if final is not None:
        scores = scores.join(final.select(name).distinct(), name, "left_semi")
    last = scores.groupBy(name, "keyword").agg((F.max_by("score", order) if order else F.max("score")).alias("score"))
    counts = last.groupBy(name).agg(F.count(F.lit(1)).alias("keyword_count"))
    top = limit_per_key(last, [name], [F.desc("score"), F.asc("keyword")], k)
    label = F.concat("keyword", F.lit(" ("), F.format_number("score", 2), F.lit(")"))
    text = top.groupBy(name).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", label.alias("t")))), lambda x: x["t"]), ", ").alias(
            "top_keywords"
        )
    )
    return counts.join(text, name)


def query_effectiveness(hits: DataFrame, query: str = "query", name: str = "name") -> DataFrame:
    """Distinct names per query."""
    return distinct_count_by(hits, [query], name, "names")


def query_effectiveness_summary(hits: DataFrame, query: str = "query", name: str = "name") -> DataFrame:
    per = query_effectiveness(hits, query, name)
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("names").alias("mean_names"))


def edge_table(df: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs with their count."""
    return df.groupBy(left, right).agg(F.count(F.lit(1)).alias("weight"))


def api_usage(log: DataFrame, key: str = "key", ts: str = "ts", failed: str = "failed") -> DataFrame:
    """A10: calls and errors per key and day, with the total of the key."""
    daily = log.groupBy(key, F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col(failed)).alias("errors")
    )
    total = daily.groupBy(key).agg(F.sum("calls").alias("total_calls"))
    return join_totals(daily, total, [key])


def key_cooldowns(log: DataFrame, key: str = "key", ts: str = "ts", code: str = "code", order: str = "order") -> DataFrame:
    """Every rate-limit error with its cooldown; errors of a key are counted in order."""
    errors = log.filter(F.col(code) >= 400).select(key, ts, code, order)
    numbered = with_position(errors, ts, [key], [order], out="error_no")
    cooldown = F.least(F.lit(60) * F.pow(F.lit(2), F.col("error_no") % 5), F.lit(3600)).cast("int")
    limited = numbered.filter(F.col(code) == 429)
    return limited.select(
        key, order, "error_no", cooldown.alias("cooldown_s"), F.timestamp_seconds(micros(ts) / 1e6 + cooldown).alias("until")
    )


def key_availability(log: DataFrame, at: Column, quota: int = 100, key: str = "key", ts: str = "ts", code: str = "code", order: str = "order") -> DataFrame:
    """(key, used_today, cooling, available) at one moment."""
    today = F.date_format(ts, "yyyy-MM-dd") == F.date_format(at, "yyyy-MM-dd")
    use = log.filter(F.col(ts) <= at).groupBy(key).agg(
        F.count_if(today).alias("used_today"), F.bool_or(today & (F.col(code) == 403)).alias("exhausted")
    )
    cool = key_cooldowns(log.filter(F.col(ts) <= at), key, ts, code, order).groupBy(key).agg(F.max_by("until", "error_no").alias("until"))
    out = use.join(cool, key, "left").withColumn("cooling", F.coalesce(at < F.col("until"), F.lit(False)))
    free = ~F.col("cooling") & ~F.coalesce("exhausted", F.lit(False)) & (F.col("used_today") < quota)
    return out.select(key, "used_today", "cooling", free.alias("available"))


def companies_report(values: DataFrame, fields: list[str], name: str = "name", order: str = "order") -> DataFrame:
    """Names by sorted fields, blank when missing; the last value of a field counts."""
    picks = [
        F.coalesce(F.max_by("value", F.when((F.col("field") == f) & ~is_blank(F.col("value")), F.col(order))), F.lit("")).alias(
            rules.snake(f)
        )
        for f in sorted(fields)
    ]
    return values.groupBy(name).agg(*picks)


def long_metrics(category: str, row: DataFrame) -> DataFrame:
    """(category, metric, value) rows of a one-row table."""
    cols = row.columns
    doubles = row.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot([], cols, "metric", "value").select(F.lit(category).alias("category"), "metric", "value")


def summary_report(parts: dict[str, DataFrame]) -> DataFrame:
    """A13."""
    return reduce(DataFrame.unionByName, [long_metrics(k, v) for k, v in parts.items()])


def dashboard_rows(summary: DataFrame) -> DataFrame:
    """The summary with one decimal, as text."""
    return summary.withColumn("value", F.round("value", 1))


def dashboard_top(trends: DataFrame, keywords: DataFrame, k: int = 5, name: str = "name") -> DataFrame:
    """The first k names in order with their trend and three best keywords."""
    first = trends.orderBy(name).limit(k)
    three = F.array_join(F.slice(F.split("top_keywords", ", "), 1, 3), ", ")
    return first.join(keywords.select(name, three.alias("top_keywords")), name, "left").select(
        name, "total", "first_day", "last_day", F.coalesce("top_keywords", F.lit("")).alias("top_keywords")
    )


def url_report(log: DataFrame, url: str, status: str, seconds: str) -> DataFrame:
    """A14."""
    shown = F.coalesce(F.format_number(F.col(seconds), 2), F.lit("N/A"))
    return log.select(url, status, shown.alias("seconds"))


def context_report(pairs: DataFrame, contexts: DataFrame, keywords: DataFrame, trends: DataFrame, name: str = "name", url: str = "url") -> DataFrame:
    """(name, url, context, keywords, trend) for every page that mentions a name."""
    trend = F.concat(
        F.lit("Total mentions: "), F.col("total"), F.lit(", First mention: "), F.col("first_day"),
        F.lit(", Last mention: "), F.col("last_day"),
    )
    out = pairs.select(name, url).distinct().join(contexts.select(name, url, "context"), [name, url], "left")
    out = out.join(keywords.select(name, "top_keywords"), name, "left").join(trends.select(name, trend.alias("trend")), name, "left")
    return out.select(
        name,
        url,
        F.coalesce("context", F.lit("No specific context found")).alias("context"),
        F.coalesce("top_keywords", F.lit("No keyword data available")).alias("keywords"),
        F.coalesce("trend", F.lit("No trend data available")).alias("trend"),
    )


def combine_snippets(hits: DataFrame, company: str, rank: str, title: Column, url: Column, snippet: Column, search_cap: int | None = None) -> DataFrame:
    """One text per company from all its hits in rank order, or from the first ``search_cap`` ranks."""
    block = F.concat(F.lit("Title: "), title, F.lit("\nURL: "), url, F.lit("\nSnippet: "), snippet, F.lit("\n\n"))
    kept = hits if search_cap is None else hits.filter(F.col(rank) <= search_cap)
    rows = kept.select(company, rank, block.alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct(rank, "b")))
    grouped = rows.groupBy(company).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("body"))
    head = F.concat(F.lit("General information for "), F.col(company).cast("string"), F.lit(":\n\n"))
    return grouped.select(company, F.concat(head, "body").alias("combined"))


def missing_fields(columns: dict[str, str]) -> Column:
    """Which of the gap fields are blank; ``columns`` maps field to column."""
    tests = [
        F.when(is_blank(F.col(columns[f])) if f in columns else F.lit(True), F.lit(f)) for f in rules.GAP_FIELDS
    ]
    return F.array_compact(F.array(*tests))


def result_stats(df: DataFrame, raw: Column, clean: Column) -> DataFrame:
    """A19."""
    sums = df.agg(F.count(F.lit(1)).alias("results"), F.sum(raw).alias("raw_length"), F.sum(clean).alias("clean_length"))
    reduction = F.round((F.col("raw_length") - F.col("clean_length")) / F.greatest(F.lit(1), F.col("raw_length")) * 100, 2)
    return sums.withColumn("reduction", reduction)


def error_classes(log: DataFrame, message: str) -> DataFrame:
    """A21."""
    kind = F.when(contains_any(F.lower(message), rules.TRANSIENT_ERRORS), "transient").otherwise("permanent")
    return log.groupBy(kind.alias("error_class")).agg(F.count(F.lit(1)).alias("errors"))
