"""Joins, merges and keyed upserts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import rules
from sievework.functions import urls
from sievework.functions.text import is_blank, strip
from sievework.operators.keys import first_per_key, last_per_key


def trimmed_key(name: Column) -> Column:
    return F.lower(strip(name))


def hits_with_pages(hits: DataFrame, pages: DataFrame, url: str = "url", order: str | Column | None = None) -> DataFrame:
    """Inner join on the normalised URL. A page is repeated for each of its hits; see :func:`pages_of_hits`."""
    left, right = pages_of_hits(hits, pages, url, order)
    return left.join(right, "url_norm")


def pages_of_hits(hits: DataFrame, pages: DataFrame, url: str = "url", order: str | Column | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """J01 in two parts: the hits with ``url_norm``, and the pages that some hit names, one for each ``url_norm``.

    Pages that no hit names are left out before anything else, so only those are compared. The first row per URL
    by ``order`` stays (by default the smallest raw URL and page), so that many copies of one page
    never multiply with its hits.
    With ``parts`` pages and URLs are dealt to so many partitions and merged, whatever size the optimizer expects.
    """
    left = hits.withColumn("url_norm", urls.normalize_url(F.col(url)))
    named = left.select("url_norm").distinct()
    right = pages.withColumn("url_norm", urls.normalize_url(F.col("url")))
    if parts is not None:
        named, right = (df.repartition(parts, "url_norm") for df in (left.select("url_norm"), right))
        named = named.distinct().hint("merge")
    right = right.join(named, "url_norm", "left_semi")
    if order is None:
        order = F.struct("url", F.xxhash64(*[c for c in pages.columns if c != "url"]))
    return left, first_per_key(right, ["url_norm"], order).drop("url")


def only_new(new: DataFrame, known: DataFrame, key_new: Column, key_known: Column) -> DataFrame:
    """Rows whose key is not known yet."""
    return new.withColumn("_k", key_new).join(known.select(key_known.alias("_k")), "_k", "left_anti").drop("_k")


def with_cache(items: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached results, and ``compute`` on the misses only."""
    hits = items.select(*keys).join(cache, keys)
    misses = compute(items.join(cache.select(*keys), keys, "left_anti"))
    return hits.unionByName(misses, allowMissingColumns=True)


def overlay(original: DataFrame, changed: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Changed values over the original ones; of several changes the last counts."""
    last = last_per_key(changed, [key], order).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = original.join(last, key, "left")
    values = {c: F.coalesce(f"_{c}", c) for c in columns}
    return joined.withColumns(values).drop(*[f"_{c}" for c in columns])


def overlay_by_index(original: DataFrame, index: str, chunks: DataFrame, value: str) -> DataFrame:
    """(index, value). ``chunks(chunk, ok, indices array<long>, values array<string>)``.

    The i-th value of a chunk replaces the original at the i-th index; further values are
    appended after the last original; failed chunks and blank values are left out.
    """
    rows = chunks.filter("ok").select("chunk", "indices", F.posexplode("values").alias("i", "_v"))
    rows = rows.withColumn("_at", F.get("indices", F.col("i")))
    placed = rows.filter(F.col("_at").isNotNull()).groupBy(F.col("_at").alias(index))
    placed = placed.agg(F.max_by("_v", F.struct("chunk", "i")).alias("_v"))
    kept = original.select(index, value).join(placed, index, "left").select(index, F.coalesce("_v", value).alias(value))
    extra = rows.filter(F.col("_at").isNull()).select(F.lit(None).cast("long").alias(index), F.col("_v").alias(value))
    return kept.unionByName(extra).filter(~is_blank(F.col(value)))


def stage_membership(events: DataFrame, name: str = "name", stage: str = "stage") -> DataFrame:
    """One row per name, Yes/No per stage; eliminated = potential but not final."""
    flags = {s: F.bool_or(F.col(stage) == s) for s in rules.MEMBERSHIP_STAGES if s != "Eliminated"}
    wide = events.groupBy(name).agg(*[v.alias(k) for k, v in flags.items()])
    wide = wide.withColumn("Eliminated", F.col("Potential") & ~F.col("Final"))
    return wide.select(name, *[F.when(F.col(s), "Yes").otherwise("No").alias(rules.snake(s)) for s in rules.MEMBERSHIP_STAGES])


def rows_of_names(names: DataFrame, rows: DataFrame, name_key: Column, row_key: Column, order: str, last: bool = False) -> DataFrame:
    """The first (or last) original row of each canonical name."""
    pick = last_per_key if last else first_per_key
    keyed = rows.withColumn("_k", row_key)
    one = pick(keyed, ["_k"], order)
    return names.withColumn("_k", name_key).join(one, "_k").drop("_k")


def name_in_url(df: DataFrame, name: str, url: str) -> DataFrame:
    """Candidates of one company row whose URL holds the name."""
    return df.filter(F.contains(F.lower(url), F.lower(F.col(name))))


def merge_facts(facts: DataFrame, fields: list[str], company: str = "company") -> DataFrame:
    """First non-blank value by source priority; ``facts(company, field, value, priority)``.

    One aggregate over (company) with one ``min_by`` per field; blanks carry no priority.
    """
    usable = ~is_blank(F.col("value"))
    picks = [
        F.min_by("value", F.when(usable & (F.col("field") == f), F.col("priority"))).alias(rules.snake(f)) for f in fields
    ]
    return facts.groupBy(company).agg(*picks)


def union_by_key_set(frames: list[DataFrame], first: str | None = None) -> DataFrame:
    """Rows of all frames under the union of their columns, ``first`` first, rest sorted."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    rest = sorted(c for c in merged.columns if c != first)
    return merged.select(*([first] if first else []), *[F.col(f"`{c}`") for c in rest])


def append_new(results: DataFrame, target: DataFrame, name: str, order: str, batch_info: str) -> DataFrame:
    """Rows to append: named, not in the target, first of the batch; tagged."""
    named = results.filter(~is_blank(F.col(name)))
    fresh = only_new(named, target, trimmed_key(F.col(name)), trimmed_key(F.col(name)))
    return first_per_key(fresh, [trimmed_key(F.col(name))], order).withColumn("batch_info", F.lit(batch_info))


def merge_append(source: DataFrame, target: DataFrame, name: str, order: str, source_file: str) -> DataFrame:
    """The whole new target. Known names are skipped, blank names are kept."""
    blank = is_blank(F.col(name))
    tagged = source.withColumn("source_file", F.lit(source_file))
    named = only_new(tagged.filter(~blank), target, trimmed_key(F.col(name)), trimmed_key(F.col(name)))
    fresh = first_per_key(named, [trimmed_key(F.col(name))], order).unionByName(tagged.filter(blank))
    return target.unionByName(fresh, allowMissingColumns=True)


def kv_upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write per key wins; null is a key as any other."""
    new = last_per_key(rows, keys, order)
    written = new.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return table.join(written, same, "left_anti").unionByName(new, allowMissingColumns=True)


def kv_lookup(table: DataFrame, wanted: DataFrame, keys: list[str], data: str = "data", schema: str = "map<string,string>") -> DataFrame:
    """Payload of the wanted keys, decoded."""
    return table.join(wanted.select(*keys), keys, "left_semi").withColumn(data, F.from_json(data, schema))


def kv_scan_expand(table: DataFrame, schema: str, overlay_columns: list[str], data: str = "data") -> DataFrame:
    """Every payload spread into columns, key columns on top of them."""
    parsed = table.withColumn("_p", F.from_json(data, schema))
    inner = [f for f in parsed.schema["_p"].dataType.names if f not in overlay_columns]
    return parsed.select(*overlay_columns, *[F.col(f"_p.`{f}`").alias(f) for f in inner])


def latest_session(sessions: DataFrame, ts: str = "ts", session: str = "session_id") -> DataFrame:
    """S20."""
    return sessions.orderBy(F.desc(ts), F.desc(session)).limit(1)
