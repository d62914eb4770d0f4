"""First/last row per key, batches, limits and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.positions import with_position


def _pick(df: DataFrame, keys: list[str | Column], pick, order: Column) -> DataFrame:
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    columns = df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    grouped = df.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(named)])
    return grouped.agg(pick(row, order).alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def first_per_key(df: DataFrame, keys: list[str | Column], order: str | Column) -> DataFrame:
    """An aggregate, so each map task keeps one row per key before the shuffle."""
    return _pick(df, keys, F.min_by, F.col(order) if isinstance(order, str) else order)


def last_per_key(df: DataFrame, keys: list[str | Column], order: str | Column) -> DataFrame:
    """W02."""
    return _pick(df, keys, F.max_by, F.col(order) if isinstance(order, str) else order)


def limit_per_key(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rn") -> DataFrame:
    """At most ``k`` rows per key. Spark cuts each map task to ``k`` rows per key first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def limit_per_query(hits: DataFrame, query: str, rank: str, batch: int = 5, max_results: int = 10) -> DataFrame:
    """min(batch, max) hits per slice, two slices per query."""
    size = min(batch, max_results)
    kept = limit_per_key(hits, [query], [rank], 2 * size)
    return kept.withColumn("slice", F.floor((F.col("rn") - 1) / size).cast("int"))


def batch_ids(df: DataFrame, order: str, size: int | None = None, out: str = "batch") -> DataFrame:
    """Contiguous slices; the default size is n/5 within 1..10."""
    if size is None:
        size = max(1, min(10, df.count() // 5))
    placed = with_position(df, order, out="_pos")
    return placed.withColumn(out, F.floor((F.col("_pos") - 1) / size).cast("long")).drop("_pos")


def take_until_sufficient(
    df: DataFrame, good: Column, order: str, minimum: int = 10, maximum: int | None = None
) -> DataFrame:
    """Good rows in order, until there are enough."""
    return df.filter(good).orderBy(order).limit(max(minimum, maximum or 0))


def top_by_priority(df: DataFrame, priority: Column, order: str, n: int | None = None) -> DataFrame:
    """By priority, ties in input order; ``n`` rows when given."""
    ranked = df.orderBy(priority.desc(), F.asc(order))
    return ranked if n is None else ranked.limit(n)


def chunk_positions(chunks: DataFrame, doc: str, index: str) -> DataFrame:
    """Total per document joined back; a document with a third of all chunks is no hot task."""
    return join_totals(chunks, chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("total_chunks")), [doc])


def join_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the totals of their keys, null keys too.

    The totals come out of an aggregate on the same keys. A plain join would reuse that shuffle, and then
    the optimizer cannot split a key that has most rows. The null-safe one gives both sides a
    shuffle of their own, so it can.
    """
    named = totals.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in totals.columns if c not in keys])
    same = [df[f"`{k}`"].eqNullSafe(named[f"_key{i}"]) for i, k in enumerate(keys)]
    joined = df.join(named, reduce(Column.__and__, same))
    return joined.drop(*[f"_key{i}" for i in range(len(keys))])
