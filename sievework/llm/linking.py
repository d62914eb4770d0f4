"""Connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import released, stored

#: Links (16 bytes each) that one task settles by itself; more are settled by rounds of all tasks.
PER_TASK = 1_000_000


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        for ends in (x, y, low[x], low[y]):  # ends, and what they hang on
            np.minimum.at(new, ends, least)
        new = new[new]
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def _ends(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in ("a", "b")]


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes, b < a: those of each Arrow batch hang on the least node that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes, low = settled(*_ends(batch))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != low]), pa.array(low[nodes != low])], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _whole(links: DataFrame) -> DataFrame:
    """The stars of all links, in one task; for a bounded number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            nodes, low = settled(*_ends(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "root"])

    return links.coalesce(1).mapInArrow(run, "node long, root long")


def _to_least(links: DataFrame, pick: Column) -> DataFrame:
    """Links of each node's picked neighbours, and of the node, to the least of all of them."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "of")
    held = links.join(least, F.col("a").eqNullSafe(F.col("of")))  # each side dealt out by itself, so that a hub can be split
    return held.filter(pick).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("of", "m")).filter("a <> b")


def components(links: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, root): the least node that each node of the links (a, b) reaches; nodes without a link aren't listed.

    Ids are long numbers. Each task turns what it holds into stars first, so links that repeat or that go round a family are
    few after that. Up to ``per_task`` links are settled by one task; more by large-star and small-star steps in turn, whose number grows
    with the logarithm of a component's width and which are written down one by one. Links to oneself, repeated ones and either
    direction are fine; an empty table gives no rows.
    """
    kept = stored(stars(links.filter("a <> b")).distinct())
    n, seen = kept.count(), None
    while n > per_task:
        both = kept.union(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, F.col("b") > F.col("a")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = stored(_to_least(large, F.lit(True)).distinct())
        now = tuple(new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        released(kept)
        kept, n = new, now[0]
        if now == seen:
            return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).union(kept.select(F.col("b"), F.col("b")).distinct())
        seen = now
    found = stored(_whole(kept))
    released(kept)
    return found
