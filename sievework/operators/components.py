"""Connected components of links, and what a task can settle by itself beforehand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import cut


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each reaches over the links a-b: hooks and pointer jumps, in arrays."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def forest(links: DataFrame) -> DataFrame:
    """Fewer links that connect the same nodes: each Arrow batch of (a, b) becomes stars around its least nodes."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes, root = _roots(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")))
                far = nodes != root
                yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], names=["a", "b"])

    return links.select("a", "b").mapInArrow(shrink, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the links (a, b) reaches. Nodes without a link aren't listed.

    Large-star and small-star steps in turn: each node's neighbours are linked to the least one
    of them. A node's least neighbour is an aggregate, so a hub costs one row for each map task;
    the join that follows can be split by the optimizer. The rounds grow with the logarithm of a
    component's width. Each round is checkpointed, so a lost executor repeats one round at most.
    An empty table gives no rows; links to oneself, repeated links and either direction are fine. Ids that
    are long numbers are shrunk to stars in each task first.
    """
    links = links.select("a", "b")
    links = cut((forest(links) if {t for _, t in links.dtypes} == {"bigint"} else links).filter("a <> b").distinct())
    while True:
        large = _star(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), F.col("b") > F.col("a"))
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), F.lit(True))
        new = cut(small.filter("a <> b").distinct())
        if links.count() == new.count() and new.exceptAll(links).isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(new.select(F.col("b"), F.col("b")).distinct())
        links = new


def _star(links: DataFrame, pick) -> DataFrame:
    """Links of each node's picked neighbours, and of the node itself, to the least of all of them."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = links.join(least, "a")
    return joined.filter(pick).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b")
