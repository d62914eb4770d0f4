"""Greedy leader grouping (D03) over a sparse edge table.

Going through items in order, an item that no earlier leader took becomes a leader and takes
every later similar item. The leaders are the lexicographically first maximal independent
set, so they can be found in parallel rounds instead of one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.components import components
from sievework.session import cut

ROWS_PER_FIRST_WAVE = 50_000


def members_of(edges: DataFrame, rounds: int = 4, in_one_task: int = 1_000_000) -> DataFrame:
    """Ids that some leader takes; ``edges`` has low < high.

    Each round: a node without an undecided lower neighbour leads and takes its neighbours. That settles all but
    long chains, which would need a round for every two links. After ``rounds`` rounds the rest is cut into its
    connected components; one of up to ``in_one_task`` edges is settled by the sequential rule in one task, and
    only larger ones go on in rounds.
    """
    left = cut(edges.select("low", "high").distinct())
    taken = left.select(F.col("low").alias("id")).limit(0)
    while not left.isEmpty():
        for _ in range(rounds):
            lead = left.select(F.col("low").alias("id")).distinct().join(left.select(F.col("high").alias("id")).distinct(), "id", "left_anti")
            new = cut(left.join(lead, left["low"] == lead["id"], "left_semi").select(F.col("high").alias("id")).distinct())
            taken = taken.unionByName(new)
            left = left.join(new, left["low"] == new["id"], "left_anti")
            left = cut(left.join(new, left["high"] == new["id"], "left_anti"))
            if left.isEmpty():
                return taken
        found = components(left.select(F.col("low").alias("a"), F.col("high").alias("b")))
        parted = cut(left.join(found, left["low"] == found["node"]).select("low", "high", "root"))
        small = parted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= in_one_task).select(F.col("root").alias("r"))
        kind = edges.schema["low"].dataType.simpleString()
        ready = parted.join(small, F.col("root") == F.col("r"), "left_semi")
        taken = taken.unionByName(cut(ready.groupBy("root").applyInPandas(_settle, f"id {kind}")))
        left = cut(parted.join(small, F.col("root") == F.col("r"), "left_anti").select("low", "high"))
    return taken


def _settle(edges: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule on all edges of a component."""
    taken: set = set()
    for low, high in edges.sort_values("low")[["low", "high"]].itertuples(index=False):
        if low not in taken:
            taken.add(high)
    return pd.DataFrame({"id": list(taken)}, dtype=edges["high"].dtype)


def greedy_leader_groups(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(node, leader). A member goes to its lowest adjacent leader."""
    edges = cut(edges.select("low", "high").distinct())
    members = members_of(edges)
    assigned = (
        edges.join(members.select(F.col("id").alias("high")), "high", "left_semi")
        .join(members.select(F.col("id").alias("low")), "low", "left_anti")
        .groupBy(F.col("high").alias(node))
        .agg(F.min("low").alias("leader"))
    )
    return nodes.select(node).join(assigned, node, "left").select(node, F.coalesce("leader", node).alias("leader"))


def wave_cuts(nodes: DataFrame, node: str = "id", waves: int | None = None) -> list:
    """Ids at 1/4, 1/16, ... of the order; none for small tables."""
    stats = nodes.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if waves is None:
        waves = 1
        while stats > ROWS_PER_FIRST_WAVE * 4 ** (waves - 1) and waves < 6:
            waves += 1
    if waves == 1 or not stats:
        return []
    shares = [4.0 ** -k for k in range(waves - 1, 0, -1)]
    found = nodes.agg(F.percentile_approx(node, F.lit(shares), 10000).alias("c")).first()["c"]
    return sorted(set(found))


def leaders_in_waves(
    nodes: DataFrame, between: Callable[[DataFrame, DataFrame], DataFrame], waves: int | None = None
) -> DataFrame:
    """Leaders of ``nodes(id, ...)``, found in waves of growing size.

    ``between(left, right)`` gives the edges (low, high) with low from ``left`` and high from
    ``right``. A dense family loses its members to its leader in an early, small wave, so the
    later waves never see its pairs; the result is the same for any number of waves.
    """
    bounds = [None, *wave_cuts(nodes, "id", waves), None]
    leaders = None
    for low, high in zip(bounds, bounds[1:]):
        part = nodes
        if low is not None:
            part = part.filter(F.col("id") > low)
        if high is not None:
            part = part.filter(F.col("id") <= high)
        if leaders is not None:
            absorbed = between(leaders, part).select(F.col("high").alias("id")).distinct()
            part = cut(part.join(absorbed, "id", "left_anti"))
        new = part.join(members_of(between(part, part)), "id", "left_anti")
        leaders = cut(new if leaders is None else leaders.unionByName(new))
    return leaders


def groups_in_waves(
    nodes: DataFrame, between: Callable[[DataFrame, DataFrame], DataFrame], waves: int | None = None
) -> DataFrame:
    """(id, leader) as in :func:`greedy_leader_groups`, with leaders found in waves."""
    if not wave_cuts(nodes, "id", waves):
        return greedy_leader_groups(nodes, between(nodes, nodes))
    leaders = leaders_in_waves(nodes, between, waves)
    others = nodes.join(leaders.select("id"), "id", "left_anti")
    owner = between(leaders, others).groupBy(F.col("high").alias("id")).agg(F.min("low").alias("leader"))
    return nodes.select("id").join(owner, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
