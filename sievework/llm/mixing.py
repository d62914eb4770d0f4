"""Mixing sources to target weights: hash-random keys, prefix sums of sizes, exact cuts, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import buckets_for, cut, group_key, named, renamed, word_count
from sievework.llm.ranks import digest, ranks

SEED = "mix-1"
#: So many sources' targets go to every executor; more are joined by a shuffle.
FEW_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(_g, _size) of sources, with a ``target`` each.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes. No target is above ``most`` times its source's size: what is above goes to the others
    by weight. The level where that ends is found at once: with sources sorted by most * size / weight,
    the first k are full, where k is the first count whose level stays under the next source's ratio.
    The window without a partition runs over one row for each source.
    """
    turn = (F.row_number().over(Window.orderBy("_g")) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    weighed = weighed.withColumn("_cap", most * F.col("_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", "_g").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_ratio", "_g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full_size, full_w = F.coalesce(F.sum("_size").over(before), F.lit(0)), F.coalesce(F.sum("_w").over(before), F.lit(0))
    level = (share * F.sum("_size").over(everything) - most * full_size) / (F.sum("_w").over(everything) - full_w)
    levels = weighed.withColumn("_level", level).withColumn("_fits", F.col("_level") <= F.col("_ratio"))
    found = F.min(F.when(F.col("_fits"), F.struct("_ratio", "_g", "_level"))).over(everything)["_level"]
    return levels.withColumn("target", F.least(F.col("_cap"), F.coalesce(found * F.col("_w"), F.col("_cap")))).select("_g", "target")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: all columns) with size, source_size, target and taken (words that the mix takes).

    Every source takes its target's whole words exactly: whole epochs of the source, then its
    documents in the order of a seeded digest of the id, the last one in part. Null and empty
    texts have size 0 and are taken 0 words of; a null source is a source of its own, null ids share
    one place; rows with the same id and size may change places; an empty table gives no rows.
    """
    group, size, key = group_key(named(source)), word_count(named(text)), digest(seed, named(doc_id))
    made = [group.alias("_g"), size.alias("_s"), key.alias("_key")]
    kept = docs.columns if carry is None else carry
    narrow = cut(docs.select(*made))
    rows = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)], *made)
    sizes = narrow.groupBy("_g").agg(F.sum("_s").alias("_size"))
    goals = targets(sizes)
    placed = ranks(rows, narrow, "_g", "_key", ["_s"], "_s", buckets_for(docs, narrow.count()))
    budget, total = F.floor("target"), F.col("_weight")
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(0)
    rest = F.when(total > 0, budget - epochs * total).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("_s"), rest - F.col("_before")))
    mixed = placed.join(F.broadcast(goals) if sizes.count() <= FEW_SOURCES else goals, "_g").withColumn("_taken", (epochs * F.col("_s") + part).cast("long"))
    made = {"_s": "size", "_weight": "source_size", "target": "target", "_taken": "taken"}
    return mixed.select(*renamed(kept, list(made.values())), *[F.col(c).alias(name) for c, name in made.items()])


def mixed_rows(docs: DataFrame, *, text: str = "text", **names: str) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each whole time a document is taken.

    The one document that a source's cut goes through is kept whole if half of it or more is
    within the budget, so that no text is torn; documents that are not taken are left out.
    """
    mixed = mix(docs, text=text, **names)
    mixed = mixed.toDF(*[f"c{i}" for i in range(len(docs.columns))], *mixed.columns[len(docs.columns) :])
    copies: Column = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    repeated = mixed.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))))
    return repeated.select(*renamed(docs.columns, []))
