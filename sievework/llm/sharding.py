"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import buckets_for, cut, group_key, named, renamed
from sievework.llm.ranks import digest, ranks, unit

SEED = "shard-1"


def shard(docs: DataFrame, shards: int = 8, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: all columns) with size, text_crc32, shard (from 0) and slot (from 0, gapless in each shard).

    Rows of a source are ranked in the order of a seeded digest of the id; rank r of n rows lies at
    (r + u) / n, where u is a digest of the source between 0 and 1, so that small sources don't
    meet in the middle. All rows in that order are cut into shards of equal row counts, at most
    one apart, so every shard has each source's share of rows, at most about one row off.

    Places in the whole order come from equal-width ranges of that fraction: a range is sorted
    by itself, and only one count for each range is summed up. Null and empty texts have size 1
    and checksum 0; a null source is a source; repeated rows may change places.
    """
    content = F.coalesce(named(text), F.lit(""))
    made = [
        group_key(named(source)).alias("_g"), digest(seed, named(doc_id)).alias("_key"), F.crc32(content.cast("binary")).alias("_crc"),
        (F.octet_length(content).cast("long") + 1).alias("_size"), F.lit(1).cast("long").alias("_one"),
    ]
    kept = docs.columns if carry is None else carry
    narrow = cut(docs.select(*made))
    rows = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)], *made) if kept else narrow
    total = narrow.count()
    buckets = buckets_for(docs, total)
    ties = ["_crc", "_size"]
    phase = unit(digest(seed, F.col("_g"))) / F.lit(float(1 << 32))
    lie = ((F.col("_rank") + phase) / F.col("_rows")).alias("_at")
    order = Window.partitionBy("_range").orderBy("_at", "_g", "_key", *ties)
    ranked = ranks(rows, narrow, "_g", "_key", ties, "_one", buckets).withColumn("_at", lie).withColumn("_range", F.floor(F.col("_at") * buckets))
    small = ranks(narrow, narrow, "_g", "_key", ties, "_one", buckets).select(F.floor(lie * buckets).alias("_r"))
    so_far = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).select("_r", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_start"))
    placed = ranked.withColumn("_pos", F.row_number().over(order).cast("long") - 1)
    placed = placed.join(starts, F.col("_range") == F.col("_r")).withColumn("_pos", F.col("_pos") + F.col("_start"))
    placed = placed.withColumn("_shard", F.expr(f"(_pos * {shards}L) div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(_shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    placed = placed.withColumn("_slot", (F.col("_pos") - first).cast("long"))
    made = {"_size": "size", "_crc": "text_crc32", "_shard": "shard", "_slot": "slot"}
    return placed.select(*renamed(kept, list(made.values())), *[F.col(c).alias(name) for c, name in made.items()])
