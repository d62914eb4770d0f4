"""Places and prefix sums within groups in a random order, without sorting a group in one task.

The order is that of a random digest, so its leading digits deal all rows, those of a hot group
too, evenly over buckets. A bucket is sorted by itself; what lies before it in each group is
summed over the small table of (group, bucket) totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(seed: str, value: Column) -> Column:
    """Hex digest of seed and value: 128 random bits that any engine can work out again."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary"))


def unit(hexdigest: Column) -> Column:
    """The first 32 bits of a digest, as a number."""
    return F.conv(F.substring(hexdigest, 1, 8), 16, 10).cast("long")


def ranks(rows: DataFrame, narrow: DataFrame, group: str, key: str, ties: list[str], weight: str, buckets: int) -> DataFrame:
    """Adds ``_rank`` (from 0), ``_before`` (weight before the row), ``_rows`` and ``_weight`` of its group.

    ``rows`` are ordered by ``key``, then ``ties``; ``narrow`` holds the same rows with at least
    group, key and weight, and is read for the totals. Rows alike in key and ties may change places.
    """
    bucket = F.shiftright(unit(F.col(key)) * buckets, 32)
    local = Window.partitionBy("_bucket", group).orderBy(key, *ties)
    placed = rows.withColumn("_bucket", bucket)
    placed = placed.withColumn("_rank", F.row_number().over(local).cast("long") - 1)
    placed = placed.withColumn("_before", F.sum(weight).over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
    totals = narrow.groupBy(F.col(group).alias("_of"), bucket.alias("_in")).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    whole, so_far = Window.partitionBy("_of"), Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_of", "_in",
        F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_rank0"), F.coalesce(F.sum("_w").over(so_far), F.lit(0)).alias("_before0"),
        F.sum("_n").over(whole).alias("_rows"), F.sum("_w").over(whole).alias("_weight"),
    )
    joined = placed.join(starts, (F.col("_bucket") == F.col("_in")) & (F.col(group) == F.col("_of")))
    joined = joined.withColumn("_rank", F.col("_rank") + F.col("_rank0")).withColumn("_before", F.col("_before") + F.col("_before0"))
    return joined.drop("_of", "_in", "_bucket", "_rank0", "_before0")
