"""Row positions and bounded windows that stay balanced when one key holds most rows.

A plain window sorts a whole key in one task. Here all rows are range-partitioned by key, order and
ties, and at last by a hash of the row, so a key and even one order value is spread over ranges of
about equal size. Only one count per (key, range) is summed up to get the offset of each range.
Bounded frames (lag, lead, the last n rows) run on fixed-size blocks of positions with a few rows of overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import cut

BLOCK = 200_000


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp column, with or without a time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def in_ranges(df: DataFrame, by: list[Column], ranges: int | None = None, out: str = "_range") -> DataFrame:
    """Rows dealt to ranges of about equal size in the order ``by``, with the number of their range.

    Spark takes the bounds from a sample of whole values. The rows are written down, so that their ranges
    stay and the input is worked out twice only: for the sample and for the ranges.
    """
    if ranges is None:
        ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(ranges, *by).withColumn(out, F.spark_partition_id()))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def with_position(
    df: DataFrame,
    order: str,
    keys: list[str] | None = None,
    ties: list[str] | None = None,
    descending: bool = False,
    out: str = "pos",
    buckets: int | None = None,
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """1-based position of each row by ``order`` (then ``ties``), overall or per key.

    ``sums`` maps new columns to numeric columns: their sums over all rows before, 0 for the first one.

    Rows without an order value come last, or first when descending. Rows that are alike in order and ties
    stand in the order of a hash. The key is one struct, so that NULL keys match each other.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    marked = df.withColumns({"_group": group, "_same": F.xxhash64(*hashed)})
    first = F.desc_nulls_first(order) if descending else F.asc_nulls_last(order)
    by = [first, *[F.col(t) for t in ties or []], F.col("_same")]
    ranged = in_ranges(marked, [F.col("_group"), *by] if keys else by, buckets)
    added = {f"_sum{i}": column for i, column in enumerate((sums or {}).values())}
    sizes = ranged.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"{n}_all") for n, c in added.items()])
    # at most one row per range and key is summed up here
    ranges = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_range", *[F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(n) for n, c in [("_before", "_n"), *[(f"{n}_off", f"{n}_all") for n in added]]])
    inside = Window.partitionBy("_group", "_range").orderBy(*by)
    own = {n: F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n, c in added.items()}
    numbered = ranged.withColumns({"_rn": F.row_number().over(inside), **own})
    joined = numbered.join(offsets, ["_group", "_range"])
    joined = joined.withColumns({out: F.col("_before") + F.col("_rn"), **{name: F.col(n) + F.col(f"{n}_off") for name, n in zip(sums or {}, added)}})
    return joined.drop("_group", "_range", "_same", "_before", "_rn", *added, *[f"{n}_off" for n in added])


def in_blocks(
    df: DataFrame, pos: str, before: int = 0, after: int = 0, block: int = BLOCK
) -> DataFrame:
    """Add ``_block`` and ``_home``; rows near a border are copied into the next block."""
    if before >= block or after >= block:
        raise ValueError("a frame must be shorter than a block")
    slot = (F.col(pos) - 1) % block
    home = F.floor((F.col(pos) - 1) / block).cast("long")
    targets = F.array_compact(
        F.array(
            home,
            F.when(slot >= block - before, home + 1) if before else F.lit(None).cast("long"),
            F.when(slot < after, home - 1) if after else F.lit(None).cast("long"),
        )
    )
    return df.withColumns({"_at": home, "_block": targets}).withColumn("_block", F.explode("_block")).withColumn(
        "_home", F.col("_block") == F.col("_at")
    ).drop("_at")


def block_window(keys: list[str], pos: str) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy(pos)


def keep_home(df: DataFrame) -> DataFrame:
    return df.filter("_home").drop("_block", "_home")


def with_neighbours(
    df: DataFrame,
    order: str,
    keys: list[str],
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    ties: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """lag/lead by one row: ``previous``/``following`` map new columns to source columns."""
    placed = with_position(df, order, keys, ties, out="_pos")
    spread = in_blocks(placed, "_pos", before=1 if previous else 0, after=1 if following else 0, block=block)
    w = block_window(keys, "_pos")
    new = {n: F.lag(c).over(w) for n, c in (previous or {}).items()}
    new |= {n: F.lead(c).over(w) for n, c in (following or {}).items()}
    return keep_home(spread.withColumns(new)).drop("_pos")
