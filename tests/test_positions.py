import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import keys, windows
from sievework.operators.positions import in_ranges, with_neighbours, with_position


def skewed(n=600):
    """A third of all rows belong to one key; some keys are NULL; times repeat."""
    rng = random.Random(7)
    return [("hot" if i % 3 == 0 else rng.choice(["a", "b", None, f"k{i}"]), rng.randrange(80), i) for i in range(n)]


def grouped(rows):
    out = {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(key, []).append((t, i))
    return out


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_positions_per_key(spark, buckets):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = {r["i"]: r["pos"] for r in with_position(df, "t", ["k"], ["i"], buckets=buckets).collect()}
    assert got == {i: n for group in grouped(rows).values() for n, (_, i) in enumerate(group, 1)}


def test_global_positions_and_batches(spark):
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(range(10_000), 500)], "t long")
    rows = with_position(df, "t").orderBy("t").collect()
    assert [r["pos"] for r in rows] == list(range(1, 501))
    sizes = [r["count"] for r in keys.batch_ids(df, "t", 64).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [64] * 7 + [52]


def test_rows_without_order_are_kept_and_come_last(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (3, 3), (None, 4)], "t int, i int")
    rows = {r["i"]: r["pos"] for r in with_position(df, "t", ties=["i"]).collect()}
    assert rows == {3: 1, 2: 2, 1: 3, 4: 4}


def test_string_order_and_empty(spark):
    words = ["pear", "apple", "äpfel", "Zebra", "apple pie", "", "applf"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r["w"] for r in with_position(df, "w", buckets=5).orderBy("pos").collect()]
    assert got == sorted(words, key=lambda w: w.encode())
    assert with_position(df.filter("false"), "w").count() == 0


@pytest.mark.parametrize("value", ["F.lit(7)", "F.when(F.col('id') % 10 > 0, 7).otherwise(F.col('id'))", "F.concat(F.lit('Customer#00000'), F.col('id'))"])
def test_ranges_are_even(spark, value):
    df = spark.range(40_000).withColumn("t", eval(value))
    ranged = in_ranges(df, [F.col("t"), F.xxhash64("t", "id")], 8)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 40_000 / 8
    pos = with_position(df, "t", ties=["id"], buckets=8)
    assert [r["t"] for r in pos.orderBy("pos").select("t").collect()] == [r["t"] for r in df.orderBy("t", "id").select("t").collect()]


def test_descending_puts_rows_without_order_first(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (3, 3), (5, 1), (None, 0)], "t int, i int")
    rows = {(r["t"], r["i"]): r["pos"] for r in with_position(df, "t", ties=["i"], descending=True, buckets=3).collect()}
    assert rows == {(None, 0): 1, (None, 1): 2, (5, 1): 3, (5, 2): 4, (3, 3): 5}


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_neighbours_across_blocks(spark, block):
    rows = skewed(200)
    df = spark.createDataFrame(rows, "k string, t int, i int")
    out = with_neighbours(df, "t", ["k"], {"p": "i"}, {"n": "i"}, ["i"], block=block)
    got = {r["i"]: (r["p"], r["n"]) for r in out.collect()}
    want = {}
    for group in grouped(rows).values():
        ids = [None, *[i for _, i in group], None]
        want |= {ids[j]: (ids[j - 1], ids[j + 1]) for j in range(1, len(ids) - 1)}
    assert got == want


@pytest.mark.parametrize("block", [5, 9, 1000])
def test_rolling_mean_across_blocks(spark, block):
    rows = skewed(200)
    df = spark.createDataFrame(rows, "k string, t int, i int").withColumn("v", F.col("i").cast("double"))
    got = {r["i"]: r["rolling"] for r in windows.rolling_mean(df, ["k"], "t", "v", ties=["i"], block=block).collect()}
    for group in grouped(rows).values():
        ids = [i for _, i in group]
        for n, i in enumerate(ids):
            want = sum(ids[n - 4 : n + 1]) / 5 if n >= 5 else None
            assert got[i] == pytest.approx(want) if want is not None else got[i] is None


def test_trailing_minute_over_block_borders(spark):
    times = [0, 10, 59, 60, 3590, 3600, 3601, 3648, 3649, 3650, 7200, 7200]
    df = spark.createDataFrame([("k", t) for t in times], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = {r["second"]: r["trailing"] for r in windows.calls_in_last_minute(df, "k", "ts", 2).collect()}
    assert got == {t: sum(1 for u in times if t - 59 <= u <= t) for t in times}


def test_first_and_last_per_key(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, t int, i int")
    first = {r["k"]: r["i"] for r in keys.first_per_key(df, ["k"], F.struct("t", "i")).collect()}
    last = {r["k"]: r["i"] for r in keys.last_per_key(df, ["k"], F.struct("t", "i")).collect()}
    assert first == {k: g[0][1] for k, g in grouped(rows).items()}
    assert last == {k: g[-1][1] for k, g in grouped(rows).items()}
