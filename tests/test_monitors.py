import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.catalog.streams import ROCKSDB
from sievework.streaming import feeds, monitors

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
DAY = 86400
SAMPLES = "host string, metric string, ts timestamp, order long, value double"
PHASES = "run string, ts timestamp, order long, phase string"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, folder, rows, schema, monitor, name, **how):
    """All rows of ``rows`` (lists, one micro-batch each) through a monitor: what it gave, and where its state is."""
    source, out, log = (str(folder / f"{name}-{part}") for part in ("in", "out", "log"))
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = monitor(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), **how)
    feeds.run_to_end(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log), 120)
    return spark.read.schema(stream.schema).parquet(out).collect(), log


def runs_of(rows, idle_days, until):
    """Rows of settled days by key in time order, cut where a key has been without rows."""
    by_key = defaultdict(list)
    there = [r for r in rows if r[1] is not None and (r[1] // DAY + 1) * DAY <= until]
    for row in sorted(there, key=lambda r: (r[1], r[2] is not None, r[2] or 0, str(r[3]))):
        by_key[row[0]].append(row)
    for key, found in by_key.items():
        current = []
        for row in found:
            if current and row[1] // DAY - current[-1][1] // DAY > idle_days:
                yield key, current
                current = []
            current.append(row)
        yield key, current


def at(second):
    return None if second is None else START + timedelta(seconds=second)


def test_rolling_monitor_is_the_sequential_loop(spark, tmp_path, rocksdb):
    rng = random.Random(4)
    rows = [("hot" if n % 3 else f"m{n % 5}", rng.randrange(9 * DAY), n % 4, rng.choice([None, 1.0, 2.5, 7.0])) for n in range(300)]
    rows += [("m1", 40, None, 3.0), ("m1", 40, None, 3.0), ("m2", None, 1, 1.0), ("gone", 5, 1, 1.0), ("gone", 8 * DAY, 1, 2.0), ("end", 10 * DAY, 0, 0.0)]
    rng.shuffle(rows)
    got, _ = run(spark, tmp_path, [[("h", m, at(s), o, v) for m, s, o, v in rows]], SAMPLES, monitors.rolling_monitor, "mean", late="0 seconds", idle="3 days")
    want = []
    for key, found in runs_of(rows, 3, 10 * DAY):
        values = [r[3] for r in found]
        for i, row in enumerate(found):
            known = [v for v in values[max(0, i - 4) : i + 1] if v is not None]
            want.append((key, row[1], row[3], round(sum(known) / len(known), 9) if i >= 5 and known else None))
    plain = [(r["metric"], int((r["ts"].replace(tzinfo=timezone.utc) - START).total_seconds()), r["value"], None if r["rolling"] is None else round(r["rolling"], 9)) for r in got]
    assert len(want) > 250 and sorted(plain, key=str) == sorted(want, key=str)


def test_phases_end_over_micro_batches_and_late_rows_stay_out(spark, tmp_path, rocksdb):
    first = [("a", 10, 0, "x"), ("a", 20, 0, "x"), ("a", 15, 0, None), ("b", 5, 0, "x"), ("a", 2 * DAY, 0, "y"), ("z", 3 * DAY, 0, "q")]
    second = [("a", 30, 0, "late"), ("a", 3 * DAY + 7, 0, "z"), ("b", 4 * DAY, 0, "y"), ("z", 5 * DAY, 0, "q")]
    batches = [[(k, at(s), o, p) for k, s, o, p in part] for part in (first, second)]
    got, _ = run(spark, tmp_path, batches, PHASES, monitors.phase_monitor, "phase", late="0 seconds", idle="2 days")
    plain = sorted((r["run"], r["phase"], int((r["since"].replace(tzinfo=timezone.utc) - START).total_seconds()), r["seconds"]) for r in got)
    assert plain == [("a", "x", 10, 2 * DAY - 10.0), ("a", "y", 2 * DAY, DAY + 7.0)]


def test_dead_keys_leave_the_state(spark, tmp_path, rocksdb):
    old = [(f"k{n}", at(n), 0, "x") for n in range(20)]
    batches = [old, [("alive", at(9 * DAY), 0, "x")], [("alive", at(10 * DAY), 0, "y")], [("alive", at(11 * DAY), 0, "x")]]
    _, log = run(spark, tmp_path, batches, PHASES, monitors.phase_monitor, "dead", late="0 seconds", idle="3 days")
    for name in ("current", "settled"):
        left = spark.read.format("statestore").option("stateVarName", name).load(log)
        assert {r[0] for r in left.select(F.col("key.run")).collect()} == {"alive"}


class CountedState:
    """The part of a state handle that the monitors use, with the number of its calls."""

    def __init__(self, calls):
        self.calls, self.there = calls, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("getMapState", "getValueState"):
                return CountedState(self.calls)
            key = args[0] if name in ("getValue", "updateValue", "removeKey", "containsKey") else None
            if name in ("exists", "containsKey"):
                return key in self.there
            if name in ("get", "getValue"):
                return self.there.get(key)
            if name in ("update", "updateValue"):
                self.there[key] = args[-1]
            if name in ("clear", "removeKey"):
                self.there.pop(key, None)

        return call


def test_calls_to_the_state_do_not_grow_with_the_slices_of_a_key():
    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    calls = []
    monitor = monitors.PhaseTracker(DAY * 1000, 2 * DAY * 1000)
    monitor.init(CountedState(calls))
    rows = pd.DataFrame({"at": [n * DAY * 10**6 + 5 for n in range(30)], "order": 0, "phase": ["x", "y"] * 15})
    monitor.handleInputRows(("a",), iter([rows]), Times(0))
    out = pd.concat(monitor.handleExpiredTimer(("a",), Times(29 * DAY * 1000), Times(DAY * 1000)))
    assert list(out["seconds"]) == [DAY] * 28 and len(calls) < 30


def test_an_empty_stream_gives_no_rows(spark, tmp_path, rocksdb):
    assert run(spark, tmp_path, [[]], SAMPLES, monitors.rolling_monitor, "none")[0] == []
