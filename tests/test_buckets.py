import pathlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievework.sources import tables
from sievework.streaming import feeds

T0 = datetime(2024, 1, 1)
SESSIONS = "session_id string, status string, data string, updated_at timestamp"


def sessions(spark, names, status, day=0):
    return spark.createDataFrame([(n, status, None, T0 + timedelta(days=day)) for n in names], SESSIONS)


def files_of(folder):
    return {str(p) for p in pathlib.Path(folder).rglob("*.parquet")}


def statuses(spark, root):
    rows = tables.read_kv(spark, root, "sessions").collect()
    assert len(rows) == len({r["session_id"] for r in rows})
    return {r["session_id"]: r["status"] for r in rows}


def test_a_write_leaves_other_buckets_alone(spark, tmp_path):
    root, names = str(tmp_path), [f"s{n}" for n in range(200)] + [None]
    assert statuses(spark, root) == {}
    tables.write_kv(spark, root, "sessions", sessions(spark, names, "old"))
    before = files_of(tmp_path)
    change = sessions(spark, ["s3", "new", None], "changed", 1)
    hit = {f"bucket={r[0]}" for r in change.select(tables.bucket_of(["session_id"], tables.KV_BUCKETS)).collect()}
    for _ in range(2):  # run again, as a micro-batch may be
        tables.write_kv(spark, root, "sessions", change)
        assert statuses(spark, root) == {**dict.fromkeys(names, "old"), "s3": "changed", "new": "changed", None: "changed"}
    after = files_of(tmp_path)
    assert {f for f in before if not hit & set(pathlib.Path(f).parts)} <= after
    assert {pathlib.Path(f).parent.name for f in before ^ after} <= hit
    tables.write_kv(spark, root, "sessions", change.limit(0))
    assert files_of(tmp_path) == after


def test_a_write_that_stopped_half_way_loses_nothing(spark, tmp_path):
    root = str(tmp_path)
    tables.write_kv(spark, root, "sessions", sessions(spark, ["a", "b", "c", "d"], "old"))
    staged = sessions(spark, ["a", "b"], "new", 1).withColumn("bucket", tables.bucket_of(["session_id"], tables.KV_BUCKETS))
    staged.write.partitionBy("bucket").parquet(f"{root}/sessions.next")
    for bucket in tables.touched(staged)[:1]:  # the old files of a bucket are gone, the new ones not there yet
        for file in (tmp_path / "sessions" / f"bucket={bucket}").glob("*.parquet"):
            file.unlink()
    want = {"a": "new", "b": "new", "c": "old", "d": "old"}
    assert statuses(spark, root) == want
    tables.write_kv(spark, root, "sessions", sessions(spark, ["e"], "old"))
    assert statuses(spark, root) == {**want, "e": "old"}
    # a staged write without its mark has not happened
    sessions(spark, ["a"], "half", 2).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{root}/sessions.next")
    (tmp_path / "sessions.next" / "_SUCCESS").unlink()
    assert statuses(spark, root) == {**want, "e": "old"}
    tables.write_kv(spark, root, "sessions", sessions(spark, ["f"], "old"))
    assert statuses(spark, root) == {**want, "e": "old", "f": "old"}


def test_feed_reads_and_writes_buckets_of_its_names(spark, tmp_path):
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "`Company Name` string, pos long, name_bucket string"
    first = [(f"Firm {n}", n, "own") for n in range(100)] + [(None, 100, "own"), ("  ", 101, "own")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)

    def go():
        feeds.run_to_end(feeds.company_feed(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "log")))

    go()
    before = files_of(target)
    spark.createDataFrame([("FIRM 7 ", 200, ""), ("Other", 201, ""), ("other", 202, "")], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    got = [r["Company Name"] for r in spark.read.parquet(target).collect()]
    assert sorted(got) == sorted([f"Firm {n}" for n in range(100)] + ["Other"])
    assert before <= files_of(target) and len(files_of(target) - before) == 1
