from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievework import rules
from sievework.operators import joins, model
from sievework.sources import companies as files
from sievework.sources import tables
from sievework.streaming import feeds


def test_company_feed_skips_known_names_and_can_be_rerun(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "`Company Name` string, pos long"
    spark.createDataFrame([("Acme", 1), ("acme ", 2), ("Beta", 3), (" ", 4)], schema).coalesce(1).write.parquet(source)
    for n in range(2):
        stream = spark.readStream.schema(schema).parquet(source)
        feeds.run_to_end(feeds.company_feed(stream, target, str(tmp_path / f"log{n}")))
    spark.createDataFrame([("BETA", 5), ("Gamma", 6)], schema).coalesce(1).write.mode("append").parquet(source)
    feeds.run_to_end(feeds.company_feed(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "log1")))
    assert sorted(r["Company Name"] for r in spark.read.parquet(target).collect()) == ["Acme", "Beta", "Gamma"]


def test_call_rate_counts_every_window(spark, tmp_path):
    source = str(tmp_path / "in")
    seconds = [0, 5, 59, 61, 300]
    rows = spark.createDataFrame([("k", s) for s in seconds], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(source)
    out = feeds.call_rate(spark.readStream.schema("key string, ts timestamp").parquet(source), "key", "ts", "0 seconds", "60 seconds", "30 seconds")
    path = str(tmp_path / "out")
    feeds.run_to_end(out.writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "log")))
    got = {int(r["from_ts"].timestamp()): r["calls"] for r in spark.read.parquet(path).collect()}
    want = {}
    for start in range(-30, 240, 30):
        n = sum(1 for s in seconds if start <= s < start + 60)
        if n:
            want[start] = n
    assert {k: v for k, v in got.items() if k < 180} == {k: v for k, v in want.items() if k < 180}


def test_kv_tables_keep_the_last_write(spark, tmp_path):
    root, ts = str(tmp_path), datetime(2024, 1, 1)
    rows = [("s", "a", "1", ts), ("s", "b", "2", ts), ("s", "a", "3", ts + timedelta(days=1))]
    schema = "session_id string, metric_name string, metric_value string, updated_at timestamp"
    tables.write_kv(spark, root, "metrics", spark.createDataFrame(rows, schema))
    tables.write_kv(spark, root, "metrics", spark.createDataFrame([("s", "b", "9", ts)], schema))
    got = {r["metric_name"]: r["metric_value"] for r in tables.read_kv(spark, root, "metrics").collect()}
    assert got == {"a": "3", "b": "9"}


def test_append_counts_and_merge_keeps_blanks(spark, tmp_path):
    target = str(tmp_path / "target")
    df = spark.createDataFrame([("A", 1), ("a ", 2), ("", 3), ("B", 4)], "`Company Name` string, pos int")
    assert files.append_to_target(spark, df, target, "pos", "run 1") == 2
    assert files.append_to_target(spark, df, target, "pos", "run 2") == 0
    known = spark.createDataFrame([("A", 0)], "`Company Name` string, pos int")
    merged = joins.merge_append(df, known, "Company Name", "pos", "f.csv").collect()
    assert sorted((r["Company Name"], r["source_file"] or "") for r in merged) == [("", "f.csv"), ("A", ""), ("B", "f.csv")]


def test_csv_checks_and_export(spark, tmp_path):
    assert files.validate_company_csv(spark, "") == ["no path given"]
    assert files.validate_company_csv(spark, str(tmp_path / "nope"))[0].startswith("file not found")
    path = tmp_path / "in.csv"
    path.write_text('Name,Location\n"Acme, Inc",Oslo\n  ,x\n')
    assert files.validate_company_csv(spark, str(path)) == []
    assert [r["Company Name"] for r in files.read_companies(spark, str(path)).collect()] == ["Acme, Inc"]
    out = files.export_rows(files.read_companies(spark, str(path)).withColumn("Original URL", F.lit("u")))
    assert out.columns == rules.EXPORT_COLUMNS
    row = out.first()
    assert (row["Company Name"], row["Location"], row["Source URL"], row["Funding"]) == ("Acme, Inc", "Oslo", "u", "")


def test_latest_checkpoint_and_resume(spark):
    paths = ["o/a_discovery_20240101_000000.csv", "o/a_discovery_batch2_20240301_000000.csv", "o/a_enrichment_20250101_000000.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert files.latest_checkpoint(df, "discovery").first()[0] == paths[1]
    empty = spark.createDataFrame([], "`Company Name` string, `Founded Year` string")
    some = spark.createDataFrame([("A", " ")], empty.schema)
    assert [files.resume_phase(d).first()[0] for d in (empty, some, some.withColumn("Founded Year", F.lit("1999")))] == ["discovery", "enrichment", "validation"]


def test_model_failures_stay_in_their_row(spark):
    def moody(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("service said no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id int, p string").coalesce(1)
    got = {r["id"]: (r["answer"], r["error"]) for r in model.ask(df, F.col("p"), moody).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "service said no"), 3: ("FINE", None)}


def test_overlay_by_index(spark):
    original = spark.createDataFrame([(i, f"o{i}") for i in range(5)], "i long, v string")
    chunks = spark.createDataFrame(
        [(0, True, [0, 1], ["n0", "", "extra"]), (1, False, [2], ["lost"]), (2, True, [4], ["n4"])], "chunk int, ok boolean, indices array<long>, values array<string>"
    )
    got = sorted((r["i"] if r["i"] is not None else 99, r["v"]) for r in joins.overlay_by_index(original, "i", chunks, "v").collect())
    assert got == [(0, "n0"), (2, "o2"), (3, "o3"), (4, "n4"), (99, "extra")]


def test_merge_facts_takes_the_first_filled_source(spark):
    rows = [("a", "Location", " ", 1), ("a", "Location", "Oslo", 3), ("a", "Location", "Rome", 2), ("b", "Location", None, 1)]
    df = spark.createDataFrame(rows, "company string, field string, value string, priority int")
    got = {r["company"]: r["location"] for r in joins.merge_facts(df, ["Location"]).collect()}
    assert got == {"a": "Rome", "b": None}


def test_json_export_is_one_object_per_company(spark, tmp_path):
    import json

    rows = [("A", "1990", "Oslo", "x", 1), ("A", "1991", None, "y", 2), ("B", None, "Rome", None, 3)]
    df = spark.createDataFrame(rows, "`Company Name` string, `Founded Year` string, Location string, `Team Size` string, pos int")
    path = str(tmp_path / "json")
    files.export_companies_json(df.withColumn("confidence", F.lit(0.5)), "pos", path)
    got = {}
    for r in spark.read.text(path).collect():
        got |= json.loads(r[0])
    assert got == {
        "A": {"basic_info": {"founded_year": "1991"}, "detailed_info": {"team_size": "y"}, "meta": {"confidence": "0.5"}},
        "B": {"basic_info": {"location": "Rome"}, "detailed_info": {}, "meta": {"confidence": "0.5"}},
    }


def test_checkpoints_are_found_by_folder(spark, tmp_path):
    df = spark.createDataFrame([("A",), ("B",)], "`Company Name` string")
    old = files.write_checkpoint(df, str(tmp_path / "run"), "discovery", stamp="20240101_000000")
    new = files.write_checkpoint(df, str(tmp_path / "run"), "discovery", 2, "20240102_000000")
    found = files.checkpoint_paths(spark, str(tmp_path / "run_*"))
    assert sorted(r["path"].split("/")[-1] for r in found.collect()) == sorted(p.split("/")[-1] for p in (old, new))
    assert files.latest_checkpoint(found, "discovery").first()[0].endswith(new.split("/")[-1])


def test_hits_meet_one_copy_of_a_page(spark):
    hits = spark.createDataFrame([("https://a.org/x?ref=1",), ("https://A.org/x",)], "url string")
    pages = spark.createDataFrame([("https://a.org/x/", "p1"), ("https://a.org/x", "p2"), ("https://b.org", "p3")], "url string, html string")
    assert [r["html"] for r in joins.hits_with_pages(hits, pages).collect()] == ["p2", "p2"]


def test_counters_reach_the_listener(spark, tmp_path):
    import time

    folder = str(tmp_path / "in")
    for rows in ([("found", 1), ("found", 2), ("kept", 3)], [("kept", 4)]):
        spark.createDataFrame(rows, "stage string, id int").coalesce(1).write.mode("append").parquet(folder)
    listener = feeds.CounterListener()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("stage string, id int").option("maxFilesPerTrigger", 1).parquet(folder)
        counted = feeds.observed_counters(stream, "funnel", "stage", ["found", "kept"])
        feeds.run_to_end(counted.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")), 60)
        until = time.time() + 30
        while listener.totals.get("funnel", {}).get("rows") != 4 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals["funnel"] == {"rows": 4, "found": 2, "kept": 2}
    assert listener.latest["funnel"] in ({"rows": 1, "found": 0, "kept": 1}, {"rows": 3, "found": 2, "kept": 1})


def test_a_large_batch_goes_to_the_model_in_pieces(spark):
    df = spark.range(0, 1000, numPartitions=1).select("id", F.array("id").alias("kept"), F.col("id").cast("string").alias("p"))
    got = model.ask(df, F.col("p"), lambda prompts: [f"{p} of {len(prompts)}" for p in prompts]).collect()
    assert [(r["id"], r["kept"], r["answer"].split(" of ")[0], r["error"]) for r in got] == [(n, [n], str(n), None) for n in range(1000)]
    assert max(int(r["answer"].split(" of ")[1]) for r in got) <= 256
