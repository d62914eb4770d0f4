"""Nothing is dropped by default: inputs above every limit that a service may have."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from sievework.operators import extract, keys, model, reports
from sievework.sources import tables


def test_all_snippets_are_combined(spark):
    hits = spark.range(150).select(F.lit("x").alias("c"), (F.col("id") + 1).alias("rank"), F.col("id").cast("string").alias("s"))
    parts = [hits, "c", "rank", F.col("s"), F.lit("u"), F.lit("t")]
    assert reports.combine_snippets(*parts).first().combined.count("Title: ") == 150
    assert reports.combine_snippets(*parts, search_cap=100).first().combined.count("Title: ") == 100


def test_context_of_long_pages(spark):
    text = "a " * 70_000 + "Acme makes things " + "b " * 100
    mentions, pages = spark.createDataFrame([("Acme", "u")], "name string, url string"), spark.createDataFrame([("u", text)], "url string, content string")
    assert "**Acme**" in extract.mention_context(mentions, pages).first().context
    assert "skipped" in extract.mention_context(mentions, pages, max_content=1000).first().context


def test_all_keywords_of_long_contexts(spark):
    words = [f"keyword{c}" for c in "abcdefgh"]
    rows = spark.createDataFrame([(1, "Acme", "x " * 6000 + " ".join(words), " ".join(words))], "id int, name string, context string, query string")
    got = extract.keyword_relevance(rows, "name", "context", F.col("query"), ["id"]).collect()
    assert {r.keyword for r in got} >= set(words)
    assert extract.keyword_relevance(rows, "name", "context", F.col("query"), ["id"], most=5).count() == 5
    assert [r.keyword for r in extract.keyword_relevance(rows, "name", "context", F.col("query"), ["id"], max_context=10_000).collect()] == ["relevant"]


def test_whole_threads(spark):
    rows = "".join(f'<tr class="athing comtr"><td><div class="comment">comment {i} {"w " * 600}</div></td></tr>' for i in range(70))
    pages = spark.createDataFrame([(1, f"<html><head><title>A talk</title></head><body><table>{rows}</table></body></html>")], "page int, html string")
    assert extract.extract_forum_thread(pages, "page").first().thread_text.count("comment ") == 70
    assert extract.extract_forum_thread(pages, "page", talk=20).first().thread_text.count("comment ") == 20


def test_hits_and_batches_above_the_old_limits(spark):
    hits = spark.range(300).select(F.lit("q").alias("q"), (F.col("id") + 1).alias("rank"), F.concat(F.lit("u"), "id").alias("url"), F.lit(None).cast("string").alias("link"))
    assert tables.search_hits(hits, limit=250).count() == 250
    assert keys.limit_per_query(hits, "q", "rank", batch=8, max_results=20).count() == 16


def test_every_piece_of_a_long_text_is_asked_about(spark):
    text = "x" * 39_000 + " founded 1987. " + "y" * 500
    got = model.extract_structured(spark.createDataFrame([(1, "s", text)], "c int, s string, t string"), "c", "s", "t", ["Founded Year"], model.rule_model)
    assert [r.value for r in got.collect()] == ["1987"]

    def short_only(prompts):
        return [model.rule_model([p])[0] if len(p) < 6000 else "too long" for p in prompts]

    got = model.extract_structured(spark.createDataFrame([(1, "s", text)], "c int, s string, t string"), "c", "s", "t", ["Founded Year"], short_only)
    assert [r.value for r in got.collect()] == ["1987"]


@pytest.mark.parametrize("wanted", [0, 9, 10, 37])
def test_every_name_of_a_group_can_be_chosen(spark, wanted):
    group = spark.createDataFrame([(0, i, f"name{i:02}") for i in range(38)], "leader long, id long, name string")

    def pick(prompts):
        return [f"name{wanted:02}" if f"name{wanted:02}" in p else p.rsplit(", ", 1)[-1] for p in prompts]

    assert [tuple(r) for r in model.choose_names(group, group, pick).collect()] == [(0, f"name{wanted:02}")]


def test_one_object_goes_to_the_first_index(spark):
    rows = spark.createDataFrame([(i, json.dumps({"n": i})) for i in range(5)], "i long, record string")
    got = model.validate_companies(rows, "i", "record", "q", lambda prompts: ['{"n": 99}'] * len(prompts))
    assert {r.i: json.loads(r.record)["n"] for r in got.collect()} == {0: 99, 1: 1, 2: 2, 3: 3, 4: 4}


def test_answers_that_change_remove_and_add_records(spark):
    rows = spark.createDataFrame([(i, json.dumps({"n": i})) for i in range(10)], "i long, record string")

    def model_of(prompts):
        return ["Sure: " + json.dumps([{"n": r["n"] * 10} for r in json.loads(p.split("RECORDS: ")[1])] + [{"n": 77}]) + " as asked" for p in prompts]

    got = sorted(json.loads(r.record)["n"] for r in model.validate_companies(rows, "i", "record", "q", model_of).collect())
    assert got == sorted([i * 10 for i in range(10)] + [77, 77])


def test_a_broken_table_raises(spark, tmp_path):
    row = spark.createDataFrame([("k", "running", "{}")], "session_id string, status string, data string").withColumn("updated_at", F.current_timestamp())
    tables.write_kv(spark, str(tmp_path), "sessions", row)
    assert tables.read_kv(spark, str(tmp_path), "sessions").count() == 1
    for file in (tmp_path / "sessions").rglob("*.parquet"):
        file.write_bytes(b"no table")
    for crc in (tmp_path / "sessions").rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(Py4JJavaError):
        tables.read_kv(spark, str(tmp_path), "sessions").count()


def test_totals_of_a_hot_key_are_joined_in_several_tasks(spark):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        chunks = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("doc"), F.sha2(F.col("id").cast("string"), 256).alias("chunk"))
        placed = keys.chunk_positions(chunks, "doc", "chunk").withColumn("p", F.spark_partition_id())
        got = placed.groupBy("p").agg(F.max("chunk"), F.count_if(F.col("doc") == 0).alias("hot"), F.max("total_chunks").alias("most")).filter("hot > 0").collect()
        assert len(got) > 1 and sum(r.hot for r in got) == max(r.most for r in got)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_repeated_index_still_gives_batches_of_five(spark):
    sizes = spark.sparkContext.accumulator(0)

    def counting(prompts):
        for prompt in prompts:
            records = json.loads(prompt.split("RECORDS: ", 1)[1])
            assert len(records) <= 5
            sizes.add(len(records))
        return ["no answer"] * len(prompts)

    rows = spark.range(203).select(F.lit(7).cast("long").alias("i"), F.format_string('{"n": %d}', "id").alias("record"))
    got = model.validate_companies(rows, "i", "record", "q", counting)
    assert got.count() == 203 and sizes.value >= 203
