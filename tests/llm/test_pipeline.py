import pathlib
from collections import Counter

import pytest
from test_decontamination import plain_leaks
from test_mixing_and_sharding import plain_shards, plain_targets, size

import __spark_entry__ as registry
import corpus_pipeline
from sievework.llm import quality
from tools.compare import plain

TABLES = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    """A corpus with junk, copies, near copies, benchmark passages, nulls and repeated rows."""
    rows = [[i, prose(i, 60 + i % 50), "en", f"s{i % 3}"] for i in range(150)]
    rows += [[200 + i, prose(i, 60 + i % 50), "en", "s0"] for i in range(10)]
    rows += [[300 + i, prose(20 + i, 60 + (20 + i) % 50).replace("w1", "v1", 1), "en", "s1"] for i in range(10)]
    rows += [[400 + i, prose(400 + i, 40) + "\n" + prose(9000 + i % 2, 30), "en", "s2"] for i in range(8)]
    rows += [[500, "too short", "en", "s0"], [501, "same words again " * 30, "en", "s0"], [502, prose(5, 60).replace(" ", "### "), "en", "s1"], [503, None, None, None], [504, "", "en", "s0"]]
    rows += [[600, prose(600, 70), None, None], [600, prose(600, 70), None, None], [None, prose(601, 70), "en", "s1"]]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, prose(9000 + i, 30)) for i in range(2)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def plain_groups(docs):
    """The least id of each class of texts with the same words or a Jaccard similarity of 0.8 or more."""
    sets = []
    for d in docs:
        w = (d.text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return [min(g, key=lambda d: (d.doc_id is None, d.doc_id or 0)) for g in groups.values()]


def test_each_stage_agrees_with_its_plain_version(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        kept.append(docs.collect())
        docs = spark.createDataFrame(kept[-1], docs.schema)
    raw = spark.read.parquet(f"{folder}/documents.parquet").collect()
    good = [d for d in raw if (c := quality.counts_of(d.text or ""))[0] >= 10 and 5 * c[4] <= c[0] and "###" not in d.text]
    assert Counter(kept[0]) == Counter(good)
    assert Counter(kept[1]) == Counter(plain_groups(kept[0]))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {i for i, _ in plain_leaks([(d.doc_id, d.text) for d in kept[1]], items)}
    assert leaked == set(range(400, 408)) and Counter(kept[2]) == Counter(d for d in kept[1] if d.doc_id not in leaked)
    sizes, got = Counter(), Counter()
    for d in kept[2]:
        sizes[d.source] += size(d.text)
    for d in kept[3]:
        got[d.source] += size(d.text)
    assert all(abs(got[s] - goal) <= 60 for s, goal in plain_targets(sizes).items()) and set(kept[3]) <= set(kept[2])
    placed = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    want = plain_shards([(d.doc_id, d.text, d.source) for d in kept[3]], corpus_pipeline.SHARDS)
    assert sorted(((repr(d.doc_id), d.shard, d.slot) for d in placed), key=repr) == sorted(((r[0], *r[3:]) for r in want), key=repr)


def test_run_and_its_query(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == [*COLUMNS, "shard", "slot"]
    got = rows.collect()
    assert max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) <= 1
    assert sorted(registry.queries()["pipeline"](spark, folder).collect(), key=repr) == sorted(got, key=repr)


@pytest.mark.skipif(not pathlib.Path(TABLES).exists(), reason="no test tables here")
@pytest.mark.parametrize("key", [k for k in registry.oracle_sql() if k.startswith("op")])
def test_query_agrees_with_sql(spark, key):
    import duckdb

    con = duckdb.connect()
    for path in pathlib.Path(TABLES).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got, want = registry.queries()[key](spark, TABLES).toPandas(), con.execute(registry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in registry.queries() if k.startswith("op") and k[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in registry.queries()
