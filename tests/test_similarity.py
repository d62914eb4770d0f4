import itertools
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import leaders, names
from sievework.operators import similarity as sim
from sievework.session import cut as session_cut


def greedy(n, similar):
    """Sequential leader grouping: {item: leader}."""
    owner = {}
    for i in range(n):
        if i in owner:
            continue
        owner[i] = i
        for j in range(i + 1, n):
            if j not in owner and similar(i, j):
                owner[j] = i
    return owner


@pytest.mark.parametrize("seed,density", [(1, 0.02), (2, 0.1), (3, 0.4), (4, 0.0)])
def test_greedy_groups_on_random_graphs(spark, seed, density):
    rng, n = random.Random(seed), 60
    edges = {(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < density}
    nodes = spark.range(n).toDF("id")
    table = spark.createDataFrame(sorted(edges), "low long, high long")
    got = {r["id"]: r["leader"] for r in leaders.greedy_leader_groups(nodes, table).collect()}
    assert got == greedy(n, lambda i, j: (i, j) in edges)


def test_a_long_chain_takes_a_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(leaders, "cut", lambda df: rounds.append(1) or session_cut(df))
    n = 100_000
    table = spark.range(n - 1).select(F.col("id").alias("low"), (F.col("id") + 1).alias("high")).repartition(4)
    taken = leaders.members_of(table)
    assert taken.count() == n // 2 and taken.filter("id % 2 = 0").isEmpty()
    assert len(rounds) < 20


@pytest.mark.parametrize("in_one_task", [0, 3, 10**6])
def test_large_components_go_on_in_rounds(spark, in_one_task):
    edges = {(i, i + 1) for i in range(20)} | {(30 + i, 31 + i) for i in range(3)} | {(50, 60), (50, 70), (60, 70)}
    got = {r.id for r in leaders.members_of(spark.createDataFrame(sorted(edges), "low long, high long"), 1, in_one_task).collect()}
    owner = greedy(80, lambda i, j: (i, j) in edges)
    assert got == {i for i, o in owner.items() if i != o}


NAMES = (
    "acme robotics|acme robotic|acmee robotics|robotics acme|tide|diet|ac|abc|bc|abd|x|xy|yx|xyz|beta labs|beta lab|betalabs inc|"
    "gamma ray systems|gamma-ray system|gama ray systems|delta|deltas|delta s|omega works|omega worx|omega wrks|north wind|nort wind|"
    "north winds|ünïcode|unicode|ünïcodé|aaaaaa|aaaaa|aaaaaaaa|abababab|babababa|ababab"
).split("|")


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def some_names(seed):
    rng = random.Random(seed)
    out = list(NAMES)
    for _ in range(60):
        w = list(rng.choice(NAMES))
        for _ in range(rng.choice([1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w.insert(k, rng.choice("abcxyz "))
            elif len(w) > 1:
                w.pop(min(k, len(w) - 1))
        out.append("".join(w))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_edges_equal_all_pairs(spark, seed):
    words = some_names(seed)
    df = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    got = {(r["low"], r["high"]) for r in sim.fuzzy_edges(df, "id", "name").collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if ratio(words[i], words[j]) >= 0.8}
    assert got == want


@pytest.mark.parametrize("waves", [1, 3])
def test_group_names(spark, waves):
    words = [w for w in some_names(3) if w.strip()]
    words += ["Acme Robotics Inc.", "ACME-Robotics", "日本", "東京"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    got = {r["id"]: (r["leader"], r["kind"]) for r in names.group_names(df, "id", "name", waves=waves).collect()}
    import re

    clean = {}
    for i, w in enumerate(words):
        c = re.sub(r"\s+Inc\.?$", "", w, flags=re.I)
        clean[i] = re.sub(r"\s+", " ", re.sub("['\"`]", "", c)).strip()
    key = {i: re.sub("[^a-z0-9]", "", c.lower()) for i, c in clean.items()}
    counts = {}
    for i in clean:
        counts.setdefault(key[i], []).append(i)
    singles = [i for i in clean if len(counts[key[i]]) == 1]
    owner = greedy(len(singles), lambda a, b: ratio(clean[singles[a]].lower(), clean[singles[b]].lower()) >= 0.8)
    size = {}
    for a, b in owner.items():
        size[b] = size.get(b, 0) + 1
    want = {i: (min(g), "exact") for g in counts.values() if len(g) > 1 for i in g}
    want |= {singles[a]: (singles[b], "fuzzy" if size[b] > 1 else "single") for a, b in owner.items()}
    assert got == want


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def texts(seed, n=80):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 25))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        if rng.random() < 0.6 and len(words) > 3:
            words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
        out.append(" ".join(words))
    return out + ["", "a of", out[0], out[0]]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.85])
def test_jaccard_edges_equal_all_pairs(spark, threshold):
    rows = texts(5)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    sets = sim.keyword_sets(df, "id", F.filter(F.split("text", " "), lambda w: w != ""))
    got = {(r["low"], r["high"]) for r in sim.jaccard_edges(sets, threshold).collect()}
    words = [set(t.split()) for t in rows]
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if jaccard(words[i], words[j]) > threshold}
    assert got == want


def test_one_shared_rare_token_makes_no_candidate(spark):
    one, two = [f"a{i}" for i in range(19)], [f"b{i}" for i in range(19)]
    rows = [(1, ["rare", *one]), (2, ["rare", *two]), (3, [*one, "more"])] + [(i, one + two + [f"{i}x{j}" for j in range(60)]) for i in (9, 10, 11)]
    sets = sim.distinct_sets(sim.keyword_sets(spark.createDataFrame(rows, "id long, words array<string>"), "id", F.col("words"))).localCheckpoint()
    first = sim.rare_prefixes(sets, 0.85, sim.token_counts(sets))
    assert {r["id"]: r["count"] for r in first.groupBy("id").count().collect()} == {1: 4, 2: 4, 3: 4, 9: 15, 10: 15, 11: 15}
    assert {tuple(r) for r in sim._postings_join(first, first, 0.85).collect()} == {(1, 3)}
    assert [(r["low"], r["high"]) for r in sim.jaccard_edges(sets, 0.85).collect()] == [(1, 3)]


@pytest.mark.parametrize("waves", [1, 3])
def test_dedupe_jaccard(spark, waves):
    rows = [" ".join("key" + w for w in t.split()) for t in texts(6)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = {r["id"] for r in sim.dedupe_jaccard(df, "id", "text", 0.6, waves).collect()}
    words = [{w for w in t.split()} for t in rows]
    owner = greedy(len(rows), lambda i, j: jaccard(words[i], words[j]) > 0.6)
    assert got == {i for i, o in owner.items() if i == o}


def vectors(seed, n=120, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    out = []
    for _ in range(n):
        v = [c + rng.gauss(0, 0.35) for c in rng.choice(centres)]
        size = math.sqrt(sum(x * x for x in v))
        out.append([x / size for x in v])
    return out + [out[0], out[5], out[5]]


@pytest.mark.parametrize("block", [4, 1000])
def test_embedding_edges_equal_all_pairs(spark, block):
    rows = vectors(1)[:-3]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
    got = {(r["low"], r["high"]) for r in sim.embedding_between(df, df, 0.85, block, 5).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if dot(rows[i], rows[j]) > 0.85}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("waves", [1, 3])
def test_dedupe_embedding(spark, waves):
    rows = vectors(2)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
    got = {r["id"] for r in sim.dedupe_embedding(df, "id", "v", 0.85, waves).collect()}
    owner = greedy(len(rows), lambda i, j: sum(x * y for x, y in zip(rows[i], rows[j])) > 0.85)
    assert got == {i for i, o in owner.items() if i == o}


def greedy_clusters(rows, k):
    """The sequential rule: (cluster, row with most words) for each, over all pairs."""
    words = [set(t.split()) for t in rows]
    left, found = set(range(len(rows))), []
    for cluster in range(k):
        near = {i: {j for j in left if (i == j and words[i]) or jaccard(words[i], words[j]) > 0.3} for i in left}
        if not any(near.values()):
            break
        best = min(left, key=lambda i: (-len(near[i]), i))
        found.append((cluster, min(near[best], key=lambda i: (-len(words[i]), i))))
        left -= near[best]
    return found


@pytest.mark.parametrize("first_look", [1, 5, 1000])
def test_cluster_simple(spark, first_look):
    rows = [" ".join("key" + w for w in t.split()) for t in texts(9, 40)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, q string")
    got = [(r["cluster"], r["id"]) for r in sim.cluster_simple(df, "id", "q", 4, first_look=first_look).orderBy("cluster").collect()]
    assert got == greedy_clusters(rows, 4)


def test_clusters_of_blank_queries(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the of")], "id long, q string")
    assert sim.cluster_simple(df, "id", "q").collect() == [] == sim.cluster_simple(df.limit(0), "id", "q").collect()
    one = df.unionByName(spark.createDataFrame([(4, "alpha beta"), (5, "beta alpha")], df.schema))
    assert [tuple(r) for r in sim.cluster_simple(one, "id", "q").collect()] == [(0, 4, "alpha beta")]


def test_degree_bounds_hold(spark):
    r = random.Random(6)
    rows = [set(r.sample([f"w{i}" for i in range(40)], r.randint(1, 12))) | ({"hot"} if i % 3 else set()) for i in range(120)]
    data = [(i, sorted(ws), len(ws), 1 + i % 3) for i, ws in enumerate(rows)]
    ranked = sim.rare_first(spark.createDataFrame(data, "id long, tokens array<string>, n int, weight long").drop("weight"))
    ranked = ranked.withColumn("weight", 1 + F.col("id") % 3)
    bounds = {b["id"]: b["bound"] for b in sim.degree_bounds(ranked, 0.3).collect()}
    for i, words in enumerate(rows):
        assert bounds[i] >= sum(1 + j % 3 for j, other in enumerate(rows) if jaccard(words, other) > 0.3)


def test_links_of_a_large_family_are_not_listed(spark, monkeypatch):
    """One family of 100 and 150 of five: the family wins, and few of the small ones are ever compared."""
    rows = [f"fam core base xx{i}" for i in range(100)] + [f"aa{g} bb{g} cc{g} y{g}n{i}" for g in range(150) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, q string")
    compared, real = [], sim.neighbours
    monkeypatch.setattr(sim, "neighbours", lambda some, *rest: compared.append(some.count()) or real(some, *rest))
    got = [(c["cluster"], c["id"]) for c in sim.cluster_simple(df, "id", "q", 1).orderBy("cluster").collect()]
    assert got == greedy_clusters(rows, 1) and sum(compared) <= 102


def dense_vectors(rows):
    """Unit TF-IDF rows of (id, query) over all words, with plain arrays."""
    words = [[w for w in (q or "").lower().split() if w != "the"] for _, q in rows]
    terms = sorted({w for ws in words for w in ws})
    tf = np.array([[ws.count(t) for t in terms] for ws in words], float).reshape(len(rows), len(terms))
    x = tf * np.log((len(rows) + 1) / ((tf > 0).sum(axis=0) + 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return words, x / np.where(norm > 0, norm, 1)


@pytest.mark.parametrize("k", [1, 3, 6])
def test_kmeans_equals_dense_arithmetic(spark, k):
    r = random.Random(k)
    topics = [[f"{t}word{i}" for i in range(6)] for t in "abcd"]
    rows = [(i, " ".join(r.choice(topics[i % 4]) for _ in range(4)) + " the common") for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(30)] + [(200, None), (201, ""), (201, "common")]
    df = spark.createDataFrame(rows, "id long, query string").repartition(3)
    words, x = dense_vectors(rows)
    nodes, vectors = sim.tfidf(df, "id", "query")
    chosen = sim.first_centres(nodes, vectors, k, 42)
    assert len(set(chosen)) == k and chosen == sim.first_centres(*sim.tfidf(df.repartition(5), "id", "query"), k, 42)
    firsts = {n["node"]: n["row"]["id"] for n in nodes.collect()}
    at = {i: n for n, (i, _) in reversed(list(enumerate(rows)))}
    centres = np.array([x[at[firsts[n]]] for n in chosen])
    last = math.inf
    while True:
        gaps = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        own = np.argmin(np.round(gaps, 9), axis=1)
        inertia = gaps[np.arange(len(rows)), own].sum()
        if inertia >= last * (1 - 1e-9):
            break
        last = inertia
        centres = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    got = {g["cluster"]: g["id"] for g in sim.cluster_kmeans(df, "id", "query", k).collect()}
    assert set(got) == set(own.tolist())
    for j, i in got.items():
        inside = [round(gaps[n, j], 9) for n in range(len(rows)) if own[n] == j]
        assert round(gaps[at[i], j], 9) == min(inside) and own[at[i]] == j


def test_kmeans_of_few_queries_or_none(spark):
    df = spark.createDataFrame([(1, "red paint"), (2, "red paint"), (3, "blue glass")], "key long, query string")
    assert sorted(r["key"] for r in sim.cluster_kmeans(df, "key", "query", 5).collect()) == [1, 3]
    none = sim.cluster_kmeans(df.limit(0), "key", "query", 5)
    assert none.count() == 0 and none.columns == ["cluster", "key", "query"]


@pytest.mark.parametrize("side", [24, 40, 65_536])
def test_embedding_edges_of_several_parts_and_two_tables(spark, side):
    rows = vectors(3)[:-3]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if dot(rows[i], rows[j]) > 0.6}
    df = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
    got = [(r["low"], r["high"]) for r in sim.embedding_between(df, df, 0.6, 8, 3, side).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    early, late = df.filter("id < 40"), df.filter("id >= 40")
    got = [(r["low"], r["high"]) for r in sim.embedding_between(early, late, 0.6, 8, 3, side).collect()]
    assert sorted(got) == sorted((i, j) for i, j in want if i < 40 <= j)


def test_embedding_edges_send_a_vector_a_bounded_number_of_times(spark):
    """Blocks of 2 rows meet within a task; so vectors are dealt out to parts, not to every block."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(640)], "id long, v array<double>")
    found = sim.embedding_between(df, df, 0.9, 2, 4)
    node = found._jdf.queryExecution().analyzed()
    while "RepartitionByExpression" not in node.nodeName():
        node = node.children().head()
    held = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node)
    assert held.count() <= 640 * (sim.SIDES + 4)
