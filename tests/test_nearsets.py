import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import nearsets
from sievework.operators import similarity as sim
from sievework.session import cut


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def some_sets(seed, bases=25, copies=8, common=200):
    """Sets of 1 to 400 tokens with families of near copies; short ones share few tokens, so that parts agree by chance."""
    rng, out = random.Random(seed), []
    for base in range(bases):
        words = rng.sample(range(common if base % 2 else 40 * common), rng.choice([1, 3, 6, 7, 12, 20, 60, 150]))
        if base % 5 == 0:
            words = rng.sample(range(40 * common), 400)
        for _ in range(rng.randrange(1, copies)):
            kept = [w for w in words if rng.random() > rng.choice([0.0, 0.03, 0.08])] or words
            out.append(kept + [rng.randrange(40 * common) for _ in range(rng.choice([0, 0, 1, len(words) // 20]))])
    rng.shuffle(out)
    return list({tuple(sorted(set(x))): None for x in out})


def hashed(spark, rows, kind="long"):
    """Stored sets of token hashes from (id, words)."""
    df = spark.createDataFrame([(i, [str(w) for w in words]) for i, words in rows], f"id {kind}, words array<string>").repartition(3)
    return cut(sim.hashed(sim.keyword_sets(df, "id", F.col("words"))))


def edges_of(rows, threshold):
    return sorted((i, j) for i, j in itertools.combinations(range(len(rows)), 2) if jaccard(rows[i], rows[j]) > threshold)


@pytest.mark.parametrize("threshold,block,chunk", [(0.85, 512, 4096), (0.85, 2, 3), (0.7, 3, 4096), (0.95, 512, 5)])
def test_near_edges_equal_all_pairs(spark, monkeypatch, threshold, block, chunk):
    monkeypatch.setattr(nearsets, "BLOCK", block)
    monkeypatch.setattr(nearsets, "ROWS", chunk)
    rows = some_sets(int(threshold * 100) + block)
    got = nearsets.near_edges(hashed(spark, enumerate(rows)), threshold).collect()
    assert sorted((r.low, r.high) for r in got) == edges_of(rows, threshold)
    assert all(r.sim == jaccard(rows[r.low], rows[r.high]) for r in got)


def test_short_sets_of_a_small_vocabulary(spark):
    # empty parts are all that some of these share
    rows = list(itertools.combinations(range(9), 8)) + list(itertools.combinations(range(9), 7)) + [tuple(range(9))]
    got = nearsets.near_edges(hashed(spark, enumerate(rows)), 0.7).collect()
    assert sorted((r.low, r.high) for r in got) == edges_of(rows, 0.7)


def test_ids_of_text_twice_and_null(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [("b", base), ("a", base[:-1]), ("a", base[1:]), (None, base[2:]), ("c", base + ["x"])]
    got = nearsets.near_edges(hashed(spark, rows, "string"), 0.85).collect()
    # each of the two rows of a is near b and c; those of one id are not paired, and null is nobody's pair
    assert sorted((r.low, r.high) for r in got) == [("a", "b"), ("a", "b"), ("a", "c"), ("a", "c"), ("b", "c")]


def family(n, size=200, apart=3):
    rng = random.Random(n)
    return [tuple(rng.sample(range(size), size - apart)) + (10_000 + i,) for i in range(n)]


def test_pairs_of_a_family_are_not_listed_for_every_part(spark):
    rows = family(150)
    sets = hashed(spark, enumerate(rows))
    parts = cut(nearsets.repeated_parts(sets, 0.85))
    families = cut(nearsets.families_of(parts, 0.85))
    assert families.count() > 120
    listed = nearsets.sketched_pairs(parts, sets, families, 0.85).count()
    assert listed < 150 * 149 // 2 - len(list(itertools.combinations(range(families.count()), 2))) + 10
    assert nearsets.near_edges(sets, 0.85).count() == len(edges_of(rows, 0.85)) == 150 * 149 // 2


def test_at_a_high_threshold_no_tokens_are_joined(spark, monkeypatch):
    monkeypatch.setattr(sim, "_postings_join", lambda *a, **b: pytest.fail("candidates by single tokens grow with the square of the table"))
    rows = family(30)
    sets = hashed(spark, enumerate(rows))
    assert sim.jaccard_edges(sets, 0.85).count() == 30 * 29 // 2
    df = spark.createDataFrame([(i, " ".join(f"word{w}" for w in words)) for i, words in enumerate(rows)], "id long, text string")
    assert [r.id for r in sim.dedupe_jaccard(df, "id", "text", 0.85).collect()] == [0]


@pytest.mark.parametrize("waves", [1, 3])
def test_dedupe_by_parts_keeps_what_the_greedy_loop_keeps(spark, monkeypatch, waves):
    monkeypatch.setattr(nearsets, "BLOCK", 4)
    rows = some_sets(5, bases=40)
    df = spark.createDataFrame([(i, " ".join(f"word{w}" for w in words)) for i, words in enumerate(rows)] + [(9000, "")], "id long, text string")
    got = sorted(r.id for r in sim.dedupe_jaccard(df, "id", "text", 0.75, waves).collect())
    kept = []
    for i in range(len(rows)):
        if not any(jaccard(rows[i], rows[j]) > 0.75 for j in kept):
            kept.append(i)
    assert got == [*kept, 9000]


def test_tokens_are_worked_out_once(spark):
    df = spark.createDataFrame([(1, "some long words"), (2, "some long words"), (3, "")], "id long, text string")
    sets = sim.distinct_sets(sim.keyword_sets(df, "id", F.split("text", " ")))
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    # nothing is filtered below the aggregate, where it would need the tokens
    assert "Filter" not in plan[plan.index("Aggregate") :], plan
    assert sorted(r.id for r in sets.collect()) == [1, 3]  # the split of an empty text is one empty word


def test_sketches_differ_in_no_more_bits_than_sets_in_tokens(spark):
    rng = random.Random(3)
    sizes = [3, 60, 64, 65, 70, 128, 130, 1000, 1100]
    rows = [rng.sample(range(3000), n) for n in sizes]
    found = {r.id: r for r in nearsets.sketches(hashed(spark, enumerate(rows))).collect()}
    import pyarrow as pa

    column, n = pa.array([bytes(found[i].sketch) for i in range(len(rows))]), np.array(sizes)
    pairs = np.array(list(itertools.combinations(range(len(rows)), 2)))
    bits = nearsets._differing(column, n, pairs[:, 0], pairs[:, 1])
    for (i, j), d in zip(pairs.tolist(), bits.tolist()):
        assert d <= len(set(rows[i]) ^ set(rows[j]))
        assert d % 2 == len(set(rows[i]) ^ set(rows[j])) % 2
    assert bits.max() > 200
