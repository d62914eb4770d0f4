import hashlib
import random
import zlib

import pytest

from sievework.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, c string"


def plain(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q != p and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, ends))
    return sorted(out, key=str)


def found(spark, rows, **settings):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.prefix_trie(table, **settings).collect()), key=str)


def talks(seed, n, most_turns, words):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, most_turns)):
            rows.append((c * 7 % 300, t, "user" if t % 2 == 0 else "assistant", r.choice(words)))
    return rows


@pytest.mark.parametrize("most", [1, 6, 40, 100_000])
def test_equal_to_a_plain_trie_for_any_size_of_a_task(spark, most):
    rows = talks(1, 45, 5, ["a", "b é", ""])
    rows += [(1000 + i, t, "user", "same") for i in range(6) for t in range(9)]  # copies
    rows += [(2000, t, "user", f"long {t % 3}") for t in range(24)] + [(2001, t, "user", f"long {t % 3}") for t in range(22)]
    assert found(spark, rows, most=most) == plain(rows)


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "system", "é" * 3), (None, 1, "user", "lost"), (-5, 2, "user", ""), (205, 0, "user", "only")]
    rows += [(300 + i, 0, None, "t" * i) for i in range(12)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


def test_very_long_texts_and_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(1000 + i, 0, "user", "z" * 200_000) for i in range(150)]
    assert found(spark, rows) == plain(rows)


def test_a_shared_depth_is_merged_by_aggregates(spark):
    steps = [{"a": 5, "b": 6, "n": 3}, {"a": 7, "b": 8, "n": 2}]
    table = spark.createDataFrame([(steps, 2, i, 1, 0, 0, 0) for i in range(50)], trie.PARTIAL)
    nodes, left = trie.peel_level(table, 2)
    assert [tuple(r) for r in nodes.collect()] == [(7, 8, 5, 6, 0, 2, 50, 0, 1, 98)]
    assert [(r.depth, r.convs, r.kids, len(r.path)) for r in left.collect()] == [(1, 50, 1, 1)]
    assert "partial_sum" in nodes._jdf.queryExecution().toString()
