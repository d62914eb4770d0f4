import hashlib
import re
import zlib
from fractions import Fraction

import pytest

from sievework.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, _g int, c0 string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA).repartition(3)


def digest(seed, i):
    return hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Shares handed out again and again until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    full, total = {}, Fraction(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: Fraction(3 * sizes[s]) for s in over}


def plain_mix(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goals, out = plain_targets(sizes), []
    for s in sizes:
        own = sorted(((digest(mixing.SEED, i), size(t), i) for i, t, x in rows if x == s), key=lambda r: r[:2])
        budget = int(goals[s])
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for _, n, i in own:
            take = min(n, max(0, rest))
            rest -= n
            out.append((i, n, sizes[s], round(float(goals[s]), 6), epochs * n + take))
    return sorted(out, key=repr)


ROWS = [(i, " ".join(["w"] * (i * 37 % 50)), ["web", "books", "ünï", "code", None][i % 11 % 5]) for i in range(300)]
ROWS += [(1000 + i, "a b c", "tiny") for i in range(2)] + [(None, "x y", "web"), (None, "x y", "web"), (7, "\x0b a\xa0b \n", "web"), (8, None, "tiny"), (9, "", None), (1, ROWS[1][1], ROWS[1][2]), (77, "w " * 20_000, "books")]


@pytest.mark.parametrize("rows", [ROWS, [(1, "a b", "s")], [(1, None, None), (2, "", "s")], [(i, "a b c d", "hot") for i in range(500)] + [(-1, "z", "cold")]])
def test_mix_agrees_with_the_plain_loop(spark, rows):
    mixed = mixing.mix(table(spark, rows), carry=["doc_id"])
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixed.collect()), key=repr)
    assert got == plain_mix(rows)


def test_mixed_rows_come_near_the_targets_and_keep_columns(spark):
    docs = table(spark, ROWS)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    sizes, got = {}, {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + size(t)
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + size(r.text)
    longest = {s: max(size(t) for _, t, x in ROWS if x == s) for s in sizes}
    for s, goal in plain_targets(sizes).items():
        assert abs(got.get(s, 0) - goal) <= longest[s] / 2 + 1


def plain_shards(rows, shards):
    n, counts, placed = len(rows), {}, []
    for _, _, s in rows:
        counts[s] = counts.get(s, 0) + 1
    for s in counts:
        name = "n" if s is None else "a" + s
        phase = int(digest(sharding.SEED, name)[:8], 16) / 2**32
        own = sorted((digest(sharding.SEED, i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, repr(i)) for i, t, x in rows if x == s)
        placed += [((rank + phase) / counts[s], name, *r) for rank, r in enumerate(own)]
    placed.sort()
    return sorted(((r[5], r[4], r[3], k * shards // n, k - -(-(k * shards // n) * n // shards)) for k, r in enumerate(placed)), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_agree_with_the_plain_loop(spark, shards):
    got = sharding.shard(table(spark, ROWS), shards, carry=["doc_id"]).collect()
    assert sorted(((repr(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got), key=repr) == plain_shards(ROWS, shards)


def test_shards_are_even_and_match_the_mixture(spark):
    placed = sharding.shard(table(spark, ROWS), 8)
    assert placed.columns == [*SCHEMA.replace(",", "").split()[::2], "size", "text_crc32", "shard", "slot"]
    rows = placed.collect()
    by_shard = [[r for r in rows if r.shard == k] for k in range(8)]
    assert max(map(len, by_shard)) - min(map(len, by_shard)) <= 1
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by_shard)
    for source in {r.source for r in rows}:
        own = [sum(r.source == source for r in s) for s in by_shard]
        assert max(own) - min(own) <= 2


def test_empty_tables(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mixed_rows(table(spark, [])).count() == 0
    assert sharding.shard(table(spark, [])).count() == 0
