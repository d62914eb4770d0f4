import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import simhash
from sievework.llm.linking import components

SCHEMA = "doc_id long, text string"


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius=4):
    left, out = dict(prints), {}
    for start in sorted(prints, key=lambda i: (i is None, i)):
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            x = todo.pop()
            for y in left:
                if y not in out and bin(prints[x] ^ prints[y]).count("1") <= radius:
                    out[y] = start
                    todo.append(y)
    return out


def texts_of(prose):
    r = random.Random(5)
    texts = [prose(i, 150) for i in range(25)]
    for i in range(40):  # near copies, copies of copies, exact copies
        words = r.choice(texts).split()
        for _ in range(r.choice([0, 1, 1, 2])):
            words[r.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    return [*texts, None, "", "  \n\t", "one", "One", "one two three four", "one two three four five", "é\x0bÉ É", "x " * 30_000]


def test_classes_agree_with_brute_force(spark, prose):
    texts = texts_of(prose)
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r.doc_id: (r.f0 & (2**64 - 1), r.root) for r in simhash.near_duplicates(docs).collect()}
    prints = {i * 3: plain_print(t) for i, t in enumerate(texts)}
    want = plain_classes(prints)
    assert got == {i: (prints[i], want[i]) for i in prints}
    assert len({r for _, r in got.values()}) < len(texts) - 20


@pytest.mark.parametrize("dense", [1, 512])
def test_crowded_segments_link_the_same(spark, dense):
    r = random.Random(3)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(40)} | {r.getrandbits(64) for _ in range(20)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "f0 long"), 4, dense)
    got = {x.node: x.root for x in components(pairs).collect()}
    want = plain_classes({p: p & (2**64 - 1) for p in signed})
    same = {}
    for p in signed:
        same.setdefault(want[p], set()).add(p)
    assert {frozenset(v) for v in same.values() if len(v) > 1} == {frozenset(p for p in got if got[p] == root) for root in set(got.values())}


def test_empty_and_repeated_rows_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q r s t u v")]
    got = sorted((str(r.doc_id), str(r.root)) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_one_of_each_group_stays(spark, prose):
    base = [prose(i, 200) for i in range(20)]
    near = [t.replace(" ", "  ", 3).upper() for t in base[:5]] + [" ".join(["changed", *t.split()[1:]]) for t in base[5:15]]
    rows = [(i, t, "s", 1) for i, t in enumerate([*base, *near, base[0], None, ""])] + [(0, base[0], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f0 string, class int").repartition(4)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 36]


def test_family_of_near_copies_keeps_one(spark, prose):
    words = prose(1, 300).split()
    rows = [(i, " ".join(w if k != i * 7 % 300 else f"e{i}" for k, w in enumerate(words))) for i in range(120)] + [(500 + i, prose(90 + i)) for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    classes = simhash.similar(docs.withColumn("h", F.xxhash64("text")), crowd=5)
    assert classes.select("class").distinct().count() == 10


@pytest.mark.parametrize("per_task", [0, 40, 10_000])
def test_components_of_a_chain_and_a_star(spark, per_task):
    links = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(50)] + [(5000, 5000), (3, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(6), per_task).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in [1000, *range(2000, 2050)]}
    assert components(spark.createDataFrame([], "a long, b long"), per_task).count() == 0


def pairs_at_the_threshold(n):
    for i in range(n):
        words = [f"a{i}x{k}" for k in range(204)]
        other = words[: 182 + i % 8] + [f"b{i}x{k}" for k in range(22 - i % 8)]
        x, y = ({tuple(t[k : k + 5]) for k in range(200)} for t in (words, other))
        assert 0.8 <= len(x & y) / len(x | y) < 0.87
        yield " ".join(words), " ".join(other)


@pytest.mark.parametrize("size", [1000, 1_000_000, 20_000_000])
def test_pairs_at_the_threshold_meet_in_every_layout(size):
    words, segments, radius = simhash.lookups_for(size)
    met = 0
    for pair in pairs_at_the_threshold(400):
        hashes = [simhash.shingle_hashes(t.encode(), 5, 42) for t in pair]
        differ = [(simhash.majority(simhash.mixed(hashes[0], k)) ^ simhash.majority(simhash.mixed(hashes[1], k))) & (2**64 - 1) for k in range(words)]
        near = any((d >> first & (1 << width) - 1).bit_count() <= radius for d in differ for first, width in simhash.bounds(segments))
        met += near and sum(d.bit_count() for d in differ) <= int(0.24 * 64 * words)
    assert met >= 392


def test_pairs_at_the_threshold_are_linked(spark):
    rows = [row for i, (a, b) in enumerate(pairs_at_the_threshold(200)) for row in ((2 * i, a), (2 * i + 1, b))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    classes = {x.doc_id: x["class"] for x in simhash.similar(docs.withColumn("h", F.xxhash64("text"))).collect()}
    assert len(classes) == 400 and sum(classes[2 * i] == classes[2 * i + 1] for i in range(200)) >= 196


def distant_family(prose, n, edits=9, words=300):
    """Copies with edits of their own: near by fingerprint and at 0.7 of the text that all come from, so that none is similar to another."""
    base, rows = prose(1, words, 5000).split(), [prose(1, words, 5000)]
    for i in range(n):
        r = random.Random(i)
        rows.append(" ".join(f"e{i}x{k}" if k in places else w for places in [set(r.sample(range(5, words, 6), edits + i % 3))] for k, w in enumerate(base)))
    return rows


@pytest.mark.parametrize("sizes", [(100, 300)])
def test_distant_copies_are_not_paired_out(spark, prose, monkeypatch, sizes):
    counted, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *more: counted.append(pairs.count()) or verified(pairs, *more))
    made = []
    for n in sizes:
        counted.clear()
        docs = spark.createDataFrame(list(enumerate(distant_family(prose, n))), SCHEMA).withColumn("h", F.xxhash64("text"))
        assert simhash.similar(docs).select("class").distinct().count() == n + 1
        made.append(sum(counted))
    assert made[1] <= 20 * sizes[1] and made[1] <= 6 * max(made[0], 100)


def plain_partition(sets, similarity, before):
    root = {h: c for h, (c, _) in sets.items()} if before else {h: h for h in sets}
    for a in sets:
        for b in sets:
            x, y = sets[a][1], sets[b][1]
            if a < b and root[a] != root[b] and len(x & y) >= similarity * len(x | y):
                root = {h: root[a] if c == root[b] else c for h, c in root.items()}
    return {frozenset(h for h in root if root[h] == c) for c in root.values()}


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_links_by_rare_shingles_agree_with_brute_force(spark, similarity):
    r = random.Random(9)
    sets = {}
    for h in range(-60, 160):
        base = set(range(r.choice([0, 1000, 1010]), 1030 + r.randrange(40))) if h % 3 else set(r.sample(range(1000, 1060), r.randrange(1, 30)))
        for _ in range(r.randrange(0, 14)):
            base.discard(r.choice(sorted(base))) if len(base) > 1 and r.random() < 0.6 else base.add(r.randrange(1000, 1100))
        sets[h] = (h, {x for x in base if x >= 1000})
    sets = {h: v for h, v in sets.items() if v[1]}
    table = spark.createDataFrame([(h, c, sorted(x)) for h, (c, x) in sets.items()], "h long, c long, set array<long>").repartition(3)
    for crowd in (2,):
        got = {x.node: x.root for x in components(simhash.family_links(table, similarity, crowd)).collect()}
        got = {h: got.get(h, h) for h in sets}
        assert {frozenset(h for h in got if got[h] == c) for c in got.values()} == plain_partition(sets, similarity, False)
    assert len(plain_partition(sets, similarity, False)) < len(sets)
