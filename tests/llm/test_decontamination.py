import re

import pytest

from sievework.llm import decontamination

DOCS, ITEMS = "doc_id long, text string, item_id int, h string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def plain_leaks(docs, items, least=0.8):
    """All windows of all texts against all items."""
    found = set()
    for i, text in docs:
        w = words(text)
        for k, item in items:
            q = words(item)
            if not q or text is None:
                continue
            if len(q) < 5:
                found |= {(i, k)} if w == q else set()
                continue
            need = shingles(q)
            for at in range(max(1, len(w) - len(q) + 1)):
                have = shingles(w[at : at + len(q)])
                if sum(min(need.count(s), have.count(s)) for s in set(need)) >= least * len(need):
                    found.add((i, k))
                    break
    return found


@pytest.fixture(scope="module")
def case(prose):
    items = [(k, prose(700 + k, 25 + 3 * k)) for k in range(12)] + [(50, prose(700, 25)), (51, "just four little words"), (52, None), (53, ""), (54, "a b c d e a b c d e a b c d e")]
    docs = []
    for i in range(60):
        text = prose(i, 80)
        if i % 3 == 0:
            q = items[i % 12][1].split()
            if i % 2:
                q[len(q) // 2] = "changed"
            if i % 5 == 0:
                q = [x.upper() + "," for x in q]
            text = f"{text}\n{' '.join(q)} {prose(i + 900, 30)}"
        docs.append((i, text))
    docs += [(100, items[3][1]), (101, items[3][1]), (101, items[3][1]), (None, items[4][1]), (102, None), (103, ""), (104, "Just four, little WORDS."), (105, "so just four little words"), (106, " ".join(items[5][1].split()[:-1])), (107, "a b c d e " * 4), (108, prose(1, 20_000) + " " + items[6][1])]
    return docs, items


def test_leaks_agree_with_brute_force(spark, case):
    docs, items = case
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS).repartition(4)
    got = decontamination.leaks(table, spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain_leaks(docs, items)
    assert sum(r.doc_id == 101 for r in got) == 2
    assert min(r.similarity for r in got) < 1 and all(r.distance <= decontamination.RADIUS for r in got)


def test_clean_keeps_what_has_no_item(spark, case):
    docs, items = case
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS)
    kept = decontamination.clean(table, spark.createDataFrame(items, ITEMS))
    leaked = {i for i, _ in plain_leaks(docs, items)}
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in leaked)


def test_every_fingerprint_within_the_radius_shares_a_block(spark):
    import random

    r = random.Random(1)
    width, most = 64 // decontamination.BLOCKS, decontamination.RADIUS // decontamination.BLOCKS
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(range(64), decontamination.RADIUS))
        assert min(bin(flips >> k * width & (1 << width) - 1).count("1") for k in range(decontamination.BLOCKS)) <= most


def test_empty_tables(spark, case):
    docs, items = case
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(i, t, 0, "x") for i, t in docs[:3]], DOCS)
    assert decontamination.leaks(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert decontamination.clean(some, spark.createDataFrame([], ITEMS)).count() == 3
