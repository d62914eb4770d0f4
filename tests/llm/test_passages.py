import numpy as np

from sievework.llm import passages

SCHEMA = "doc_id long, text string, cluster int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(4)


def test_paragraphs_cover_the_words_once():
    texts = [b"", b"one", b"a b c. d e f! g\nh i\n\n  \nj k l m n o p q r s t. u v w x y z", b" \n ", ("w. " * 5000).encode()]
    found = passages.Paragraphs(texts)
    for i, t in enumerate(texts):
        own = np.flatnonzero(found.text == i)
        assert found.size[own].sum() == len(t.split()) and list(found.number[own]) == list(range(len(own)))
        assert list(found.first[own]) == [0, *np.cumsum(found.size[own])[:-1]][: len(own)]
    assert set(found.of.tolist()) == set(range(len(found.key)))


def test_cuts_inside_of_a_passage_do_not_move(prose):
    passage = ". ".join(prose(i, 9) for i in range(20)).encode()
    alone = passages.Paragraphs([passage])
    inside = passages.Paragraphs([prose(99, 33).encode() + b" " + passage + b" " + prose(98, 11).encode()])
    assert len(set(alone.key.tolist()) & set(inside.key.tolist())) >= len(alone.key) - 2


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.95):
        b = passages.bands_for(similarity)
        assert 1 - (1 - similarity**4) ** b >= 0.99 > 1 - (1 - similarity**4) ** (b - 1)


def test_short_paragraphs_can_only_be_equal():
    assert [passages.least_size(s) for s in (0.5, 0.8, 0.9)] == [5, 8, 13]


def case(prose):
    passage = "\n".join(prose(i, 26) + "." for i in range(700, 703))
    near = passage.replace("w1", "w2", 1)
    line = prose(800, 9) + "."
    rows = [(i, prose(i, 80) + "\n" + line + "\n" + prose(i + 1000, 40)) for i in range(60)]
    rows += [(100 + i, prose(100 + i, 30) + "\n" + (near if i == 5 else passage) + "\n" + prose(300 + i, 30)) for i in range(12)]
    rows += [(200, prose(5000, 60)), (200, prose(5000, 60)), (201, "same same same same\n" * 30), (202, None), (203, ""), (None, prose(77, 20) + "\n" + passage), (None, None)]
    return rows


def test_passages_are_found_and_clean_texts_left_alone(spark, prose):
    got = passages.repeats(table(spark, case(prose))).collect()
    assert {r.doc_id for r in got} == {None, *range(100, 112)}
    assert {r.doc_id for r in got if not r.removed} <= {100, None}
    for i in range(100, 112):
        assert sum(r.n_words for r in got if r.doc_id == i) >= 52
    clusters = {}
    for r in got:
        clusters.setdefault(r.cluster, []).append(r.removed)
    assert all(v.count(False) == 1 for v in clusters.values())


def test_all_links_of_similar_paragraphs_are_found(spark, prose):
    base = prose(1, 60).split()
    rows = [(i, " ".join(f"x{i}" if k == i * 3 % 60 else w for k, w in enumerate(base))) for i in range(25)]  # one word each
    got = passages.repeats(table(spark, rows), similarity=0.6).collect()
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(56)} for _, t in rows]
    whole = [r for r in got if r.n_words == 60]
    for r in whole:
        assert max(len(shingles[r.doc_id] & s) / len(shingles[r.doc_id] | s) for i, s in enumerate(shingles) if i != r.doc_id) >= 0.6


def test_empty_tables(spark):
    assert passages.repeats(table(spark, [])).count() == 0
    assert passages.repeats(table(spark, [(1, None), (2, "")])).count() == 0


def test_equal_words_inside_of_lines_are_found_without_cuts(spark, prose):
    shape = {True: lambda t: ". ".join(" ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9)), False: lambda t: t}
    rows, where = [], {}
    for i in range(60):
        passage, form = prose(9000 + i, 51, 5000), shape[i % 2 == 0]
        for k in (0, 1):
            before = 20 + (i * 7 + k * 13) % 40
            rows.append((2 * i + k, form(prose(100 + 2 * i + k, before, 5000)) + " " + form(passage) + " " + form(prose(500 + 2 * i + k, 30, 5000))))
            where[2 * i + k] = before
    got = passages.repeats(table(spark, rows)).collect()
    for i in range(60):
        for k in (0, 1):
            words = [w for r in got if r.doc_id == 2 * i + k and r.removed == (k == 1) for w in range(r.first_word, r.first_word + r.n_words)]
            inside = set(range(where[2 * i + k], where[2 * i + k] + 51))
            assert (k == 0 or len(words) == len(set(words))) and len(inside & set(words)) >= 50 and len(set(words) - inside) <= 12  # similar paragraphs reach a few words over the edge
    assert all(sum(not r.removed for r in got if r.cluster == c) == 1 for c in {r.cluster for r in got})


def test_runs_of_different_length_share_their_parts(spark, prose):
    words = prose(1, 120, 5000).split()
    spans = [(0, 120), (20, 71), (60, 100), (5, 24)]  # the last one is a word short of a passage
    rows = [(i, prose(50 + i, 25, 5000) + " " + " ".join(words[a:b]) + " " + prose(80 + i, 25, 5000)) for i, (a, b) in enumerate(spans)]
    got = passages.repeats(table(spark, rows)).collect()
    assert [sum(r.n_words for r in got if r.doc_id == i and r.removed) for i in range(4)] == [0, 51, 40, 0]
    assert sum(r.n_words for r in got if r.doc_id == 0) == 80 and all(not r.removed for r in got if r.doc_id == 0)


def test_distant_paragraphs_are_not_paired_out(spark, prose, monkeypatch):
    base, counted, verified = prose(4, 66, 5000).split(), [], passages.verified
    monkeypatch.setattr(passages, "verified", lambda pairs, *more: counted.append(pairs.count()) or verified(pairs, *more))
    rows = [(i, " ".join(f"e{i}x{k}" if k in (i * 7 % 64, (i * 7 + 31) % 64) else w for k, w in enumerate(base))) for i in range(120)]
    got = passages.repeats(table(spark, rows)).collect()
    assert sum(counted) <= 10 * len(rows)
    assert {r.doc_id for r in got} == set(range(120))  # equal runs of 20 words or more


def test_least_of_entries_in_a_row():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for many in (1, 2, 3, 8, 13, 50):
        assert list(passages._over(np.minimum, x, many)) == [x[i : i + many].min() for i in range(51 - many)]
    assert len(passages._over(np.maximum, x[:13], 13)) == 1


def test_repeated_rows_change_nothing(spark, prose):
    words = prose(1, 60, 5000)
    rows = [(i, prose(50 + i, 25, 5000) + " " + words + " " + prose(80 + i, 25, 5000)) for i in range(2)]
    got = [sorted(map(tuple, passages.repeats(table(spark, r)).collect())) for r in (rows, rows + rows)]
    assert got[0] == got[1] and got[0]
