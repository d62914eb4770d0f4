import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import brown, crf, language, pages


def random_chain(k, seed):
    r = np.random.default_rng(seed)
    return crf.Chain(np.zeros((1, k)), r.normal(size=(k, k)), r.normal(size=k))


def plain_marginals(model, scores):
    n, k = scores.shape
    total, best = np.zeros((n, k)), (-np.inf, None)
    for path in itertools.product(range(k), repeat=n):
        s = model.starts[path[0]] + scores[range(n), path].sum() + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
        best = max(best, (s, path))
        total[range(n), path] += math.exp(s)
    return total / total.sum(axis=1, keepdims=True), list(best[1])


@pytest.mark.parametrize("lane", [1, 3, 32])
def test_posteriors_and_best_paths_agree_with_all_paths(lane):
    model, lengths = random_chain(3, 1), np.array([1, 7, 3, 6, 2])
    scores = np.random.default_rng(2).normal(size=(lengths.sum(), 3)) * 3
    got, paths = crf.posteriors(model, scores, lengths, lane), crf.best_paths(model, scores, lengths)
    at = 0
    for n in lengths:
        want, best = plain_marginals(model, scores[at : at + n])
        assert np.allclose(got[at : at + n], want) and list(paths[at : at + n]) == best
        at += n


def test_long_sequences_stay_finite():
    model = random_chain(4, 3)
    scores = np.random.default_rng(4).normal(size=(50_000, 4)) * 40
    got = crf.posteriors(model, scores, np.array([50_000]))
    assert np.isfinite(got).all() and np.allclose(got.sum(axis=1), 1)


def test_training_learns_moves():
    r = random.Random(5)
    labels, seen = [], []
    for _ in range(200):
        now = r.randrange(2)
        for _ in range(12):
            now = now if r.random() < 0.9 else 1 - now
            labels.append(now)
            seen.append(now if r.random() < 0.7 else 1 - now)
    labels, ids = np.array(labels), np.array(seen)
    model = crf.train(ids, np.arange(len(ids)), labels, np.full(200, 12), 2, 2, rounds=80)
    assert model.moves[0, 0] > model.moves[0, 1] and model.moves[1, 1] > model.moves[1, 0]
    true = crf.Chain(np.log([[0.7, 0.3], [0.3, 0.7]]), np.log([[0.9, 0.1], [0.1, 0.9]]), np.zeros(2))
    right = [(crf.best_paths(m, m.scores(ids, np.arange(len(ids)), len(ids)), np.full(200, 12)) == labels).mean() for m in (model, true)]
    assert right[0] > right[1] - 0.01 and right[0] > (ids == labels).mean() + 0.03


WORDS = {"aa": "the and thing with ation ing ful ness".split(), "bb": "der und ung schen heit ich ßen über".split(), "cc": "que les eau oux ière ment tion çais".split()}


def speech(lang, r, n):
    return " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.choice([1, 1, 2]))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(8)
    rows = [(i, speech(k, r, r.randint(5, 60)), k) for i in range(240) for k in [sorted(WORDS)[i // 3 % 3]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 3 !", None), (903, speech("bb", r, 9000), "bb"), (904, speech("aa", r, 30) + " " + speech("cc", r, 30), None)]
    docs = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, lang string, score int, c0 string").repartition(4)
    return docs, language.fit(docs.filter("doc_id % 3 <> 1 and doc_id < 900"), per_language=40)


def test_held_out_languages(spark, languages):
    docs, model = languages
    got = language.identify(docs, model, spans=True).collect()
    told = [r for r in got if r.doc_id < 900 and r.doc_id % 3 == 1] + [r for r in got if r.doc_id == 903]
    assert all(r.lang_pred == r.lang for r in told) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {i: ("und", 0.0) for i in (900, 901, 902)}
    both = next(r for r in got if r.doc_id == 904)
    assert {s.lang for s in both.spans} == {"aa", "cc"} and both.n_switches <= 5 and abs(both.spans[0].words - 30) <= 3
    assert sum(s.words for s in both.spans) == both.n_words and "score_" in got[0].asDict()


def test_no_language_and_no_rows(spark, languages):
    docs, model = languages
    none = language.fit(docs.filter("lang is null"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_blocks_and_references():
    page = "<div class=a>One &amp; two&nbsp;<b>bo</b>ld<script>x='<p>no</p>'</script><p>next<p>last <!-- <p>gone --> line</div> tail<br>end<ul><li>x<li>y</ul><textarea>no</textarea><p>&am"
    assert [b.text for b in pages.blocks_of(page)] == ["One & two bold", "next", "last line", "tail end", "x", "y", "&am"]
    for odd in ["", "<", "<p", "<script>never closed <p>", "</div></p>", "<a href='x>y", "<!-- open", "<p title=\"a>b\">t</p>", "<" * 3000, "<p>" * 3000 + "deep"]:
        pages.blocks_of(odd)
    assert [b.text for b in pages.blocks_of('<p title="a>b">t</p>')] == ["t"]


@pytest.fixture(scope="module")
def site(spark, prose):
    rows = []
    for i in range(120):
        body = "".join(f"<p>{prose(i * 7 + k, 40)}.</p>" for k in range(1 + i % 4))
        rows.append((i, "u", f"<html><body><nav><ul><li>{prose(i, 2)}<li>{prose(i + 1, 1)}</ul></nav><div class='ad'>{prose(i + 5, 9)}</div><article><h1>{prose(i, 6)}</h1>{body}</article><footer>&copy; {prose(i, 8)}</footer></body></html>", 1))
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    return table, pages.fit(table, most=80, copies=4)


def test_main_text_of_marked_pages(spark, site, prose):
    table, model = site
    for r in pages.main_text(table, model).collect():
        body = [prose(r.page_id, 6)] + [prose(r.page_id * 7 + k, 40) + "." for k in range(1 + r.page_id % 4)]
        assert r.text == " ".join(body) and r.n_chars == len(r.text) and r.n_chars_ == 1


def test_main_text_of_other_templates(site, prose):
    _, model = site
    r = random.Random(77)
    right = total = 0
    for i in range(150):
        page, labels = pages.labelled_page([prose(5000 + i, 7)] + [prose(6000 + 9 * i + k, 35) + "." for k in range(4)], [prose(8000 + j, 30) + "." for j in range(20)], r)
        blocks = pages.blocks_of(page)
        assert len(blocks) == len(labels)
        want = {b.text for b, k in zip(blocks, labels) if k}
        got = pages.extract_pages([page], model)[0][0]
        right += sum((b.text in got) == bool(k) for b, k in zip(blocks, labels))
        total += len(want | {b.text for b in blocks})
    assert right / total > 0.95


def test_pages_without_anything(spark, site):
    table, model = site
    rows = spark.createDataFrame([(1, None, None, 0), (2, "u", "", 0), (2, "u", "", 0), (None, "u", "<script>x</script>", 0)], table.schema)
    assert [(r.text, r.n_chars) for r in pages.main_text(rows, model).collect()] == [("", 0)] * 4
    assert pages.main_text(table.limit(0), model).count() == 0
    assert pages.fit(table.limit(0)).weights.any()


def test_exchange_never_lowers_the_likelihood():
    r = np.random.default_rng(9)
    pairs = r.poisson(1.0, size=(30, 30)).astype(float)
    pairs[:15, 15:] += r.poisson(6.0, size=(15, 15))
    pairs[15:, :15] += r.poisson(6.0, size=(15, 15))

    def likelihood(own):
        t = np.zeros((4, 4))
        np.add.at(t, (own[:, None], own[None, :]), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    found = [likelihood(brown.exchange(pairs, 4, rounds)) for rounds in range(5)]
    assert all(b >= a - 1e-6 for a, b in zip(found, found[1:])) and found[-1] > found[0]
    own = brown.exchange(pairs, 4, 20)
    assert not set(own[:15]) & set(own[15:])


def test_scores_agree_with_plain_sums(spark, prose):
    texts = [prose(i, 30 + i, 60).upper() if i % 3 else prose(i, 40, 60) + "." for i in range(90)] + [None, "", "unseen words only", "É é\x0bÉ"]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)] + [(None, "w1 w2", 0, "x")] * 2, "doc_id long, text string, score int, c0 string").repartition(3)
    got = brown.score(docs, held_out=F.col("doc_id") % 5 == 1).collect()
    rows = [*enumerate(texts), (None, "w1 w2"), (None, "w1 w2")]
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [""]
    count = Counter(w for i, t in rows if not (i is not None and i % 5 == 1) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-8
        assert r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity
    assert brown.score(docs.limit(0), held_out=F.lit(False)).count() == 0
    assert {r.train_tokens for r in brown.score(docs, held_out=F.lit(True)).collect()} == {0}


def test_class_probabilities_add_up(spark, prose):
    docs = spark.createDataFrame([(i, prose(i, 50, 30)) for i in range(60)], "doc_id long, text string")
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    words = brown.encode(rows).filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"), F.max("form").alias("form"))
    seeds = brown.seed_classes(words, rows, classes=6)
    known = brown.classified(words, rows, seeds)
    model = brown.fit(known, seeds)
    assert np.allclose((10 ** model.moves(seeds.table)).sum(axis=1), 1)
    table = known.toPandas()
    for k in range(6):
        own = table[table["class"] == k]
        seen = ((own["c"] + 0.5) / (model.sizes[k] + 0.5 * (model.kinds[k] + 1))).sum()
        assert abs(seen + 0.5 / (model.sizes[k] + 0.5 * (model.kinds[k] + 1)) - 1) < 1e-9
    assert zlib.crc32(b"") == 0 and brown.form_of(b"running.") == brown.form_of(b"thing.") != brown.form_of(b"thing")


def rare_words(n=400, each=5):
    """Texts of two kinds of words in turn: four frequent ones of each kind, and ``n`` rare ones that end alike, each five times, which stand where their kind does."""
    r = random.Random(3)
    rare = [f"{kind}{i}xx" for i in range(n // 2) for kind in "ab"]
    places = {kind: [w for w in rare for _ in range(each) if w[0] == kind] for kind in "ab"}
    for p in places.values():
        r.shuffle(p)
    texts = []
    while any(places.values()):
        line = []
        for _ in range(20):
            for kind in "ab":
                line.append(places[kind].pop() if places[kind] and r.random() < 0.3 else f"{kind}{r.randrange(4)}")
        texts.append(" ".join(line))
    return texts


def seeded(spark, monkeypatch, texts, classes=3, frequent=9):
    monkeypatch.setattr(brown, "FREQUENT", frequent)
    rows = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").repartition(3)
    words = brown.encode(rows).filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"), F.max("form").alias("form"))
    return rows, words, brown.seed_classes(words, rows, classes)


def test_neighbours_are_counted_as_a_plain_loop_counts_them(spark, monkeypatch):
    rows, words, seeds = seeded(spark, monkeypatch, [*rare_words(), "", "a0", "a0xx"])
    monkeypatch.setattr(brown, "HELD", 50)
    monkeypatch.setattr(brown, "REMEMBERED", 60)
    got = Counter()
    for r in brown.contexts(rows, seeds, brown.slots_of(words, 1)).collect():
        got[r.word, r.code] += r.n
    kind = lambda w: int(seeds.own[seeds.frequent[w]]) if w in seeds.frequent else seeds.of_form(w)
    want = Counter()
    for row in rows.collect():
        line = [b"", *row.text.encode().split(), b""]
        for before, w, behind in zip(line, line[1:], line[2:]):
            if w not in seeds.frequent:
                want[w.decode(), kind(behind)] += 1
                want[w.decode(), 3 + kind(before)] += 1
    assert got == want
    few = {r.word for r in brown.contexts(rows, seeds, brown.slots_of(words.filter("word like 'a%'"), 1)).collect()}
    assert few == {w for w, _ in want if w[0] == "a"}


def test_the_gain_is_that_of_counting_again():
    r = np.random.default_rng(5)
    classes, many = 5, 40
    rows = np.array([(w, c, r.integers(1, 9)) for w in range(many) for c in sorted(r.choice(2 * classes, 4, replace=False))])
    word, code, n = rows.T
    old = r.integers(0, classes, many)
    table = r.integers(20, 90, (classes, classes)).astype(float)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    want = []
    for w in range(many):
        to, of = np.zeros(classes), np.zeros(classes)
        for c, m in rows[rows[:, 0] == w][:, 1:]:
            (to if c < classes else of)[c % classes] += m
        value = []
        for b in range(classes):
            # The word's rows and columns are taken from the old class and given to b, side by side.
            after, before, left, right = table.copy(), table.copy(), table.sum(axis=1), table.sum(axis=0)
            for k, sign in ((old[w], -1), (b, 1)):
                after[k] += sign * to
                before[:, k] += sign * of
                left[k] += sign * to.sum()
                right[k] += sign * of.sum()
            value.append(f(after) + f(before) - f(left) - f(right))
        best = int(np.argmax(value))
        want.append(best if value[best] > value[old[w]] + 1e-9 else old[w])
    assert brown.best_classes(word, code, n, old, table).tolist() == want


def test_rare_words_get_the_class_of_their_own_neighbours(spark, monkeypatch):
    rows, words, seeds = seeded(spark, monkeypatch, rare_words())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        known = brown.classified(words, rows, seeds, least=5).toPandas()
        none = brown.classified(words, rows, seeds, least=6).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = known[known["word"].str.endswith("x")]
    assert len(found) == 400 and found["placed"].all()
    of = [set(found[found["word"].str.startswith(kind)]["class"]) for kind in "ab"]
    assert len(of[0]) == len(of[1]) == 1 and of[0] != of[1]
    left = none[none["word"].str.endswith("x")]
    assert not left["placed"].any() and left["class"].nunique() == 1
    assert none[none["word"].isin(["", *[f"{k}{i}" for k in "ab" for i in range(4)]])]["placed"].all()


def test_a_head_that_is_left_open_does_not_silence_the_page():
    body = "<article><h1>One</h1><p>Two <a href=x>three</a></p></article>"
    for start in ("<html><head><title>t</title><meta charset=utf-8><body>", "<head><style>a{}</style><link rel=x>", "<head><title>t</title></head><body>"):
        assert [b.text for b in pages.blocks_of(start + body)] == ["One", "Two three"]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<button>ok<div><p>article one</p>", ["ok", "article one"]), ("<select><option>1<p>article two", ["1", "article two"]), ("<object><p>five", ["five"]),
        ("<button>x</button><p>three</p>", ["three"]), ("<p>a <button>b</button> c</p>", ["a c"]), ("<button>ok<p>four</p><button>z</button>", ["ok", "four"]),
        ("<select><option>a<option>b</select><p>six", ["six"]),
    ],
)
def test_silent_elements_that_stay_open_lose_nothing(page, texts):
    assert [b.text for b in pages.blocks_of(page)] == texts


def test_signs_that_are_no_letters_make_no_word():
    assert language.words_in("² ½ Ⅷ 12 _") == [] and language.words_in("x² é") == ["x²", "é"]
