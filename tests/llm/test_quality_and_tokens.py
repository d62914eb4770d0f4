import math
import re

import pytest

from sievework.llm import quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, c0 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", ["", None, "a", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x\ny\nx\n \n\n x", "é # ü* x\x0bz", "a b c d e f a b c d e g a b c", "\x1c a\x85b  ", "w " * 5000])
def test_counts(text):
    assert quality.counts_of(text or "")[:5] == plain_counts(text)


def test_counts_of_many_different_words():
    words = [f"w{i}" for i in range(9000)]
    text = " ".join(words + words[100:107] + words[50:54])
    assert quality.counts_of(text)[4] == 14


def test_bins_are_close_and_quantiles_merge(spark):
    from pyspark.sql import functions as F

    values = [i * i % 7919 for i in range(4000)]
    rows = spark.createDataFrame([("m", v, i % 3) for i, v in enumerate(values)], "measure string, value long, part int")
    binned = rows.select("measure", "part", quality.bin_of(F.col("value")).alias("bin"), "value")
    assert binned.filter("bin > value or value - bin > value / 32").count() == 0
    whole = quality.sketches(binned, [])
    merged = quality.sketches(binned, ["part"]).groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    assert sorted(whole.collect()) == sorted(merged.collect())
    got = quality.quantiles(whole, []).first()
    for q, found in zip((0.25, 0.5, 0.75), (got.q0, got.q1, got.q2)):
        exact = sorted(values)[math.ceil(q * len(values)) - 1]
        assert exact - exact / 32 - 1 <= found <= exact


def corpus(prose):
    rows = [(i, prose(i, 60 + i % 40), "en", "web", 1, "x") for i in range(260)]
    rows += [(1000 + i, prose(i, 60).replace(" ", "*** ").replace("w", "W"), "en", "web", 1, "x") for i in range(20)]
    rows += [(2000 + i, prose(i, 60).replace(" ", "$$ "), "en", "code", 1, "x") for i in range(260)]
    return rows + [(3001, None, None, None, 1, "x"), (3002, "", "en", None, 1, "x"), (3003, prose(3, 9), "xx", "web", 1, "x"), (3004, prose(4, 60), "xx", "rare", 1, "x"), (3005, "a b c d e " * 30, "en", "web", 1, "x"), (3001, None, None, None, 1, "x")]


def test_limits_follow_the_source(spark, prose):
    docs = spark.createDataFrame(corpus(prose), SCHEMA).repartition(5)
    got = quality.judged(docs).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in [*range(260), *range(2000, 2260), 3004])  # many symbols are usual in one source
    assert not any(kept[i] for i in [*range(1000, 1020), 3003, 3005])
    assert len(got) == len(corpus(prose)) and {r.base_failed for r in got if r.doc_id in (3002, 3003)} == {True}
    good = quality.good(docs)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.judged(docs.limit(0)).count() == 0 and quality.good(docs.limit(0)).count() == 0


TEXTS = ["", None, "Hello world", "  two  blanks\n\nand lines \t tabs ", "it's we'll 123 456abc <|endoftext|> after<|endoftext|>it", "naïve café 你好 世界 🎉 🎉x", "a b 　c\x1cd \x85e", "x" * 5000, "word " * 30_000, "\x0b\x0c \r\n ", " lead", "trail ", "3 .14 !? ... -- a"]


def test_token_counts_are_the_library_s_own(spark, prose):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = TEXTS + [prose(i, 50) for i in range(30)]
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, c0 string").repartition(3)
    got = {r.doc_id: r for r in tokens.token_counts(docs, path, batch_bytes=1000).collect()}
    assert {i: got[i].n_tokens for i in got} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {i: got[i].n_bytes for i in got} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
    assert {i for i in got if got[i].over_limit} == {i for i in got if got[i].n_tokens > 1024} and got[0].n_tokens_ == 0
    assert tokens.token_counts(docs.limit(0), path).count() == 0


def test_remembered_parts_are_dropped_and_learned_again(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counter = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    first = counter.lengths(["some words here and there"])
    assert counter.lengths(["other words", "some words here and there"])[1:] == first and len(counter.known) < 9


def test_long_texts_without_blanks_are_cut(monkeypatch):
    import random

    import public_tokenizers

    counter = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    whole = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False))
    assert max(map(len, counter.parts("a\n" * 100_000))) <= 2
    assert max(map(len, counter.parts("中文、12" * 20_000))) <= 2
    monkeypatch.setattr(tokens, "LONG", 6)
    r = random.Random(2)
    signs = [*"ab 's'tre12,.!?\n\t  éñ中文字½²_-<|>'’\x0b\x85\x1c", "<|endoftext|>", " <|endoftext|> ", "　", "'ll"]
    for _ in range(1500):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 40)))
        assert counter.lengths([text]) == [whole(text)], text


def test_what_is_remembered_is_bounded_by_signs(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "REMEMBERED", 5_000)
    counter = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(50):
        counter.lengths([f"word{i} " * 3 + "z" * 3000])
        assert sum(map(len, counter.known)) <= 5_000 + 2 * 3_100
