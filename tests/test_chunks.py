import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.operators import chunks

# Plain Python statements of the packing rules, to compare with.


def paragraphs(text):
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def sentences(p, size):
    out, cur, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", p):
        if len(s) > size:
            out += [" ".join(cur)] if cur else []
            out += [s[i : i + size] for i in range(0, len(s), size)]
            cur, n = [], 0
            continue
        if cur and n + len(s) > size:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(s)
        n += len(s) + 1
    return out + ([" ".join(cur)] if cur else [])


def tail(ps, overlap):
    out, n = [], 0
    for p in reversed(ps):
        if n + len(p) > overlap:
            if not out or n + len(p) <= 2 * overlap:
                out.insert(0, p)
                n += len(p) + 4
            break
        out.insert(0, p)
        n += len(p) + 4
        if n >= overlap:
            break
    return out, n


def pack(ps, size, overlap, long):
    out, cur, n = [], [], 0
    for p in ps:
        if len(p) > size:
            out += ["\n\n".join(cur)] if cur else []
            cur, n = [], 0
            out += long(p)
            continue
        if cur and n + len(p) > size:
            out.append("\n\n".join(cur))
            cur, n = tail(cur, overlap) if overlap else ([], 0)
        cur = [*cur, p]
        n += len(p) + 4
    return out + (["\n\n".join(cur)] if cur else [])


def make_text(rng, count):
    parts = []
    for _ in range(count):
        words = rng.choices(["ab", "cde.", "fghij", "k!", "lmnopqr", "s?"], k=rng.choice([1, 3, 10, 40, 120]))
        parts.append(" ".join(words))
    return rng.choice(["\n\n", "\n \n", "\n\n\n"]).join(parts)


TEXTS = [make_text(random.Random(seed), seed % 9) for seed in range(40)] + ["", "  \n\n ", "x" * 900]


@pytest.mark.parametrize("size,overlap", [(200, 50), (300, 0), (500, 120)])
def test_chunk_text(spark, size, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {}
    for r in chunks.chunk_text(df, "id", "text", size, overlap).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
        assert r["total_chunks"] >= 1
    for i, text in enumerate(TEXTS):
        want = [] if not paragraphs(text) else [text] if len(text) <= size else pack(paragraphs(text), size, overlap, lambda p: sentences(p, size))
        assert got.get(i, []) == want, i


def test_chunk_each_is_whole_and_bounded(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {}
    for r in chunks.chunk_each(df, "id", "text", 250).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
        assert len(r["chunk"]) <= 250
    fixed = lambda p: [p[i : i + 150] for i in range(0, len(p), 150)]
    for i, text in enumerate(TEXTS):
        assert got.get(i, []) == pack(paragraphs(text), 250, 0, fixed)
        assert re.sub(r"\s", "", "".join(got.get(i, []))) == re.sub(r"\s", "", text)


def batch(texts, size):
    """(chunk, [urls]) of one group, in the gathered form."""
    texts = [(t, u) for t, u in texts if t.strip()]
    line = lambda u: f"--- SOURCE: T | URL: {u} ---"
    if sum(len(t) for t, _ in texts) + 6 * (len(texts) - 1) <= size:
        out = texts[0][0]
        for t, u in texts[1:]:
            out += f"\n\n{line(u)}\n\n{t}"
        return [(out, [u for _, u in texts])]
    stream = []
    for k, (t, u) in enumerate(texts):
        stream += [(line(u), None)] if k else []
        stream += [(p, u) for p in paragraphs(t)]
    out, cur, n, src = [], [], 0, []
    for p, u in stream:
        if len(p) > size:
            out += [("\n\n".join(cur), src)] if cur else []
            cur, n, src = [], 0, []
            out += [(p[i : i + size - 100], [] if u is None else [u]) for i in range(0, len(p), size - 100)]
            continue
        if cur and n + len(p) > size:
            out.append(("\n\n".join(cur), src))
            cur, n, src = [], 0, []
        cur = [*cur, p]
        n += len(p) + 4
        if u and u not in src:
            src = [*src, u]
    return out + ([("\n\n".join(cur), src)] if cur else [])


def test_chunk_batch(spark):
    rows = [(k % 7, k, t, f"u{k % 3}", "T", "q") for k, t in enumerate(TEXTS) if len(t) < 700]
    rows += [(100, k, "word " * 300, f"u{k}", "T", "q") for k in range(60)]
    df = spark.createDataFrame(rows, "g int, k int, text string, url string, title string, search_query string")
    size = 400
    got = {}
    for r in chunks.chunk_batch(df, "g", "k", "text", size, apart_above=5).orderBy("g", "part", "chunk_index").collect():
        got.setdefault(r["g"], []).append((r["chunk"], [s["url"] for s in r["sources"]]))
    for g in {r[0] for r in rows}:
        texts = [(r[2], r[3]) for r in rows if r[0] == g]
        if sum(len(t) for t, _ in texts if t.strip()) > 5 * size:
            fixed = lambda p: [p[i : i + size - 100] for i in range(0, len(p), size - 100)]
            want = [(c, [u]) for t, u in texts if t.strip() for c in pack(paragraphs(t), size, 0, fixed)]
        else:
            want = batch(texts, size)
        assert got.get(g, []) == want, g


@pytest.mark.parametrize("size", [150, 400])
def test_groups_of_any_size_are_packed_like_a_plain_loop(spark, size):
    r = random.Random(size)
    para = lambda: " ".join("w" * r.randint(1, 9) for _ in range(r.choice([1, 3, 10, 10, 30, 200])))
    rows = [(1, k, "\n\n".join(para() for _ in range(r.randint(0, 6))), f"u{k % 4}" if k % 9 else "", "T", "q") for k in range(300)]
    rows += [(None, k, "\n\n".join("é" * r.randint(1, 60) for _ in range(5)), f"u{k}", "T", "q") for k in range(40)]
    rows += [(2, k, "y" * 5000, f"u{k}", "T", "q") for k in range(3)] + [(3, k, "x", "u", "T", "q") for k in range(900)]
    rows += [(4, 0, "a\n\n" + "b" * size * 40 + "\n\nc", "u", "T", "q"), (4, 1, "d", "v", "T", "q")]
    df = spark.createDataFrame(rows, "g int, k int, text string, url string, title string, search_query string").repartition(5)
    got = {}
    for x in chunks.chunk_batch(df, "g", "k", "text", size).orderBy("g", "chunk_index").collect():
        assert x.part is None and x.chunk_index == len(got.setdefault(x.g, []))
        got[x.g].append((x.chunk, [s["url"] for s in x.sources], x.total_chunks))
    for g in {x[0] for x in rows}:
        want = batch([(x[2], x[3]) for x in rows if x[0] == g], size)
        assert got[g] == [(c, u, len(want)) for c, u in want], g


def test_bad_sizes():
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunks.check_sizes(size, overlap)


def test_overlap_check(spark):
    rows = [(1, 0, "hello world"), (1, 1, "world peace"), (1, 2, "zzz"), (2, 0, "alone")]
    df = spark.createDataFrame(rows, "id int, chunk_index int, chunk string")
    got = [(r["chunk_index"], r["overlap"], r["longest"]) for r in chunks.chunk_overlap_check(df, "id").orderBy("chunk_index").collect()]
    assert got == [(0, 1, 5), (1, 0, 0)]


def test_cut_fixed(spark):
    got = spark.range(1).select(chunks.cut_fixed(F.lit("abcdefg"), 3)).first()[0]
    assert got == ["abc", "def", "g"]


def test_batch_of_large_groups_writes_texts_once(spark):
    """What is written down between jobs are the texts once, and numbers; not every paragraph in its block, nor every chunk."""
    rng = random.Random(4)
    rows = [(i % 2, i, "\n\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=150)) for _ in range(30)), "u", "t", "q") for i in range(120)]
    df = spark.createDataFrame(rows, "g long, o long, text string, url string, title string, search_query string")
    held, take = [], chunks.cut

    def cut(frame):
        made = take(frame)
        words = [F.length(F.col(n)) if k == "string" else F.aggregate(n, F.lit(0), lambda a, x: a + F.length(x)) for n, k in made.dtypes if k in ("string", "array<string>")]
        held.append(sum(made.agg(*[F.coalesce(F.sum(w), F.lit(0)) for w in words]).first()) if words else 0)
        return made

    chunks.cut = cut
    try:
        got = chunks.chunk_batch(df, "g", "o", "text", 500).groupBy("g").agg(F.sum(F.length("chunk")).alias("n")).collect()
    finally:
        chunks.cut = take
    size = sum(len(r[2]) for r in rows)
    assert sum(r["n"] for r in got) > 0.95 * size and sum(held) < 1.1 * size
