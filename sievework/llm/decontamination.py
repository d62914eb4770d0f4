"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import unnest
from sievework.llm.common import cut, free_name, named

WIDTH = 5
#: Bits by which a window's fingerprint may differ from the item's; blocks that it is cut into.
RADIUS, BLOCKS = 15, 4
#: Shingles and texts of which so many rows go to every executor (8 to 24 bytes each); more are joined by a shuffle.
FEW = 1_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the runs of letters and digits, lower-cased; none for null."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def shingles(hashes: Column) -> Column:
    """Hashes of runs of WIDTH words, repeats included; fewer words make one shingle of all, none make none."""
    last = F.greatest(F.size(hashes) - WIDTH, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(hashes, i + 1, F.lit(WIDTH))))
    return F.when(F.size(hashes) > 0, each).otherwise(F.array().cast("array<bigint>"))


def fingerprint(column: str) -> Column:
    """SimHash of an array of word hashes: each bit that over half of the words have, repeats weighing as often."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (made, b) -> made | if(2 * aggregate({column}, 0, (n, x) -> n + cast(shiftrightunsigned(x, b) & 1L as int))"
        f" > size({column}), shiftleft(1L, b), 0L))"
    )


def blocks(fp: Column) -> list[Column]:
    width = 64 // BLOCKS
    return [F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]


def item_windows(docs: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """(h, n, at, size): the item-sized windows of texts that hold a shingle of an item of that size.

    ``docs`` has (h, text), ``sizes`` (shingle, size). A window without any shingle of an item has no similarity with it,
    so leaving it out loses nothing. A window counts once, with the first such shingle in it; one that would
    reach over the end of a shorter text is the whole text.
    """
    hashed = docs.select("h", word_hashes(F.col("text")).alias("words"))
    found = unnest(hashed, ["h", F.size("words").alias("n")], shingles(F.col("words")), "shingle", "p")
    hits = found.join(F.broadcast(sizes) if few else sizes, "shingle").select("h", "n", "p", "size").distinct()
    before = F.lag("p", 1, -1).over(Window.partitionBy("h", "size").orderBy("p"))
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    first = F.greatest(before + 1, F.col("p") - F.greatest(F.col("size") - WIDTH, F.lit(0)), F.lit(0))
    placed = hits.select("h", "size", first.alias("lo"), F.least(F.col("p"), last).alias("hi"), F.col("p"), last.alias("last"))
    # A hit near the end may lie behind the last window's start; that window is its own then, and may be met twice.
    lo = F.least(F.col("lo"), F.col("last"))
    return placed.select("h", "size", F.explode(F.when(lo <= F.col("hi"), F.sequence(lo, F.col("hi"))).otherwise(F.array().cast("array<int>"))).alias("at")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(h, item_id, similarity, distance, at, size): texts, by the hash of ``text``, that hold a benchmark item.

    Words are runs of letters and digits in lower case, so marks and case don't hide a copy. For every item, each
    window of its number of words that could hold it gets a 64-bit SimHash of its words. Both fingerprints are
    cut into blocks; two within RADIUS bits agree up to RADIUS // BLOCKS bits in one of them, so items are entered under
    every value of that Hamming ball and windows look up their own values: all within the radius are met. What is
    met is verified: the weight of the item's five-word shingles (how often each occurs) that the window has
    too, as a share of the item's whole weight, has to be ``similarity`` or more. The best window of each text and
    item is returned, the first of equal ones.

    An item under five words is one shingle and matches a text that has just these words; null and empty items match
    nothing, as do null and empty texts. Items alike match each. Empty tables give no rows.
    """
    bench = items.select(named(item_id).alias("item_id"), word_hashes(named(item_text)).alias("words")).filter(F.size("words") > 0)
    bench = cut(bench.select("item_id", F.size("words").alias("size"), fingerprint("words").alias("item_fp"), shingles(F.col("words")).alias("item_shingles")))
    sizes = cut(bench.select(F.explode("item_shingles").alias("shingle"), "size").distinct())
    narrow = docs.select(F.xxhash64(named(text)).alias("h"), named(text).alias("text")).filter(F.col("text").isNotNull())
    windows = cut(item_windows(narrow, sizes, sizes.count() <= FEW))
    texts = windows.select("h").distinct()
    held = narrow.join(F.broadcast(texts) if texts.count() <= FEW else texts, "h", "left_semi").dropDuplicates(["h"]).select("h", word_hashes(F.col("text")).alias("words"))
    cut_out = windows.join(held, "h").select("h", "size", "at", F.slice("words", F.col("at") + 1, F.col("size")).alias("words"))
    printed = cut(cut_out.select("h", "size", "at", "words", fingerprint("words").alias("fp")))

    masks = [sum(1 << b for b in pick) for r in range(RADIUS // BLOCKS + 1) for pick in combinations(range(64 // BLOCKS), r)]
    around = F.array(*[F.lit(m).cast("long") for m in masks])
    entered = bench.select("item_id", "size", "item_fp", F.posexplode(F.array(*blocks(F.col("item_fp")))).alias("block", "own")).select(
        "item_id", "size", "item_fp", "block", F.explode(F.transform(around, lambda m: F.col("own").bitwiseXOR(m))).alias("value")
    )
    looked = printed.select("h", F.col("size").alias("wide"), "at", "fp", F.posexplode(F.array(*blocks(F.col("fp")))).alias("in_block", "found"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    met = looked.join(entered, (F.col("in_block") == F.col("block")) & (F.col("found") == F.col("value")) & (F.col("wide") == F.col("size")) & (distance <= RADIUS))
    met = met.select("h", "size", "at", "item_id", distance.alias("distance")).distinct()
    both = met.join(printed.select("h", "size", "at", shingles(F.col("words")).alias("have")), ["h", "size", "at"]).join(bench.select("item_id", "item_shingles"), "item_id")
    shared = F.expr("aggregate(array_intersect(item_shingles, have), 0, (s, x) -> s + least(size(filter(item_shingles, y -> y = x)), size(filter(have, y -> y = x))))")
    scored = both.withColumn("similarity", shared / F.size("item_shingles")).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("h", "item_id").agg(F.max_by(F.struct("similarity", "distance", "at", "size"), F.struct("similarity", -F.col("distance"), -F.col("at"))).alias("b"))
    return best.select("h", "item_id", "b.*")


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, item_id, similarity, distance, at, size): each document's item with its best window, in words from 0.

    Repeated rows are listed as often as they occur, null ids too.
    """
    found = cut(contaminated(docs, items, text=text, **settings))
    ids = docs.select(named(doc_id).alias("doc_id"), F.xxhash64(named(text)).alias("h"), named(text).isNotNull().alias("there")).filter("there").drop("there")
    return ids.join(found, "h").drop("h")


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", **settings) -> DataFrame:
    """The documents that hold no benchmark item, all columns; null texts hold none."""
    own = free_name(docs, "leaked")
    hashes = cut(contaminated(docs, items, text=text, **settings).select(F.col("h").alias(own)).distinct())
    few = hashes.count() <= FEW
    return docs.join(F.broadcast(hashes) if few else hashes, (F.xxhash64(named(text)) == F.col(own)) & named(text).isNotNull(), "left_anti")
