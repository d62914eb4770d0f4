"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.llm.common import bytes_of, cut, freed, named, pieces, released, stored
from sievework.llm.linking import components

BITS = 64
#: Keys of which so many (8 or 16 bytes each) go to every executor; more are joined by a shuffle.
FEW = 500_000
#: Shingles (8 bytes each) of texts to compare of which so many go to every executor; more are joined by a shuffle.
FEW_SHINGLES = 2_000_000
#: Members of a cell or band, several times as many as meet there by chance, from which on they are linked by rare shingles.
FAMILY = 16
#: Mark of keys under which only the members outside of a crowded cell's largest class are found.
OTHERS = 1 << 62


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of the lower-cased words; fewer words make one shingle, none make none."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and the six blanks of common.WORD only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    return np.array([digest(line[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit by bit what over half of the 64-bit hashes have, as a signed number; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits of the same hashes, for the k-th word of a longer fingerprint; k = 0 changes nothing."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def with_fingerprint(docs: DataFrame, *, width: int, seed: int, words: int = 1) -> DataFrame:
    """The other columns and f0, f1, ...: the fingerprint of column ``text``. Whole texts, in batches cut by bytes."""
    fields = [f for f in docs.schema.fields if f.name != "text"]
    names = [f"f{k}" for k in range(words)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            made = np.empty((words, part.num_rows), np.int64)
            for i, text in enumerate(bytes_of(part.column("text"))):
                hashes = shingle_hashes(text, width, seed)
                for k in range(words):
                    made[k, i] = majority(mixed(hashes, k))
            columns = [part.column(f.name) for f in fields] + [pa.array(row) for row in made]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + names)

    return docs.mapInArrow(add, StructType(fields + [StructField(n, LongType()) for n in names]))


def segments_for(distinct: int, radius: int) -> int:
    """Segments of a fingerprint: at least log2 of the table's size bits each, as a lookup then finds about one by chance."""
    return min(radius + 1, max(1, BITS // max(8, int(distinct).bit_length())))


def bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ball(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in pick) for r in range(radius + 1) for pick in combinations(range(width), r)]


def signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def cells_of(word: int, segments: int, number: int | None = None) -> list[Column]:
    """The key of each segment's value of ``f<word>``: the segment's number (from ``word``, or ``number``) above the value."""
    made = []
    for i, (first, width) in enumerate(bounds(segments)):
        if width > 48:
            raise ValueError("segments of up to 48 bits fit beside their number")
        value = F.shiftrightunsigned(f"f{word}", first).bitwiseAND(signed((1 << width) - 1))
        made.append(value.bitwiseOR(signed(((word if number is None else number) * segments + i) << 48)))
    return made


def balls_of(word: int, segments: int, radius: int) -> list[Column]:
    """For each segment of ``f<word>`` all keys within ``radius`` bits of its own."""
    return [F.array(*[cell.bitwiseXOR(signed(x)) for x in ball(width, radius)]) for cell, (_, width) in zip(cells_of(word, segments), bounds(segments))]


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def hub_links(table: DataFrame, near: Column) -> DataFrame:
    """(a, b): each member (k, id, w, n) of a cell with the cell's most frequent one (the greatest of them), where ``near`` holds of w and v.

    A family of near copies mostly lies around the text that it was made from, so this joins it in as many rows as it has
    members. The member and its hub are dealt out apart, so a cell that a third of the rows are in can be split.
    """
    hubs = table.groupBy("k").agg(F.max(F.struct("n", "id", "w")).alias("m"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = hubs.select(F.col("k").alias("c"), F.col("m.id").alias("b"), F.col("m.w").alias("v"))
    return table.join(hubs, F.col("k").eqNullSafe(F.col("c"))).filter((F.col("id") != F.col("b")) & near).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))


def classed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes with ``c``: the least id that the links reach, their own if none does."""
    linked = components(links)
    return nodes.join(linked.withColumnRenamed("node", "_node"), F.col("id") == F.col("_node"), "left").drop("_node").withColumn("c", F.coalesce("root", "id")).drop("root")


def crowded(table: DataFrame, crowd: int) -> DataFrame:
    """(x, most, rest): cells (k) with over ``crowd`` members, their largest class (c), and how many members are in others."""
    by_class = table.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    cells = by_class.groupBy("k").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("m")).filter(F.col("all") > crowd)
    return cells.select(F.col("k").alias("x"), F.col("m.c").alias("most"), (F.col("all") - F.col("m.n")).alias("rest"))


def sent(df: DataFrame, few: int = FEW) -> DataFrame:
    """The table, for every executor if it is small."""
    return F.broadcast(df) if df.count() <= few else df


def met(table: DataFrame, probes: DataFrame, crowd: DataFrame, near: Column) -> DataFrame:
    """(a, b): members of different classes where one's lookups (probes: k, id, w, c) hit a cell (table: k, id, w, c) of the other and ``near``
    holds of their w and v.

    A member of a crowded cell's largest class has nothing to learn from that class, so it looks up the cell's other members
    only: they stand in the table once more, under a key of their own. So a family that is joined already is not paired out.
    """
    crowd = sent(crowd)
    of = F.col("k") == F.col("x")
    others = table.join(crowd, of).filter("c <> most").select((F.col("k").bitwiseOR(signed(OTHERS))).alias("k"), "id", "w", "c")
    aside = F.when(F.col("c") == F.col("most"), F.col("k").bitwiseOR(signed(OTHERS))).otherwise(F.col("k")).alias("k")
    probes = probes.join(crowd, of, "left").select(aside, "id", "w", "c")
    held = table.select("k", "id", "w", "c").union(others).select(F.col("k").alias("kk"), F.col("id").alias("b"), F.col("w").alias("v"), F.col("c").alias("d"))
    found = probes.join(held, F.col("k") == F.col("kk")).filter((F.col("c") != F.col("d")) & near)
    return found.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))


def lookups_for(n: int, differ: float = 0.152, recall: float = 0.99) -> tuple[int, int, int]:
    """(words, segments of each, radius of a lookup) for a table of ``n`` fingerprints.

    Segments are so wide that a lookup meets at most about four by chance; words are as many as two fingerprints that
    differ in that part of their bits need to meet with that probability, whatever the size of the table. Fingerprints of two
    texts with a Jaccard similarity of 0.8 differ in 0.152 of their bits (the angle of their sets, by pi).
    """
    segments = max(2, next((m for m in (4, 3) if 1 << (BITS // m) >= n / 4), 2))
    width = BITS // segments
    radius = 1 if width <= 24 else 2
    met = sum(comb(width, r) * differ**r * (1 - differ) ** (width - r) for r in range(radius + 1))
    words = next(w for w in range(1, 99) if 1 - (1 - met) ** (w * segments) >= recall)
    return words, segments, radius


def near_pairs(prints: DataFrame, radius: int = 4, dense: int = 512) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``f0`` within ``radius`` (even) bits; ``prints`` has each value once.

    Two such fingerprints agree up to radius // m bits in one of m segments at least, so each looks up
    the small Hamming ball around each of its segments in the table of segments, and the whole
    distance is worked out for what is found.

    First each member of a cell meets only the most frequent fingerprint there (column ``n``, if there is one), and what is within ``radius`` is
    one class. Then lookups link what is still apart (``met``). A cell with over ``dense`` members outside of its largest class
    would list all pairs of other families. Those, and what looks them up, are linked through centres instead:
    each names all values within radius / 2 bits. Two within ``radius`` share such a centre, and whatever shares one is within
    ``radius``, so linking each centre's members to the least of them makes the same classes, with work in proportion to the members.
    """
    if radius % 2:
        raise ValueError("the radius has to be even")
    prints = prints.select("f0", F.col("f0").alias("id"), F.col("f0").alias("w"), *(["n"] if "n" in prints.columns else [F.lit(1).cast("long").alias("n")]))
    m = max(2, segments_for(prints.count(), radius))
    near = differing("w", "v") <= radius
    table = prints.select(F.explode(F.array(*cells_of(0, m))).alias("k"), "id", "w", "n")
    links = stored(hub_links(table, near).distinct())
    classes = stored(classed(prints, links))
    table = stored(classes.select(F.explode(F.array(*cells_of(0, m))).alias("k"), "id", "w", "c"))
    probes = reduce(DataFrame.union, [classes.select(F.explode(b).alias("k"), "id", "w", "c") for b in balls_of(0, m, radius // m)])
    cells = stored(crowded(table, dense))
    full = stored(cells.filter(F.col("rest") > dense).select("x"))
    links = links.union(met(*[t.join(sent(full), F.col("k") == F.col("x"), "left_anti") for t in (table, probes)], cells.filter(F.col("rest") <= dense), near))
    if full.isEmpty():
        return links
    reach = probes.join(sent(full), F.col("k") == F.col("x"), "left_semi").select(F.col("id").alias("f"), F.col("id").alias("centre")).distinct()
    singles = F.array(*[signed(x) for x in ball(BITS, 1)])
    for _ in range(radius // 2):
        reach = reach.select("f", F.explode(F.transform(singles, lambda x: F.col("centre").bitwiseXOR(x))).alias("centre")).distinct()
    reach = stored(reach)
    least = reach.groupBy("centre").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("centre").alias("z"), "a")
    return links.union(reach.hint("merge").join(least, F.col("centre").eqNullSafe(F.col("z"))).filter("f <> a").select("a", F.col("f").alias("b")))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, f0, root) for every row: fingerprint, and the least id among the documents that links reach.

    Documents with one fingerprint are one node, so copies cost a row each and no pair. Null and empty texts
    have fingerprint 0, linked like any other. Null ids get the root of their class; a class of null ids
    alone has a null root. Repeated rows come out as often as they went in; an empty table gives none. Other columns aren't read.
    """
    narrow = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    prints = stored(with_fingerprint(narrow, width=width, seed=seed))
    first = stored(prints.groupBy("f0").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    classes = classed(first.select("f0", F.col("f0").alias("id"), "low"), near_pairs(first, radius))
    least = classes.groupBy("c").agg(F.min("low").alias("root")).withColumnRenamed("c", "class")
    roots = stored(classes.join(least, F.col("c").eqNullSafe(F.col("class"))).select(F.col("f0").alias("g"), "root"))
    # Both sides have a shuffle of their own, so the optimizer can split a fingerprint that a third of the rows have.
    return prints.join(roots, F.col("f0") == F.col("g")).select("doc_id", "f0", "root")


def loosest(differ: float, loss: float, bits: int = BITS) -> int:
    """The least distance over ``bits`` bits that two fingerprints which differ in that part of them exceed with at most that probability."""
    beyond, most = 1.0, -1
    while beyond > loss:
        most += 1
        beyond -= comb(bits, most) * differ**most * (1 - differ) ** (bits - most)
    return most


def similar(docs: DataFrame, *, width: int = 5, seed: int = 42, similarity: float = 0.8, loose: float = 0.24, crowd: int = 64, differ: float = 0.152, loss: float = 0.0005) -> DataFrame:
    """(doc_id, h, class): class of the documents (doc_id, text, h) that links of ``similarity`` or more reach.

    Fingerprints of a few 64-bit words (lookups_for) are cut into segments; a lookup ball of a bit or two around each
    segment finds two texts of Jaccard similarity 0.8 in 99 of 100 cases, and more similar ones more often. A lookup carries the text's hash
    and class and one word other than the one it looks for: chance meetings differ in half of that word's bits, and go in the join
    (``loosest``: what is at 0.8 goes with probability ``loss``). What is left and differs in at most the part ``loose`` of all bits is verified by
    the exact Jaccard similarity of the whole texts' ``width``-word shingles. Equal fingerprints are one node.

    A family of near copies is not paired out: members first meet the most frequent one of each cell only. Where a cell of over FAMILY
    members still has several classes, they and what lies beside its hub are linked by their rare shingles (``family_links``), as fingerprints
    cannot tell 0.75 from 0.8. All others look up what is in other classes (``met``). Words are looked up one after the other, and
    what one has found joins classes before the next, so that disk holds the lookups of one word.
    """
    words, segments, radius = lookups_for(docs.count())
    names = [f"f{k}" for k in range(words)]
    prints = stored(with_fingerprint(docs.select("doc_id", "h", "text"), width=width, seed=seed, words=words))
    nodes = stored(prints.groupBy(*names).agg(F.min("h").alias("id"), F.count(F.lit(1)).alias("n")))
    texts = docs.select("h", "text")
    near = differing("w", "v") <= loosest(differ, loss)

    def close(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are near in all words."""
        ends = [nodes.select(F.col("id").alias(side), *[F.col(f).alias(f"{side}{f}") for f in names]) for side in "ab"]
        whole = reduce(Column.__add__, [differing(f"a{f}", f"b{f}") for f in names]) <= int(loose * BITS * words)
        return pairs.distinct().join(ends[0], "a").join(ends[1], "b").filter(whole).select("a", "b")

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are near in all words and whose texts are similar."""
        return verified(close(pairs), texts, width, seed, similarity)

    def rows(of: DataFrame, word: int, keys: list[Column], *more: str) -> DataFrame:
        parts = [of.select(F.explode(k).alias("k"), "id", F.col(f"f{(word + 1) % words}").alias("w"), *more) for k in keys]
        return reduce(DataFrame.union, parts)

    hubs = reduce(DataFrame.union, [hub_links(rows(nodes, k, [F.array(*cells_of(k, segments))], "n"), near) for k in range(words)])
    links = checked(stored(hubs.distinct()))
    classes = stored(classed(nodes, links))
    cells = stored(reduce(DataFrame.union, [rows(classes, k, [F.array(*cells_of(k, segments))], "c", "n") for k in range(words)]))
    apart = stored(crowded(cells, FAMILY).filter("rest > 0").select("x"))
    inside = cells.join(sent(apart), F.col("k") == F.col("x"), "left_semi")
    hub = inside.groupBy("k").agg(F.max(F.struct("n", "id", "w")).alias("m"))
    around = F.explode(F.array(*[F.col("k").bitwiseXOR(signed(x)) for x in ball(BITS // segments, radius)])).alias("x")
    beside = cells.join(sent(stored(hub.select(around, F.col("m.w").alias("v")))), F.col("k") == F.col("x")).filter(near)
    family = stored(inside.select("id").union(beside.select("id")).select(F.col("id").alias("h")).distinct())
    sets = sets_of(texts, family, width, seed)
    more = family_links(sets.join(classes.select(F.col("id").alias("h"), "c"), "h"), similarity, crowd)
    joined = stored(links.union(close(more)))
    released(links, classes, cells, apart, sets, more)
    links = joined
    for k in range(words):
        classes = stored(classed(nodes, links))
        table = stored(rows(classes, k, [F.array(*cells_of(k, segments))], "c"))
        others = classes.join(sent(family), F.col("id") == F.col("h"), "left_anti")  # two of a family have met; one that isn't in it finds either
        found = stored(met(table, rows(others, k, balls_of(k, segments, radius), "c"), stored(crowded(table, crowd)), near).distinct())
        more = checked(found)
        joined = stored(links.union(more))
        released(links, more, classes, table, found)
        links = joined
        freed(docs.sparkSession)
    classes = stored(classed(nodes, links)).select(*[F.col(n).alias(f"_{n}") for n in names], F.col("c").alias("class"))
    told = stored(prints.join(classes, reduce(Column.__and__, [F.col(n) == F.col(f"_{n}") for n in names])).select("doc_id", "h", "class"))
    released(prints, nodes, links, family)
    freed(docs.sparkSession)
    return told


def sets_of(texts: DataFrame, ids: DataFrame, width: int, seed: int) -> DataFrame:
    """(h, set): the shingles of the texts (h, text) whose h is in ``ids`` (h, each once); whole texts are read again where they are."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            made = [np.unique(shingle_hashes(x, width, seed)).view(np.int64) for x in bytes_of(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(made, pa.list_(pa.int64()))], names=["h", "set"])

    held = texts.join(sent(ids), "h", "left_semi")
    return stored(held.mapInArrow(sets, "h long, set array<long>").dropDuplicates(["h"]))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (h, set) have that Jaccard similarity or more. Sets go to every executor while they have few
    members in all, else they are joined to the pairs by a shuffle."""
    few = (sets.agg(F.sum(F.size("set"))).first()[0] or 0) <= FEW_SHINGLES
    left, right = (sets.select(F.col("h").alias(side), F.col("set").alias(x)) for side, x in (("a", "x"), ("b", "y")))
    both = pairs.join(F.broadcast(left) if few else left, "a").join(F.broadcast(right) if few else right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return stored(both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, seed: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of text hashes whose sets of shingles have that Jaccard similarity or more; a text is read once, whatever number of pairs names it."""
    pairs = stored(pairs)
    ends = stored(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    own = sets_of(texts, ends, width, seed)
    found = alike(pairs, own, similarity)
    released(pairs, ends, own)
    return found


def family_links(sets: DataFrame, similarity: float, crowd: int = 64) -> DataFrame:
    """Links (a, b) that connect all sets (h, c, set: distinct members) of that Jaccard similarity or more whose classes c differ.

    Members of a set are ordered by how many sets have them, those that no other one has first. Two sets of sizes a <= b share at least
    r (a + b) members, r being similarity / (1 + similarity). So the first that they share is among the first (1 - 2 r) a + 1 of the smaller and
    the first (1 - similarity) b + 1 of the greater one, and neither has fewer than r (a + b) from there on; nothing is lost by that.
    Near copies with so many edits of their own that no other copy is similar to them share nothing so early, or only with much
    smaller sets. The smaller one's size, in steps of 2 %, is part of the key, so those don't meet at all. Those with few edits first meet the
    one of a key with the fewest, and what is in other classes after that looks the rest up (``met``).
    """
    ratio, eps = similarity / (1 + similarity), 1e-6
    grid = lambda size: F.floor(F.log(size) / F.log(F.lit(1.02)))
    key = lambda size: F.xxhash64("s", size).bitwiseAND(signed((1 << 64) - 1 - OTHERS)).alias("k")
    near = (F.col("v.size") >= similarity * F.col("w.size") - eps) & (F.col("w.size") >= similarity * F.col("v.size") - eps)
    near &= 1 + F.least(F.col("v.size") - F.col("v.place"), F.col("w.size") - F.col("w.place")) >= ratio * (F.col("v.size") + F.col("w.size")) - eps
    members = sets.select("h", F.size("set").alias("size"), F.explode("set").alias("s"))
    counts = stored(members.groupBy(F.col("s").alias("t")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = members.join(sent(counts), F.col("s") == F.col("t")).groupBy("h", "size").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("m"))
    own = F.col("size") - F.size("m")  # those that no other set has
    early = F.slice("m", 1, F.greatest(F.floor((1 - similarity) * F.col("size") + eps).cast("int") + 1 - own, F.lit(0)))
    placed = stored(shared.select("h", "size", own.alias("own"), F.posexplode(early).alias("at", "x")).select("h", F.col("x.s").alias("s"), F.struct("size", (F.col("own") + F.col("at") + 1).alias("place")).alias("w")))
    size, place = F.col("w.size"), F.col("w.place")

    def smaller(of: DataFrame, *more: Column | str) -> DataFrame:
        return of.filter(place <= (1 - 2 * ratio) * size + 1 + eps).select(key(grid(size + eps)), F.col("h").alias("id"), "w", *more)

    def greater(of: DataFrame) -> DataFrame:
        low, high = similarity * size - eps, F.least(size, (1 + size - place) / ratio - size) + eps
        sizes = of.filter(high >= low).select("h", "s", "w", "c", F.explode(F.sequence(grid(F.greatest(low, F.lit(eps))), grid(high + eps))).alias("g"))
        return sizes.select(key(F.col("g")), F.col("h").alias("id"), "w", "c")

    hubs = stored(hub_links(smaller(placed, (-place).cast("long").alias("n")), near).distinct())
    links = alike(hubs, sets, similarity)
    before = sets.select(F.col("h").alias("id"), F.col("c").alias("b"))
    classes = stored(classed(before.select("id"), links.union(before.filter("id <> b").select(F.col("id").alias("a"), "b"))).select(F.col("id").alias("h"), "c"))
    held = stored(placed.join(classes, "h"))
    table = stored(smaller(held, "c"))
    pairs = stored(met(table, greater(held), stored(crowded(table, crowd)), near).distinct())
    found = stored(links.union(alike(pairs, sets, similarity)))
    released(counts, placed, hubs, links, classes, held, table, pairs)
    return found


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents, with one of each group of exact and near copies: the least id, of equal ids the least text hash.

    Null and empty texts are a group; null ids come last; of repeated rows one stays.
    """
    content = F.coalesce(named(text), F.lit(""))
    rows = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], named(doc_id).alias("doc_id"), content.alias("text"), F.xxhash64(content).alias("h"))
    classes = similar(rows.select("doc_id", "text", "h"), **settings)
    best = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k")).select("class", F.col("k.doc_id").alias("_d"), F.col("k.h").alias("_h"))
    told = classes.join(best.withColumnRenamed("class", "c"), F.col("class") == F.col("c"))
    same = (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    gone = cut(told.filter(~same).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct())
    kept = rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, same, "left_anti")
    twice = cut(told.filter(same).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")))
    if many := twice.count():
        twice = F.broadcast(twice) if many <= FEW else twice
        kept = kept.join(twice, same, "left_anti").union(kept.join(twice, same, "left_semi").dropDuplicates(["h", "doc_id"]))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
