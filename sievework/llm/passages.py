"""Passages that repeat across documents: MinHash banding of paragraphs, exact verification, components; winnowing for runs of equal words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sievework.llm.common import bytes_of, cut, freed, named, pieces, released, stored
from sievework.llm.linking import components
from sievework.llm.simhash import FAMILY, family_links, sent

WIDTH = 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Paragraphs of which so many are named to every task that reads their words again; more are joined by a shuffle.
FEW = 1_000_000


#: Minima in a band: paragraphs that share a third of their shingles rarely share four of them.
ROWS = 4


def least_size(similarity: float) -> int:
    """Words of the shortest paragraph that can have that similarity with a different one: with s shingles
    of at most s + 1 in both, it is s / (s + 1)."""
    shingles = 1
    while shingles < similarity * (shingles + 1) - 1e-9:
        shingles += 1
    return shingles + WIDTH - 1


def bands_for(similarity: float, recall: float = 0.99, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` minima that two paragraphs of that similarity share one of, with that probability."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _over(pick: np.ufunc, x: np.ndarray, many: int) -> np.ndarray:
    """The least (greatest) of each ``many`` entries in a row: those of half as many are put together, over and over."""
    width = 1
    while width < many:
        step = min(width, many - width)
        x, width = pick(x[: len(x) - step], x[step:]), width + step
    return x


class Paragraphs:
    """The paragraphs of some texts, in arrays.

    A line is cut behind a word that ends a sentence if a hash of its last two words is even, and behind
    any word where that hash has six zero bits; so the cuts inside of a passage are the same wherever it stands.
    ``text``, ``number``, ``first``, ``size``: text, place in the text, first word there and words; ``key``: 64-bit
    hash of the words; ``shingles`` and ``of``: hashes of WIDTH-word runs (fewer words: one of all) and their paragraph.
    """

    def __init__(self, texts: list[bytes]):
        import xxhash

        known: dict[bytes, int] = {}
        ids: list[int] = []
        line_ends: list[int] = []
        counts = []
        for text in texts:
            before = len(ids)
            for line in text.lower().split(b"\n"):
                ids.extend([known.setdefault(w, len(known)) for w in line.split()])
                line_ends.append(len(ids))
            counts.append(len(ids) - before)
        n = len(ids)
        flat = np.array(ids, np.int64)
        vocabulary = list(known)
        hashes = np.array([xxhash.xxh64_intdigest(w, 3) for w in vocabulary] or [0], np.uint64)[flat]
        stops = np.array([w[-1:] in b".!?" for w in vocabulary] or [False], bool)[flat]
        with np.errstate(over="ignore"):
            pair = _mix(hashes * GOLDEN + np.concatenate([hashes[:1], hashes[:-1]]))
            last = (stops & (pair & np.uint64(1) == 0)) | (pair & np.uint64(63) == 0)
            ends = np.array(line_ends, np.int64)
            last[ends[ends > 0] - 1] = True
            stop = np.flatnonzero(last) + 1 if n else np.zeros(0, np.int64)
            start = np.concatenate([[0], stop[:-1]]) if n else stop
            self.size = stop - start
            starts_of_text = np.concatenate([[0], np.cumsum(counts)[:-1]]) if counts else np.zeros(0, np.int64)
            full = np.flatnonzero(np.array(counts) > 0)
            self.text = full[np.searchsorted(starts_of_text[full], start, side="right") - 1] if n else stop
            self.first = start - starts_of_text[self.text]
            heads = np.flatnonzero(np.concatenate([[True], self.text[1:] != self.text[:-1]])) if n else stop
            self.number = np.arange(len(start)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(start)]]))) if n else stop
            place = np.arange(n) - np.repeat(start, self.size)
            weighed = _mix(hashes + place.astype(np.uint64) * GOLDEN)
            self.key = np.add.reduceat(weighed, start).view(np.int64) if n else stop
            of = np.repeat(np.arange(len(start)), self.size)
            run = hashes[: max(0, n - WIDTH + 1)].copy()
            for k in range(1, WIDTH):
                run = _mix(run * GOLDEN + hashes[k : n - WIDTH + 1 + k])
            whole = of[: len(run)] == of[WIDTH - 1 :] if n >= WIDTH else np.zeros(0, bool)
            short = np.flatnonzero(self.size < WIDTH)
            made, owner = np.concatenate([run[whole], self.key[short].view(np.uint64)]), np.concatenate([of[: len(run)][whole], short])
        order = np.argsort(owner, kind="stable")
        self.shingles, self.of = made[order], owner[order]

    def bands(self, which: np.ndarray, count: int, rows: int) -> np.ndarray:
        """(paragraphs ``which`` x count): hashes of the band's number and ``rows`` minima each."""
        made = np.empty((len(which), count), np.int64)
        if not len(which):
            return made
        own = np.zeros(len(self.key), bool)
        own[which] = True
        shingles, of = self.shingles[own[self.of]], self.of[own[self.of]]
        starts = np.searchsorted(of, which)
        with np.errstate(over="ignore"):
            for band in range(count):
                total = np.full(len(which), band, np.uint64)
                for row in range(rows):
                    number = np.uint64(band * rows + row + 1)
                    least = np.minimum.reduceat((shingles ^ (number * GOLDEN)) * (number * np.uint64(0xC2B2AE3D27D4EB4E) + np.uint64(1)), starts)
                    total = _mix(total * GOLDEN + least)
                made[:, band] = total.view(np.int64)
        return made


class Words:
    """Hashes of the words of some texts one behind the other, and where each text starts (one entry more at the end)."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        known: dict[bytes, int] = {}
        ids: list[int] = []
        self.edges = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            ids.extend([known.setdefault(w, len(known)) for w in text.lower().split()])
            self.edges[i + 1] = len(ids)
        self.hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in known] or [0], np.uint64)[np.array(ids, np.int64)]

    def runs(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each place on; the last ones reach into the next text."""
        run = self.hashes[: max(0, len(self.hashes) - width + 1)].copy()
        with np.errstate(over="ignore"):
            for k in range(1, width):
                run = _mix(run * GOLDEN + self.hashes[k : len(self.hashes) - width + 1 + k])
        return run

    def inside(self, width: int) -> np.ndarray:
        """Whether the ``width`` words from each place on are of one text."""
        text = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        return text[: max(0, len(text) - width + 1)] == text[width - 1 :]

    def anchors(self, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of short runs, so that any ``least_words`` words in a row hold one, the same wherever they stand.

        It is the least hash, ties all, of the short runs in each window of that many words (winnowing).
        """
        width = min(8, (least_words + 1) // 2)
        run, many = self.runs(width), least_words - width + 1
        if len(run) < many:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = _over(np.minimum, run, many)
        around = np.concatenate([np.zeros(many - 1, np.uint64), least, np.zeros(many - 1, np.uint64)])
        at = np.flatnonzero((_over(np.maximum, around, many) == run) & self.inside(width))
        return at, run[at].view(np.int64)


def anchors(docs: DataFrame, least_words: int) -> DataFrame:
    """(d, anchor, at): the anchors of each text and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = Words(bytes_of(part.column("text")))
            at, made = found.anchors(least_words)
            d = part.column("d").to_numpy(zero_copy_only=False)[np.searchsorted(found.edges, at, side="right") - 1]
            place = at - found.edges[np.searchsorted(found.edges, at, side="right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(made), pa.array(place.astype(np.int32))], names=["d", "anchor", "at"])

    return docs.mapInArrow(run, "d long, anchor long, at int")


def live(found: DataFrame, lost: DataFrame, least_words: int) -> DataFrame:
    """The anchors (d, anchor, at) with a word that is not gone (g, gone: first, size) in a window of ``least_words`` around them.

    What is left out stands in removed copies only, so their keeper shares no anchor with them any more. Removed
    parts that meet count as one.
    """
    width = min(8, (least_words + 1) // 2)
    start, end = F.greatest(F.col("at") - (least_words - width), F.lit(0)), F.col("at") + least_words
    covers = lambda g: (g["first"] <= start) & (g["first"] + g["size"] >= end)
    one = F.struct(F.col("gone")[0]["first"].alias("first"), F.col("gone")[0]["size"].alias("size"))
    joined = F.aggregate(
        F.slice("gone", 2, F.size("gone")), F.array(one),
        lambda acc, g: F.when(
            F.element_at(acc, -1)["first"] + F.element_at(acc, -1)["size"] >= g["first"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), (F.greatest(g["first"] + g["size"], F.element_at(acc, -1)["first"] + F.element_at(acc, -1)["size"]) - F.element_at(acc, -1)["first"]).alias("size")))),
        ).otherwise(F.concat(acc, F.array(g))),
    )
    parts = lost.select("g", joined.alias("gone"))
    return found.join(parts, F.col("d") == F.col("g"), "left").filter(F.col("gone").isNull() | ~F.exists("gone", covers)).select("d", "anchor", "at")


def windows(marked: DataFrame, least_words: int) -> DataFrame:
    """(d, start, h, touched) from (d, text, marks, gone): the runs of ``least_words`` words that hold an anchor of ``marks``,
    but for those whose words are all ``gone`` (first, size); ``touched``: some are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = Words(bytes_of(part.column("text")))
            at, made = found.anchors(least_words)
            text, width = np.searchsorted(found.edges, at, side="right") - 1, min(8, (least_words + 1) // 2)
            d, marks, gone = part.column("d").to_numpy(zero_copy_only=False), part.column("marks"), part.column("gone").to_pylist()
            n, held = len(found.hashes), np.zeros(len(found.hashes) + 1, np.int64)
            for i in range(part.num_rows):
                own = slice(*np.searchsorted(text, [i, i + 1]))
                hit = at[own][np.isin(made[own], marks[i].values.to_numpy(zero_copy_only=False))]
                np.add.at(held, np.maximum(hit - (least_words - width), 0), 1)
                np.add.at(held, hit + 1, -1)
            lost = np.zeros(n + 1, np.int64)
            for i, rows in enumerate(gone):
                for row in rows or ():
                    lost[found.edges[i] + row["first"]] += 1
                    lost[found.edges[i] + row["first"] + row["size"]] -= 1
            lost = np.concatenate([[0], np.cumsum(np.cumsum(lost)[:-1] > 0)])
            many = max(0, n - least_words + 1)
            missing = lost[least_words:] - lost[:many] if many else lost[:0]
            start = np.flatnonzero((np.cumsum(held)[:many] > 0) & found.inside(least_words) & (missing < least_words))
            of = np.searchsorted(found.edges, start, side="right") - 1
            columns = [pa.array(d[of]), pa.array((start - found.edges[of]).astype(np.int32)), pa.array(found.runs(least_words)[start].view(np.int64)), pa.array(missing[start] > 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "start", "h", "touched"])

    return marked.mapInArrow(run, "d long, start int, h long, touched boolean")


def segments(copies: DataFrame, least_words: int) -> DataFrame:
    """(d, first, size, kd, kfirst) from (d, at, gone): words in a row that are not gone and stand at ``kd`` from ``kfirst`` on as well.

    ``at`` has (start, kd, kstart, touched): the windows of a text that repeat and the place where each stays. A word goes by the
    first window that has it and whose place is another one, else by its own. Where some words are gone at the place as well
    (``touched``), what is left counts from WIDTH words on: fewer are equal by chance at the edge of a passage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]
            for d, at, gone in zip(part.column("d").to_pylist(), part.column("at"), part.column("gone").to_pylist()):
                start, kd, kstart, touched = (at.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                order = np.lexsort([start, (kd == d) & (kstart == start)])
                start, kd, kstart, touched = start[order], kd[order], kstart[order], touched[order]
                word = (start[:, None] + np.arange(least_words)).ravel()
                place, once = np.unique(word, return_index=True)
                window = once // least_words
                kept = np.ones(len(place), bool)
                for row in gone or ():
                    kept &= (place < row["first"]) | (place >= row["first"] + row["size"])
                place, window = place[kept], window[kept]
                if not len(place):
                    continue
                where, shift = kd[window], kstart[window] - start[window]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(shift) != 0) | (where[1:] != where[:-1])]))
                size = np.diff(np.append(new, len(place)))
                whole = (size >= WIDTH) | (touched[window[new]] == 0)
                new, size = new[whole], size[whole]
                out.append([np.full(len(new), d), place[new], size, where[new], place[new] + shift[new]])
            columns = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32 if i in (1, 2, 4) else np.int64)) for i, x in enumerate(columns)], names=["d", "first", "size", "kd", "kfirst"])

    return copies.mapInArrow(run, "d long, first int, size int, kd long, kfirst int")


def equal_runs(docs: DataFrame, gone: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, d, first, size, cluster, removed): runs of ``least_words`` words or more that two documents (doc_id, d, text) have
    and that are not ``gone`` (d, first, size) yet, wherever they stand in a line.

    Winnowing finds each such run: texts that share one share an anchor in it. Around shared anchors all windows of
    ``least_words`` words are counted; one that two documents have stays at its first place (least id, then
    place) and goes elsewhere. The words that stay are cut where a copy of them starts or ends, so the parts of
    a cluster are equal. Repeated rows change nothing: all that is counted here are different d, and ``segments`` takes a window once,
    so neither texts nor windows are dealt out to drop them.
    """
    lost = stored(gone.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("first", "size"))).alias("gone")).withColumnRenamed("d", "g"))
    every = stored(anchors(docs.select("d", "text"), least_words))
    twice = lambda rows: stored(rows.groupBy("anchor").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select(F.col("anchor").alias("k")))
    few = lambda keys: F.broadcast(keys) if keys.count() <= FEW else keys
    shared = twice(every)
    left = stored(live(every.join(few(shared), F.col("anchor") == F.col("k")).drop("k"), lost, least_words))
    released(every, shared)
    shared = twice(left)
    marks = left.join(few(shared), F.col("anchor") == F.col("k")).groupBy("d").agg(F.collect_set("anchor").alias("marks"))
    marks = stored(marks.join(lost, F.col("d") == F.col("g"), "left").select(F.col("d").alias("m"), "marks", "gone"))
    released(left, shared)
    freed(docs.sparkSession)
    marked = docs.join(marks, F.col("d") == F.col("m")).select("d", "text", "marks", "gone")
    found = stored(windows(marked, least_words))
    ids = docs.select("doc_id", "d").distinct()
    freed(docs.sparkSession)
    twice = found.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select(F.col("h").alias("w"))
    both = stored(found.join(twice, F.col("h").eqNullSafe(F.col("w"))).select("d", "start", "h", "touched"))
    released(found)
    stay = both.join(ids, "d").groupBy("h").agg(F.min(F.struct("touched", "doc_id", "d", "start")).alias("k"))
    copies = both.join(stay.select(F.col("h").alias("w"), F.col("k.d").alias("kd"), F.col("k.start").alias("kstart"), F.col("k.touched").alias("kt")), F.col("h").eqNullSafe(F.col("w")))  # each side dealt out by itself, so a window that a third of the texts have can be split
    by_text = copies.groupBy("d").agg(F.collect_list(F.struct("start", "kd", "kstart", "kt")).alias("at"))
    by_text = by_text.join(lost, F.col("d") == F.col("g"), "left").select("d", "at", "gone")
    parts = stored(segments(by_text, least_words))
    released(both, marks, lost)
    freed(docs.sparkSession)
    edges = parts.select(F.col("kd").alias("e"), F.explode(F.array(F.col("kfirst"), F.col("kfirst") + F.col("size"))).alias("edge")).distinct()
    edges = edges.groupBy("e").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    end = F.col("kfirst") + F.col("size")
    inner = F.filter("edges", lambda x: (x >= F.col("kfirst")) & (x < end))
    cuts = parts.join(edges, F.col("kd") == F.col("e")).select("d", "first", "kd", "kfirst", end.alias("end"), inner.alias("cuts"))
    ends = F.concat(F.slice("cuts", 2, F.size("cuts")), F.array("end"))
    cuts = cuts.select("d", F.col("first"), "kd", "kfirst", F.explode(F.arrays_zip(F.col("cuts").alias("x"), ends.alias("y"))).alias("p"))
    place = F.col("first") + F.col("p.x") - F.col("kfirst")
    removed = (F.col("d") != F.col("kd")) | (F.col("first") != F.col("kfirst"))
    rows = cuts.select("d", place.alias("first"), (F.col("p.y") - F.col("p.x")).alias("size"), F.xxhash64("kd", "p.x").alias("cluster"), removed.alias("removed"))
    rows = stored(rows)
    released(parts)
    needed = rows.filter("removed").select(F.col("cluster").alias("c")).distinct()
    return rows.join(needed, F.col("cluster") == F.col("c"), "left_semi").join(ids, "d").select("doc_id", "d", "first", "size", "cluster", "removed")


def places(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(d, number, first, size, key, bands) of paragraphs; a batch has the bands of a key once, and of none
    that is too short to be similar to a different one."""
    count, least = bands_for(similarity, recall), least_size(similarity)
    schema = StructType([StructField("d", LongType()), *[StructField(c, IntegerType()) for c in ("number", "first", "size")], StructField("key", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = Paragraphs(bytes_of(part.column("text")))
            if not len(found.key):
                continue
            d = part.column("d").to_numpy(zero_copy_only=False)[found.text]
            once = np.sort(np.unique(found.key, return_index=True)[1])
            once = once[found.size[once] >= least]
            ends = np.zeros(len(found.key) + 1, np.int32)
            ends[once + 1] = count
            values = pa.array(found.bands(once, count, ROWS).ravel())
            made = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), values)
            numbers = [pa.array(x.astype(np.int32)) for x in (found.number, found.first, found.size)]
            yield pa.RecordBatch.from_arrays([pa.array(d), *numbers, pa.array(found.key), made], names=["d", "number", "first", "size", "key", "bands"])

    return docs.mapInArrow(run, StructType([*schema.fields, StructField("bands", ArrayType(LongType()))]))


def shingle_sets(docs: DataFrame, where: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, set): the shingles of the paragraphs ``keys``, read again from one text each that has them (``where``: d, key)."""
    keys = cut(keys)
    few = keys.count() <= FEW
    found_in = where.select(F.col("key").alias("k"), "d").join(F.broadcast(keys) if few else keys, F.col("k") == F.col("key")).groupBy("key").agg(F.min("d").alias("d"))
    texts = cut(found_in.select("d").distinct())
    held = docs.join(F.broadcast(texts) if texts.count() <= FEW else texts, "d", "left_semi")
    wanted = np.sort(np.array([r.key for r in keys.collect()], np.int64)) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = Paragraphs(bytes_of(part.column("text")))
            pick = np.unique(found.key, return_index=True)[1]
            if wanted is not None:
                pick = pick[np.isin(found.key[pick], wanted)]
            edges = np.searchsorted(found.of, np.arange(len(found.key) + 1))
            sets = [np.unique(found.shingles[edges[i] : edges[i + 1]]).view(np.int64) for i in pick]
            yield pa.RecordBatch.from_arrays([pa.array(found.key[pick]), pa.array(sets, pa.list_(pa.int64()))], names=["key", "set"])

    sets = held.select("text").mapInArrow(run, "key long, set array<long>")
    if not few:
        sets = sets.join(keys, "key", "left_semi")
    return stored(sets.dropDuplicates(["key"]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets of shingles have that Jaccard similarity or more."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, least_words: int = 20, recall: float = 0.99) -> DataFrame:
    """(doc_id, number, first_word, n_words, cluster, removed): paragraphs in passages that two documents or more have.

    Equal paragraphs are one node; different ones that share a band of MinHash values and have a Jaccard similarity
    of ``similarity`` on five-word shingles are linked, and clusters are the components. A family of near copies
    is not paired out: members meet the least one of each band first. What is in different clusters after that meets again,
    in bands of over FAMILY members by rare shingles only (``family_links``, which loses no link). Paragraphs in a row that other documents have too make a passage; it counts from ``least_words``
    words on, so stock lines don't. In each cluster the first place (least id, then place) stays, all others are ``removed``.
    Of the words that this leaves, runs of ``least_words`` or more that two documents have to the word are listed as well, wherever
    they start and end in a line (equal_runs); their ``number`` is that of the paragraph in which they start. A word that stays
    may be listed for a paragraph and for such a run; one that goes is listed once.

    Words are what white space leaves, A-Z lower-cased. A document is an id with its text: rows that repeat both are
    one and listed once, null ids too. Null and empty texts have no paragraph. An empty table gives no rows.
    """
    content = F.coalesce(named(text), F.lit(""))
    rows = docs.select(named(doc_id).alias("doc_id"), content.alias("text"), F.xxhash64(named(doc_id), content).alias("d"))
    placed = stored(places(rows.select("d", "text"), similarity, recall))
    every = stored(placed.select("d", "number", "first", "size", "key"))
    bands = stored(placed.filter("size(bands) > 0").select("key", "bands").dropDuplicates(["key"]))
    released(placed)
    freed(docs.sparkSession)
    banded = bands.select("key", F.explode("bands").alias("value"))
    shared = banded.groupBy("value").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select(F.col("value").alias("v"), "lo")
    shared = stored(shared)  # few values are shared, so that all bands need not be shuffled once more
    members = stored(banded.join(F.broadcast(shared) if shared.count() <= FEW else shared, F.col("value") == F.col("v")).select("value", "key", "lo").distinct())
    released(shared, bands)
    freed(docs.sparkSession)
    sets = shingle_sets(rows.select("d", "text"), every, members.select("key").distinct())
    links = cut(verified(members.filter("key <> lo").select(F.col("lo").alias("a"), F.col("key").alias("b")).distinct(), sets, similarity))
    found = components(links)
    classed = members.join(found, F.col("key") == F.col("node"), "left").select("value", "key", F.coalesce("root", "key").alias("class"))
    apart = cut(classed.groupBy("value").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi and n > 2").select("value", "n"))
    left = cut(classed.join(apart, "value"))
    family = stored(left.filter(F.col("n") > FAMILY).select(F.col("key").alias("h"), F.col("class").alias("c")).distinct())
    inside = family_links(stored(sets.withColumnRenamed("key", "h").join(family, "h")), similarity)
    few = left.join(sent(family.select("h")), F.col("key") == F.col("h"), "left").select("value", "key", "class", F.col("h").isNotNull().alias("met"))
    other = few.select("value", F.col("key").alias("b"), F.col("class").alias("c2"), F.col("met").alias("met2"))
    again = few.filter("not met").join(other, "value").filter((F.col("met2") | (F.col("key") < F.col("b"))) & (F.col("class") != F.col("c2")))
    again = again.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()
    found = components(links.union(inside).union(verified(again, sets, similarity)))
    released(members, sets)
    freed(docs.sparkSession)

    where = every.select("d", "number", "first", "size", "key")
    at = F.struct("d", "number")
    by_key = where.groupBy("key").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    by_key = by_key.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("cluster", F.coalesce("root", "key"))
    clusters = by_key.groupBy("cluster").agg(F.min("lo.d").alias("x"), F.max("hi.d").alias("y")).filter("x < y").select("cluster")
    flagged = cut(by_key.join(clusters, "cluster", "left_semi").select(F.col("key").alias("k"), "cluster"))
    kept = where.join(flagged, F.col("key") == F.col("k")).select("d", "number", "first", "size", "cluster").distinct()
    run = F.col("number") - F.row_number().over(Window.partitionBy("d").orderBy("number"))
    long = kept.withColumn("run", run).withColumn("words", F.sum("size").over(Window.partitionBy("d", "run"))).filter(F.col("words") >= least_words)
    ids = rows.select("doc_id", "d").distinct()
    kept_rows = stored(long.select("d", "number", "first", "size", "cluster").join(ids, "d"))
    first = kept_rows.groupBy("cluster").agg(F.min(F.struct("doc_id", "d", "number")).alias("keeper")).withColumnRenamed("cluster", "c")
    removed = (F.col("d") != F.col("keeper.d")) | (F.col("number") != F.col("keeper.number"))
    result = stored(kept_rows.join(first, F.col("cluster") == F.col("c")).select("doc_id", "d", "number", "first", "size", "cluster", removed.alias("removed")))
    more = stored(equal_runs(rows, result.filter("removed").select("d", "first", "size"), least_words))
    starts = where.join(more.select("d").distinct(), "d", "left_semi").groupBy("d").agg(F.array_sort(F.collect_set("first")).alias("starts"))
    number = (F.size(F.filter("starts", lambda x: x <= F.col("first"))) - 1).alias("number")
    more = more.join(starts, "d").select("doc_id", "d", number, "first", "size", "cluster", "removed")
    return result.union(more).select("doc_id", "number", F.col("first").alias("first_word"), F.col("size").alias("n_words"), "cluster", "removed")
