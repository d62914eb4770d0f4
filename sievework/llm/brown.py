"""Scores of a class-based bigram model; exchange clustering assigns words to classes.

First the most frequent words, atoms of their own, and the forms (end of a word and mark behind it) that all others
share are exchanged between classes, on a table of atom pairs whose size is a parameter. Then every other word
with enough counts is exchanged on Spark: the classes before and behind it are counted over the whole training
part, and it moves from its form's class to the one of best gain. Words that are rarer or unseen keep the class of
their form. Transitions are counted over the classes that words have in the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from sievework.llm.common import bytes_of, freed, named, pieces, released, renamed, stored

#: Words that are atoms of their own, atoms of forms, and classes.
FREQUENT, FORMS, CLASSES = 512, 512, 64
#: A word takes part in the exchange from so many training counts on.
LEAST = 3
#: Bits of the table that tells tasks which words may have that many; where it is crowded, some rarer words are counted for nothing.
SLOTS = 1 << 26
#: Neighbour counts that a task holds before it hands them on.
HELD = 1 << 20
#: A part of the corpus is closed at so many bytes of text or different words.
PART_BYTES, PART_WORDS = 16 << 20, 400_000
#: Words of the same task that are remembered with their atom; then it starts over.
REMEMBERED = 400_000
#: The end of a text, a token that no word is equal to.
END = b""


def form_of(word: bytes) -> int:
    """The last two signs before any trailing marks, and the first of these marks, as one of FORMS numbers."""
    stem = word.rstrip(b".,;:!?)\"'*#%&$|")
    return zlib.crc32(stem[-2:] + b"\x00" + word[len(stem) : len(stem) + 1]) % FORMS


def encode(docs: DataFrame) -> DataFrame:
    """Documents (c0, ..., held_out, text) as numbered words, and the words of each part of the corpus.

    A row with ``ids`` is a document: the number of each of its tokens in its part. A row with ``word`` is a word of
    a part: its number, form and count in training texts. Texts are read once; a part is what one task has
    read since its last part, so its table of words stays bounded.
    """
    carried = [f for f in docs.schema.fields if f.name not in ("held_out", "text")]
    fields = [
        StructField("part", LongType()), *carried, StructField("held_out", BooleanType()), StructField("ids", BinaryType()),
        StructField("word", StringType()), StructField("id", IntegerType()), StructField("form", IntegerType()), StructField("n", LongType()),
    ]
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        part, size, number, counts = TaskContext.get().partitionId() << 24, 0, {}, np.zeros(0, np.int64)

        def rows(many: int, **columns: pa.Array) -> pa.RecordBatch:
            made = [columns.get(f.name, pa.nulls(many, t)) for f, t in zip(fields, types)]
            return pa.RecordBatch.from_arrays([c if c.type == t else c.cast(t) for c, t in zip(made, types)], names=[f.name for f in fields])

        def words() -> pa.RecordBatch:
            known = list(number)
            return rows(
                len(known), part=pa.array([part] * len(known), pa.int64()), word=pa.array([w.decode() for w in known], pa.string()),
                id=pa.array(range(len(known)), pa.int32()), form=pa.array([form_of(w) for w in known], pa.int32()), n=pa.array(counts[: len(known)], pa.int64()),
            )

        for piece in pieces(batches, "text"):
            fixed = {"part": pa.int64(), "held_out": pa.bool_(), "ids": pa.binary(), "word": pa.string(), "id": pa.int32(), "form": pa.int32(), "n": pa.int64()}
            types = types or [fixed.get(f.name) or piece.column(f.name).type for f in fields]
            held, blobs = piece.column("held_out").to_pylist(), []
            for text, out in zip(bytes_of(piece.column("text")), held):
                ids = np.array([number.setdefault(w, len(number)) for w in text.lower().split()] + [number.setdefault(END, len(number))], np.int32)
                if len(number) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(number), np.int64)])
                if not out:
                    np.add.at(counts, ids, 1)
                blobs.append(ids.tobytes())
                size += len(text)
            yield rows(piece.num_rows, part=pa.array([part] * piece.num_rows, pa.int64()), ids=pa.array(blobs, pa.binary()), held_out=piece.column("held_out"), **{f.name: piece.column(f.name) for f in carried})
            if size >= PART_BYTES or len(number) >= PART_WORDS:
                yield words()
                part, size, number, counts = part + 1, 0, {}, np.zeros(0, np.int64)
        if number:
            yield words()

    return docs.mapInArrow(run, schema)


def atom_pairs(training: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(pair, n): how often one atom (pair div atoms) comes before another (pair mod atoms); the end stands before a first word."""
    atoms = FREQUENT + FORMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = dict(frequent), np.zeros(atoms * atoms, np.int64)
        end = known.get(END, FREQUENT + form_of(END))
        for piece in pieces(batches, "text"):
            for text in bytes_of(piece.column("text")):
                words = text.lower().split()
                try:
                    ids = [known[w] for w in words]
                except KeyError:
                    if len(known) > REMEMBERED:
                        known = dict(frequent)
                    for w in words:
                        if w not in known:
                            known[w] = FREQUENT + form_of(w)
                    ids = [known[w] for w in words]
                line = np.array([end, *ids, end], np.int64)
                np.add.at(total, line[:-1] * atoms + line[1:], 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["pair", "n"])

    return training.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, rounds: int = 5) -> np.ndarray:
    """The class of each atom, from the counts of atom pairs.

    Every atom in turn, the frequent ones first, goes to the class where the likelihood of the class bigram model is
    highest, until a round moves none or ``rounds`` are over. Atoms start dealt out by frequency.
    """
    n = len(pairs)
    left, right = pairs.sum(axis=0), pairs.sum(axis=1)
    order = np.argsort(-(left + right), kind="stable")
    own = np.empty(n, np.int64)
    own[order] = np.arange(n) % classes
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None], own[None, :]), pairs)
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    for _ in range(rounds):
        moved = 0
        for w in order[(left + right)[order] > 0]:
            a, self_pairs = own[w], pairs[w, w]
            to = np.bincount(own, pairs[w], minlength=classes)
            of = np.bincount(own, pairs[:, w], minlength=classes)
            to[a] -= self_pairs
            of[a] -= self_pairs
            table[a] -= to
            table[:, a] -= of
            table[a, a] -= self_pairs
            rows[a] -= right[w]
            columns[a] -= left[w]
            gain = (_xlogx(table + to[None, :]) - _xlogx(table)).sum(axis=1) + (_xlogx(table + of[:, None]) - _xlogx(table)).sum(axis=0)
            d = np.diagonal(table)
            gain += _xlogx(d + to + of + self_pairs) - _xlogx(d + to) - _xlogx(d + of) + _xlogx(d)
            gain -= _xlogx(rows + right[w]) - _xlogx(rows) + _xlogx(columns + left[w]) - _xlogx(columns)
            b = int(gain.argmax())
            b = a if gain[b] <= gain[a] + 1e-9 else b
            own[w] = b
            table[b] += to
            table[:, b] += of
            table[b, b] += self_pairs
            rows[b] += right[w]
            columns[b] += left[w]
            moved += b != a
        if not moved:
            break
    return own


@dataclass
class Seeds:
    """``frequent``: atom of each frequent word; ``own``: class of each atom; ``table``: how often one class comes before another."""

    frequent: dict[bytes, int]
    own: np.ndarray
    table: np.ndarray

    def of_form(self, word: bytes) -> int:
        return int(self.own[FREQUENT + form_of(word)])

    @property
    def end(self) -> int:
        """The class of the end; it is never moved after the first exchange."""
        return int(self.own[self.frequent.get(END, FREQUENT + form_of(END))])


def seed_classes(vocabulary: DataFrame, training: DataFrame, classes: int = CLASSES) -> Seeds:
    """Classes of the frequent words and of the forms, from a vocabulary (word, c) and the training documents (text)."""
    if classes > 256:
        raise ValueError("a class is written as one byte")
    top = vocabulary.filter("c > 0").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = {r.word.encode(): i for i, r in enumerate(top)}
    pairs = np.zeros((FREQUENT + FORMS, FREQUENT + FORMS))
    met = atom_pairs(training, frequent).toPandas()
    pairs.ravel()[met["pair"].to_numpy(np.int64)] = met["n"].to_numpy(np.int64)
    own = exchange(pairs, classes)
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None], own[None, :]), pairs)
    return Seeds(frequent, own, table)


def slots_of(vocabulary: DataFrame, least: int) -> np.ndarray:
    """A bit for the crc32 of each word with ``least`` counts: a table of fixed size, whatever the vocabulary."""
    slot = F.crc32(F.col("word").cast("binary")) % SLOTS
    many = vocabulary.filter(F.col("c") >= least).select(slot.alias("slot"))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in many.groupBy(F.floor(F.col("slot") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")).toLocalIterator():
        bits[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def contexts(training: DataFrame, seeds: Seeds, slots: np.ndarray) -> DataFrame:
    """(word, code, n): how often a word that is no seed has a class behind it (code below the number of classes) or before it (from there on).

    Counted over whole texts and added up in each task; a word may have several rows of one code. The end is no word.
    """
    classes = len(seeds.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> tuple[dict[bytes, int], list[int], list[bool]]:
            number = {END: 0}
            kind, moves = [seeds.end], [False]
            for w, atom in seeds.frequent.items():
                if w not in number:
                    number[w] = len(kind)
                    kind.append(int(seeds.own[atom]))
                    moves.append(False)
            return number, kind, moves

        def rows() -> Iterator[pa.RecordBatch]:
            key, n = summed(np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held]))
            words = pa.array(list(number), pa.binary()).cast(pa.string())
            for i in range(0, len(key), 100_000):
                part = key[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(part // (2 * classes))), pa.array((part % (2 * classes)).astype(np.int32)), pa.array(n[i : i + 100_000])], names=["word", "code", "n"],
                )

        (number, kind, moves), held, size = start(), [], 0
        for piece in pieces(batches, "text"):
            line = [0]
            for text in bytes_of(piece.column("text")):
                for w in text.lower().split():
                    at = number.get(w)
                    if at is None:
                        at = number[w] = len(kind)
                        slot = zlib.crc32(w) % SLOTS
                        kind.append(seeds.of_form(w))
                        moves.append(bool(slots[slot >> 3] >> (slot & 7) & 1))
                    line.append(at)
                line.append(0)
            ids = np.array(line, np.int64)
            of = np.array(kind, np.int64)[ids]
            at = np.flatnonzero(np.array(moves)[ids])
            held.append(summed(np.concatenate([ids[at] * (2 * classes) + of[at + 1], ids[at] * (2 * classes) + classes + of[at - 1]])))
            size += len(held[-1][0])
            if size >= HELD or len(number) >= REMEMBERED:
                yield from rows()
                held, size = [], 0
                if len(number) >= REMEMBERED:
                    number, kind, moves = start()
        if held:
            yield from rows()

    return training.select("text").mapInArrow(run, "word string, code int, n long")


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its counts added up (one a key where ``n`` is not given)."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, minlength=len(found)).astype(np.int64)


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of best gain for words 0, 1, ..., from rows (word, code, n) without repeats, ordered by word; each word has a row.

    A word's counts are taken out of its old class and put into each class in turn; what other classes have stays. A word
    moves only if the likelihood rises.
    """
    classes, many = len(table), len(old)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    behind = code < classes
    # A row a neighbour class, a column a class of the word: what stands there before the word comes.
    stands = np.where(behind[:, None], table.T[code % classes], table[code % classes])
    own = (np.arange(len(word)), old[word])
    stands[own] = np.maximum(stands[own] - n, 0)
    gain = np.add.reduceat(_xlogx(stands + n[:, None]) - _xlogx(stands), starts, axis=0)
    for side, total in ((behind, table.sum(axis=1)), (~behind, table.sum(axis=0))):
        c = np.bincount(word, n * side, minlength=many)[:, None]
        stands = np.repeat(total[None, :], many, axis=0)
        stands[np.arange(many), old] = np.maximum(stands[np.arange(many), old] - c[:, 0], 0)
        gain -= _xlogx(stands + c) - _xlogx(stands)
    best = gain.argmax(axis=1)
    rises = gain[np.arange(many), best] > gain[np.arange(many), old] + 1e-9
    return np.where(rises, best, old)


def moved(found: DataFrame, seeds: Seeds, least: int) -> DataFrame:
    """(word, class) of every word with ``least`` counts, from ``contexts``.

    Rows meet by word, in order, and are worked off batch by batch: no word's rows but those of a batch's last one wait for the next.
    """
    classes = len(seeds.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: pa.RecordBatch) -> pa.RecordBatch:
            runs = pa.compute.run_end_encode(rows.column("word"))
            ends = runs.run_ends.to_numpy()
            at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            key, n = summed(at * (2 * classes) + rows.column("code").to_numpy(), rows.column("n").to_numpy())
            word, code = key // (2 * classes), key % (2 * classes)
            often = np.bincount(word, n * (code < classes), minlength=len(ends)) >= least
            keep = often[word]
            number = np.cumsum(often) - 1
            names = runs.values.filter(pa.array(often))
            old = np.array([seeds.of_form(w) for w in names.cast(pa.binary()).to_pylist()], np.int64)
            best = best_classes(number[word[keep]], code[keep], n[keep], old, seeds.table) if len(old) else old
            return pa.RecordBatch.from_arrays([names, pa.array(best.astype(np.int32))], names=["word", "class"])

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            ends = pa.compute.run_end_encode(batch.column("word")).run_ends.to_numpy()
            cut = int(ends[-2]) if len(ends) > 1 else 0
            if cut:
                yield settled(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None:
            yield settled(rest)

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, class int")


def classified(vocabulary: DataFrame, training: DataFrame, seeds: Seeds, least: int = LEAST) -> DataFrame:
    """(word, c, class, placed): the class of each word of a vocabulary (word, c, form), and if its own neighbours were asked for it."""
    spark = vocabulary.sparkSession
    later = moved(contexts(training, seeds, slots_of(vocabulary, least)), seeds, least)
    first = spark.createDataFrame([(w.decode(), int(seeds.own[a])) for w, a in seeds.frequent.items()], "word string, class int")
    placed = later.union(first).select(F.col("word").alias("_word"), F.col("class").alias("_class"))
    forms = F.array(*[F.lit(int(k)) for k in seeds.own[FREQUENT:]])
    found = vocabulary.join(placed, F.col("word") == F.col("_word"), "left")
    return found.select("word", "c", F.coalesce("_class", F.get(forms, F.col("form"))).alias("class"), F.col("_class").isNotNull().alias("placed"))


@dataclass
class Model:
    """``sizes``, ``kinds``: tokens and words of each class; ``end``: class of the end; ``tokens``, ``words``: of the whole training part."""

    sizes: np.ndarray
    kinds: np.ndarray
    end: int

    @property
    def tokens(self) -> int:
        return int(self.sizes.sum())

    @property
    def words(self) -> int:
        return int(self.kinds.sum())

    def moves(self, after: np.ndarray, prior: float = 5.0) -> np.ndarray:
        """log10 of class after class from their counts, smoothed towards the class's share."""
        share = (self.sizes + 0.5) / (self.sizes.sum() + 0.5 * len(self.sizes))
        return np.log10((after + prior * share) / (after.sum(axis=1, keepdims=True) + prior))


def fit(known: DataFrame, seeds: Seeds) -> Model:
    """Sizes of the classes of a vocabulary (word, c, class)."""
    each = known.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).toPandas()
    at = each["class"].to_numpy(np.int64)
    sizes, kinds = (np.bincount(at, each[k].to_numpy(np.float64), minlength=len(seeds.table)) for k in ("c", "v"))
    return Model(sizes, kinds, seeds.end)


def paths(coded: DataFrame, known: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """Documents with their counts, base score, emission score and classes (``path``, a byte a token); beside them rows (pair, n)
    of class after class in each part's training documents.

    A part's documents and words meet in a task; there are as many tasks as keep a few parts each.
    """
    classes = len(model.sizes)
    listed = coded.filter("word is not null").select("part", "word", "id")
    known = known.select(F.col("word").alias("_word"), "c", "class")
    of_part = listed.join(known, F.col("word") == F.col("_word")).select("part", "id", "c", "class")
    texts = coded.filter("ids is not null").select(F.col("part").alias("of"), *carried, "held_out", "ids")
    made = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "emission": pa.float64(), "path": pa.binary(), "pair": pa.int64(), "n": pa.int64()}

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        size = words.num_rows
        place = words.column("id").to_numpy()
        counts, kind = np.zeros(size), np.zeros(size, np.int64)
        counts[place], kind[place] = words.column("c").to_numpy(), words.column("class").to_numpy()
        base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
        emit = np.log10((counts + 0.5) / (model.sizes[kind] + 0.5 * (model.kinds[kind] + 1)))
        found, ways, after = np.zeros((own.num_rows, 4)), [], np.zeros(classes * classes, np.int64)
        for i, (blob, out) in enumerate(zip(own.column("ids").to_pylist(), own.column("held_out").to_pylist())):
            ids = np.frombuffer(blob, np.int32)
            k = kind[ids]
            found[i] = len(ids), (counts[ids] > 0).sum(), base[ids].sum(), emit[ids].sum()
            ways.append(k.astype(np.uint8).tobytes())
            if not out:
                after += np.bincount(np.r_[model.end, k[:-1]] * classes + k, minlength=classes * classes)
        met = np.flatnonzero(after)
        values = [found[:, 0].astype(np.int64), found[:, 1].astype(np.int64), found[:, 2], found[:, 3], ways, None, None]
        names = [*carried, "held_out"]
        whole = [*[own.column(c).combine_chunks() for c in names], *[pa.nulls(len(found), t) if v is None else pa.array(v, t) for v, t in zip(values, made.values())]]
        beside = [*[pa.nulls(len(met), own.column(c).type) for c in names], *[pa.nulls(len(met), t) for t in list(made.values())[:5]], pa.array(met), pa.array(after[met])]
        return pa.concat_tables([pa.table(whole, names=[*names, *made]), pa.table(beside, names=[*names, *made])])

    kept = [f for f in texts.schema.fields if f.name not in ("of", "ids")]
    schema = StructType([*[StructField(f.name, f.dataType) for f in kept], *[StructField(c, {pa.int64(): LongType(), pa.float64(): DoubleType(), pa.binary(): BinaryType()}[t]) for c, t in made.items()]])
    tasks = max(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), coded.select("part").distinct().count() // 2)
    return texts.repartition(tasks, "of").groupBy("of").cogroup(of_part.repartition(tasks, "part").groupBy("part")).applyInArrow(run, schema)


def score(docs: DataFrame, *, held_out: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: all columns but the text) with held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learned from the documents that ``held_out`` (a condition on ``docs``; null counts as false) leaves. Tokens are the words
    of the whole text, A-Z lower-cased, and one end. A token's probability is that of its class after the class before
    (the end's before the first word), smoothed towards the class's share, times the word's in its class, (c + 0.5) /
    (tokens + 0.5 (words + 1)): unseen words share what one word with no count has. The base score uses the last
    formula over all words at once. Null texts are empty: one token, the end. Without training documents every
    count is 0. Repeated rows count and are scored each; an empty table gives no rows. A very long text is a part of its
    own, whose words and classes one task holds.
    """
    kept = [c for c in docs.columns if c != text] if carry is None else carry
    rows = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(named(text), F.lit("")).alias("text"))
    coded = stored(encode(rows))
    vocabulary = stored(coded.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"), F.max("form").alias("form")))
    training = rows.filter(~F.col("held_out"))
    seeds = seed_classes(vocabulary, training)
    known = stored(classified(vocabulary, training, seeds))
    released(vocabulary)
    freed(docs.sparkSession)
    model = fit(known, seeds)
    carried = [f"c{i}" for i in range(len(kept))]
    found = stored(paths(coded, known, model, carried))
    released(coded, known)
    after = np.zeros(model.sizes.size**2)
    for r in found.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        after[r.pair] = r.n
    moves = model.moves(after.reshape(model.sizes.size, -1))
    read = found.filter("path is not null").drop("pair", "n")
    columns = [*carried, "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("emission").to_numpy().copy()
            for i, way in enumerate(batch.column("path").to_pylist()):
                k = np.frombuffer(way, np.uint8)
                whole[i] += moves[np.r_[model.end, k[:-1]], k].sum()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(whole)], names=[*columns, "score"])

    scored = read.mapInArrow(run, StructType([*[read.schema[c] for c in columns], StructField("score", DoubleType())]))
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    scored = scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select(*renamed(kept, ["held_out", *made, "perplexity"]), "held_out", *made, perplexity)
