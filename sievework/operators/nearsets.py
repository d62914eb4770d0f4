"""Pairs of near-equal token sets by signatures of parts (J10, D04), with disk in proportion to the sets and the pairs found.

Two sets whose Jaccard is above t differ in fewer than (na + nb) * (1 - t) / (1 + t) tokens. Tokens are dealt into more parts than that by
their hash, so some parts are the same in both; a set has a row for each of its parts. Rows that share a part are compared by
a sketch inside the task, so only pairs that are near by their sketch are written. Sets that share most parts with
one leader are a family: its pairs come from blocks of whole sets, once each, not from every part that they share. What family a set
falls into changes the way that its pairs take, never which pairs there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import unnest
from sievework.operators.components import components
from sievework.session import cut, freed

#: Parts are equal in two near sets: one by the bound, and so many more, so that it isn't empty parts alone.
SPARE = 2
#: Sets of a family, or rows that share a part, that are compared with each other in a task.
BLOCK, ROWS = 512, 4096
#: Slots of the table that marks ids; it goes to all executors.
SLOTS = 1 << 20
PAIRS, COLUMNS = 1 << 19, 4096


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes (splitmix)."""
    x = x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _size_classes(doublings: int) -> np.ndarray:
    """The greatest size of each class; one class holds sizes up to a fifth apart."""
    ends, low = [], 1
    while low <= 1 << doublings:
        ends.append(max(low, low * 6 // 5))
        low = ends[-1] + 1
    return np.array(ends)


def _rows_of(column: pa.Array, kind: str) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, all tokens one after the other, and the row of each."""
    n = _rows_of(batch.column("n"), "int64")
    return n, batch.column("tokens").flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def part_rows(sets: DataFrame, threshold: float) -> DataFrame:
    """(sig, id, n, own): a row for each part of a set, for the class of its own size and for those of larger sets that may be near it.

    A pair meets in the class of its larger set. Empty parts have a row only where they might be all that a near pair shares.
    """
    apart = (1 - threshold) / (1 + threshold)

    def parts(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, tokens, row = _sets_of(batch)
                if not len(tokens):
                    continue
                most = np.floor(n / threshold + 1e-9).astype("int64")
                ends = _size_classes(int(most.max()).bit_length())
                differ = np.floor(2 * ends * apart + 1e-9).astype("int64")
                many = differ + 1 + SPARE
                place, value = _mix(tokens, 1) >> np.uint64(20), _mix(tokens, 2)
                own, last = np.searchsorted(ends, n), np.searchsorted(ends, most)
                for step in range(int((last - own).max()) + 1):
                    kind = np.minimum(own + step, last)
                    there = np.where(own + step <= last, many[kind], 0)
                    start = np.cumsum(there) - there
                    used = there[row] > 0
                    slot = start[row[used]] + (place[used] % many[kind][row[used]].astype(np.uint64)).astype("int64")
                    total = int(there.sum())
                    signed = np.zeros(total, dtype=np.uint64)
                    np.add.at(signed, slot, value[used])
                    owner = np.repeat(np.arange(len(n)), there)
                    empty = np.bincount(slot, minlength=total) == 0
                    enough = np.bincount(owner, weights=empty, minlength=len(n)) >= (many - differ)[kind]
                    kept = ~empty | enough[owner]
                    key = _mix(signed + _mix(kind[owner] * (1 << 32) + (np.arange(total) - start[owner]), 7), 3)[kept]
                    held = pa.array(owner[kept])
                    columns = [pa.array(key.view("int64")), batch.column("id").take(held), batch.column("n").take(held), pa.array(np.full(len(held), step == 0))]
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "id", "n", "own"])

    return sets.select("id", "n", "tokens").mapInArrow(parts, f"sig long, id {_kind(sets)}, n int, own boolean")


def sketches(sets: DataFrame) -> DataFrame:
    """(id, n, sketch): which bits an odd number of a set's tokens falls on. Two sketches differ in no more bits than the sets in tokens."""

    def drawn(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, tokens, row = _sets_of(batch)
                width = _bits(n)
                start = np.cumsum(width) - width
                slot = start[row] + ((_mix(tokens, 2) >> np.uint64(40)).astype("int64") & (width[row] - 1))
                odd = np.packbits((np.bincount(slot, minlength=int(width.sum())) & 1).astype(bool)).tobytes()
                bits = pa.array([odd[s // 8 : (s + w) // 8] for s, w in zip(start.tolist(), width.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), bits], ["id", "n", "sketch"])

    return sets.select("id", "n", "tokens").mapInArrow(drawn, f"id {_kind(sets)}, n int, sketch binary")


def _bits(n: np.ndarray) -> np.ndarray:
    """Bits of a sketch: a power of two, not below the size but for the largest sets."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1))), 6, 13).astype("int64")


def _kind(df: DataFrame, column: str = "id") -> str:
    return df.schema[column].dataType.simpleString()


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches again, cut between two values of ``key``, by which the rows are sorted."""

    def joined(held):
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[0].column(key)[0].as_py() != keys[0]):
            if held or last:
                yield joined([*held, batch.slice(0, last)] if last else held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield joined(held)


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and how long it is."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are; -1 for null."""
    return pa.compute.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def repeated_parts(sets: DataFrame, threshold: float) -> DataFrame:
    """Rows of :func:`part_rows` whose part some other set shares too, with the number of those rows and the first id whose own class it is."""

    def shared(batches):
        for batch in _whole_runs(batches, "sig"):
            own = batch.column("own").to_numpy(zero_copy_only=False)
            starts, length = _starts(batch.column("sig").to_numpy(zero_copy_only=False))
            first = np.minimum.reduceat(np.where(own, np.arange(len(own)), len(own)), starts)
            good = (length > 1) & (first < len(own))
            if good.any():
                held = pa.array(np.flatnonzero(np.repeat(good, length)))
                some = pa.RecordBatch.from_arrays([c.take(held) for c in batch.columns], batch.schema.names)
                columns = [*some.columns, pa.array(np.repeat(length, length)[held].astype("int32")), batch.column("id").take(pa.array(np.repeat(first[good], length[good])))]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "id", "n", "own", "size", "lead"])

    kind = _kind(sets)
    rows = part_rows(sets, threshold).repartition("sig").sortWithinPartitions("sig", "id")
    return rows.mapInArrow(shared, f"sig long, id {kind}, n int, own boolean, size int, lead {kind}")


def families_of(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, root, blocks): sets that share half of their parts with one that comes first, and with what that leads to."""
    apart = (1 - threshold) / (1 + threshold)
    met = rows.filter("id <> lead").groupBy("id", "n", "lead").agg(F.count(F.lit(1)).alias("shared"))
    near = met.filter(F.col("shared") >= F.col("n") * apart + 1 + SPARE / 2)
    best = near.groupBy("id").agg(F.max_by("lead", F.struct("shared", "lead")).alias("lead"))
    found = cut(components(best.select(F.col("id").alias("a"), F.col("lead").alias("b"))))
    sizes = found.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return found.join(sizes, "root").select(F.col("node").alias("id"), "root", "blocks")


def _hold(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """Fewer of the sets, all of those with one of the ids among them: ids are marked in a table of fixed size, so that no set is shuffled for it."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("_slot")
    marked = ids.select(slot).distinct()
    return sets.withColumn("_slot", slot).join(F.broadcast(marked), "_slot", "left_semi").drop("_slot")


def sketched_pairs(rows: DataFrame, sets: DataFrame, families: DataFrame, threshold: float) -> DataFrame:
    """(low, high, na, nb): pairs that share a part and are near by their sketches, but for those of one family; each of them once."""
    apart, kind = (1 - threshold) / (1 + threshold), _kind(sets)

    def near(batches):
        for batch in _whole_runs(batches, "key"):
            n, own, side, between = (_rows_of(batch.column(c), k) for c, k in (("n", "int64"), ("own", "bool"), ("side", "int32"), ("between", "bool")))
            ids, roots = _codes(batch.column("id")), _codes(batch.column("root"))
            starts, length = _starts(batch.column("key").to_numpy(zero_copy_only=False))
            after = np.repeat(starts + length, length) - np.arange(len(n)) - 1
            sums = np.cumsum(after)
            at = 0
            while at < len(n):
                end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
                count = after[at:end]
                a = np.repeat(np.arange(at, end), count)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
                at = end
                fits = (own[a] | own[b]) & (ids[a] != ids[b]) & ((roots[a] != roots[b]) | (roots[a] < 0)) & ((side[a] != side[b]) | ~between[a])
                fits &= np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * threshold - 1e-9
                a, b = a[fits], b[fits]
                if len(a):
                    fits = _differing(batch.column("sketch"), n, a, b) <= (n[a] + n[b]) * apart + 1e-9
                    a, b = pa.array(a[fits]), pa.array(b[fits])
                    columns = [batch.column("id").take(a), batch.column("id").take(b), batch.column("n").take(a), batch.column("n").take(b)]
                    yield pa.RecordBatch.from_arrays(columns, ["low", "high", "na", "nb"])

    chunks = F.ceil(F.col("size") / ROWS).cast("int")
    known = rows.withColumn("chunks", chunks).join(sketches(_hold(sets, rows)), ["id", "n"]).join(families.select("id", "root"), "id", "left")
    # a part that very many rows share is compared chunk by chunk
    side = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = unnest(known.withColumn("side", side), ["sig", "id", "n", "own", "root", "side", "sketch"], F.sequence(F.lit(0), F.col("chunks") - 1), "other")
    dealt = dealt.withColumn("key", F.xxhash64("sig", F.least("side", "other"), F.greatest("side", "other")))
    dealt = dealt.select("key", "id", "n", "own", "root", "side", (F.col("side") != F.col("other")).alias("between"), "sketch")
    pairs = dealt.repartition("key").sortWithinPartitions("key", "id").mapInArrow(near, f"low {kind}, high {kind}, na int, nb int")
    return pairs.distinct()


def _differing(column: pa.Array, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of rows a and b differ, at the width of the narrower one."""
    out = np.empty(len(a), dtype="int64")
    width = _bits(n)
    least = np.minimum(width[a], width[b])
    for w in np.unique(least):
        at = np.flatnonzero(least == w)
        rows, where = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        bits = np.empty((len(rows), w // 64), dtype=np.uint64)
        for wide in np.unique(width[rows]):
            mine = np.flatnonzero(width[rows] == wide)
            folded = np.frombuffer(b"".join(column.take(pa.array(rows[mine])).to_pylist()), dtype=np.uint64).reshape(len(mine), -1)
            while folded.shape[1] > w // 64:
                folded = folded[:, : folded.shape[1] // 2] ^ folded[:, folded.shape[1] // 2 :]
            bits[mine] = folded
        for part in range(0, len(at), 1 << 16):
            x, y = where[: len(at)][part : part + (1 << 16)], where[len(at) :][part : part + (1 << 16)]
            out[at[part : part + (1 << 16)]] = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype="int64")
    return out


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(low, high, sim) of the pairs whose whole sets are near."""
    some = _hold(sets, pairs.select(F.col("low").alias("id")).union(pairs.select("high")))
    a = some.select(F.col("id").alias("low"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = some.select(F.col("id").alias("high"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(a, ["low", "na"]).join(b, ["high", "nb"])
    return both.select("low", "high", (common / (F.col("na") + F.col("nb") - common)).alias("sim")).filter(F.col("sim") > threshold)


def family_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(low, high, sim): near pairs of one family, low from ``left`` and high from ``right`` (id, n, tokens, root, blocks).

    Two blocks of a family meet in a task; a set is sent once for each block of its family.
    """
    kind, same = _kind(left), left is right

    def near(batches):
        for batch in _whole_runs(batches, "key"):
            for start, length in zip(*_starts(batch.column("key").to_numpy(zero_copy_only=False))):
                met = batch.slice(start, length)
                n, block, late = (_rows_of(met.column(c), "int32") for c in ("n", "block", "late"))
                between = bool(met.column("between")[0].as_py())
                if same:
                    x = block == block[0] if between else np.ones(len(n), dtype=bool)
                    y = ~x if between else x
                else:
                    x, y = late == 0, late == 1
                x, y = np.flatnonzero(x), np.flatnonzero(y)
                if not len(x) or not len(y):
                    continue
                shared = _shared(met, x, y)
                enough = shared > (n[x][:, None].astype("int64") + n[y][None, :] - shared) * threshold - 1e-9
                a, b = (v.astype("int64") for v in np.nonzero(enough))
                sim = shared[a, b] / (n[x[a]].astype("int64") + n[y[b]] - shared[a, b])
                a, b = x[a], y[b]
                ids = _codes(met.column("id"))
                fits = (sim > threshold) & (ids[a] != ids[b])
                if not same:
                    fits &= (a < b) & ((block[a] != block[b]) | (not between))
                elif not between:
                    fits &= a < b
                low, high = pa.array(np.minimum(a, b)[fits]), pa.array(np.maximum(a, b)[fits])
                yield pa.RecordBatch.from_arrays([met.column("id").take(low), met.column("id").take(high), pa.array(sim[fits])], ["low", "high", "sim"])

    members = left.withColumn("late", F.lit(0))
    if not same:
        members = members.unionByName(right.withColumn("late", F.lit(1)))
    members = members.filter("root is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = unnest(members, ["id", "n", "tokens", "root", "late", "block"], F.sequence(F.lit(0), F.col("blocks") - 1), "other")
    dealt = dealt.withColumn("key", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")))
    dealt = dealt.select("key", "id", "n", "tokens", "late", "block", (F.col("block") != F.col("other")).alias("between"))
    # of equal ids the late one comes last, so that the order of rows is that of ids
    return dealt.repartition("key").sortWithinPartitions("key", "id", "late").mapInArrow(near, f"low {kind}, high {kind}, sim double")


def _shared(batch: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens each of the sets x shares with each of the sets y."""
    _, tokens, row = _sets_of(batch)
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    starts, length = _starts(tokens)
    often = length > 1
    kept = np.repeat(often, length)
    column, row = np.repeat(np.arange(often.sum()), length[often]), row[kept]
    here = np.zeros((2, batch.num_rows), dtype="int64")
    here[0, x], here[1, y] = np.arange(1, len(x) + 1), np.arange(1, len(y) + 1)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    ends = np.searchsorted(column, np.arange(0, int(often.sum()) + COLUMNS, COLUMNS))
    for k, (begin, end) in enumerate(zip(ends, ends[1:])):
        sides = []
        for at, size in zip(here, (len(x), len(y))):
            place = at[row[begin:end]]
            dense = np.zeros((size + 1, COLUMNS), dtype=np.float32)
            dense[place, column[begin:end] - k * COLUMNS] = 1
            sides.append(dense[1:])
        out += sides[0] @ sides[1].T
    return out.astype("int64")


def near_sets(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Near pairs (low, high, sim) that aren't in one family, and the sets of families (id, n, tokens, root, blocks), for :func:`family_pairs`.

    ``sets`` (id, n, tokens) are stored and not empty, their tokens 64-bit hashes.
    """
    sets = sets.select("id", "n", "tokens").filter("id is not null")
    freed(sets.sparkSession)
    rows = cut(repeated_parts(sets, threshold))
    freed(sets.sparkSession)
    families = cut(families_of(rows, threshold))
    pairs = cut(sketched_pairs(rows, sets, families, threshold))
    freed(sets.sparkSession)
    return verified(pairs, sets, threshold), _hold(sets, families).join(families, "id")


def near_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """All near pairs (low, high, sim) of the sets, each once."""
    loose, members = near_sets(sets, threshold)
    return loose.unionByName(family_pairs(members, members, threshold))
