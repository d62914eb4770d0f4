"""Prefix trie of conversations by truncation peeling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import named, released, stored

#: Turns below one node that a task peels by itself; nodes with more below them are peeled by depth, all tasks together.
MOST = 4096
#: Bytes of one piece of a list of ids.
PIECE = 1 << 18
#: A turn of a path: the 128-bit key of the prefix that ends with it, and the code points of its text.
STEP = "struct<a:bigint,b:bigint,n:bigint>"
#: What is known of a node while conversations below it are still to come.
PARTIAL = f"path array<{STEP}>, depth int, conv long, convs long, kids long, leaves long, saved long"
NODE = "a long, b long, pa long, pb long, conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long"


def shared_turns(conv_id: Column, most: int = 6) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % most).cast("int")


def turn_table(conversations: DataFrame, *, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, x, y, n): 120 bits of the MD5 of each turn's role and text, and its text's code points, numbered from 1.

    Turns go by number, null first, and ties by role, then MD5 of the text. Texts are read once and don't leave the scan.
    """
    who, said = F.coalesce(named(role), F.lit("")), F.coalesce(named(text), F.lit(""))
    rows = conversations.select(named(conv_id).cast("long").alias("c"), named(turn).alias("t"), who.alias("r"), F.md5(said.cast("binary")).alias("s"), F.char_length(said).cast("long").alias("n"))
    rows = rows.filter("c is not null").withColumn("m", F.md5(F.concat("s", "r").cast("binary")))
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "r", "s")
    half = lambda first: F.conv(F.substring("m", first, 15), 16, 10).cast("long")
    return rows.select("c", F.row_number().over(order).alias("pos"), half(1).alias("x"), half(16).alias("y"), "n")


def rebuilt(turns: DataFrame, most: int = 6) -> DataFrame:
    """(c, path): each conversation with its first turns taken from the first one of its hundred, as keys of its prefixes.

    The key of a prefix is the XOR of two 64-bit hashes of each turn with its place, so it follows from the turns alone.
    """
    step = F.struct("pos", "x", "y", "n")
    own = turns.groupBy("c").agg(F.array_sort(F.collect_list(step)).alias("own"))
    heads = turns.filter((F.col("c") % 100 == 0) & (F.col("pos") < most)).groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(step)).alias("head"))
    both = own.join(heads, F.col("c") - F.col("c") % 100 == F.col("base"), "left").withColumn("h", shared_turns(F.col("c"), most))
    none = F.array().cast("array<struct<pos:int,x:bigint,y:bigint,n:bigint>>")
    head = F.filter(F.coalesce("head", none), lambda s: s["pos"] <= F.col("h"))
    tail = F.filter("own", lambda s: s["pos"] > F.col("h"))
    placed = F.transform(F.concat(head, tail), lambda s, i: F.struct(F.xxhash64(i, s["x"], s["y"]).alias("a"), F.xxhash64(s["y"], i, s["x"]).alias("b"), s["n"].alias("n")))
    return both.select("c", placed.alias("turns"))


def with_keys(paths: DataFrame) -> DataFrame:
    """(c, path): the turns' hashes, XORed up to each turn, so that a step's (a, b) names the whole prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, lists = batch.column("c"), batch.column("turns")
            flat = lists.flatten()
            a, b, n = (flat.field(f).to_numpy(zero_copy_only=False).copy() for f in ("a", "b", "n"))
            ends = lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            start = 0
            for end in ends.tolist():
                for values in (a, b):
                    values[start:end] = _running_xor(values[start:end])
                start = end
            steps = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])
            made = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), steps)
            yield pa.RecordBatch.from_arrays([c, made], names=["c", "path"])

    def _running_xor(values):
        import numpy as np

        return np.bitwise_xor.accumulate(values) if len(values) else values

    return paths.mapInArrow(run, f"c long, path array<{STEP}>")


def key_at(path: str, depth: Column | int) -> tuple[Column, Column]:
    """Key of a path's prefix of that depth; (0, 0) is the root's."""
    step = F.try_element_at(F.col(path), F.lit(depth) if isinstance(depth, int) else depth) if not isinstance(depth, int) or depth > 0 else None
    if step is None:
        return F.lit(0).cast("long"), F.lit(0).cast("long")
    return F.coalesce(step["a"], F.lit(0)), F.coalesce(step["b"], F.lit(0))


def peel_level(partials: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, what is left): the nodes of one depth from all that is known of them, and each without its last turn.

    Newly ended conversations and surviving nodes with the same sequence merge in an aggregate, so a map task sends one row for each
    node it has: a node that a third of the conversations share is no hot task.
    """
    a, b = key_at("path", depth)
    merged = partials.withColumns({"a": a, "b": b}).groupBy("a", "b").agg(
        F.min(F.struct("conv", "path")).alias("first"), F.sum("convs").alias("convs"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )
    path = F.col("first.path")
    said = F.try_element_at(path, F.lit(depth))["n"] if depth else F.lit(0)
    merged = merged.select("a", "b", path.alias("path"), F.col("first.conv").alias("conv"), "convs", "kids", F.greatest("leaves", F.lit(1)).alias("leaves"), (F.col("saved") + (F.col("convs") - 1) * said).alias("saved"))
    pa_, pb = key_at("path", depth - 1) if depth else (F.lit(None).cast("long"), F.lit(None).cast("long"))
    nodes = merged.select("a", "b", pa_.alias("pa"), pb.alias("pb"), F.col("conv").alias("conv_id"), F.lit(depth).alias("depth"), F.col("convs").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    left = merged.select(F.slice("path", 1, max(depth - 1, 0)).alias("path"), F.lit(depth - 1).alias("depth"), "conv", "convs", F.lit(1).cast("long").alias("kids"), "leaves", "saved")
    return nodes, left


def peel_band(partials: DataFrame, low: int) -> DataFrame:
    """Rows of NODE, and of PARTIAL at depth ``low``, from partials below that depth: each task peels whole subtrees by itself.

    Rows are dealt out and sorted by their key at depth ``low``, so a task holds one subtree at a time; the caller has
    measured that none of them has many turns.
    """
    a, b = key_at("path", low)
    dealt = partials.withColumns({"ka": a, "kb": b}).repartition("ka", "kb").sortWithinPartitions("ka", "kb")
    fields = ["a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    def subtree(rows: list[dict]) -> tuple[list[tuple], tuple]:
        levels: dict[int, dict] = {}
        for row in rows:
            path = [(s["a"], s["b"], s["n"]) for s in row["path"]]
            merge(levels, path, row["depth"], (row["conv"], row["convs"], row["kids"], row["leaves"], row["saved"]))
        nodes = []
        for depth in range(max(levels), low, -1):
            for (x, y), (path, conv, convs, kids, leaves, saved) in levels.pop(depth, {}).items():
                leaves, saved = max(leaves, 1), saved + (convs - 1) * path[depth - 1][2]
                up = path[depth - 2] if depth > 1 else (0, 0, 0)
                nodes.append((x, y, up[0], up[1], conv, depth, convs, kids, leaves, saved))
                merge(levels, path, depth - 1, (conv, convs, 1, leaves, saved))
        (path, *known), = levels[low].values()
        return nodes, (path[:low], low, *known)

    def merge(levels: dict, path: list, depth: int, new: tuple) -> None:
        at = levels.setdefault(depth, {})
        key = path[depth - 1][:2] if depth else (0, 0)
        old = at.get(key)
        at[key] = (path, *new) if old is None else (path if new[0] < old[1] else old[0], min(old[1], new[0]), *(x + y for x, y in zip(old[2:], new[1:])))

    def batch_of(nodes: list[tuple], rest: list[tuple]) -> pa.RecordBatch:
        made = [dict(zip(fields, n)) for n in nodes]
        left = [dict(zip(["path", "depth", "conv", "convs", "kids", "leaves", "saved"], r)) | {"path": [dict(zip("abn", s)) for s in r[0]]} for r in rest]
        step = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))
        node = pa.struct([(f, pa.int32() if f == "depth" else pa.int64()) for f in fields])
        partial = pa.struct([("path", step), ("depth", pa.int32()), *((f, pa.int64()) for f in ("conv", "convs", "kids", "leaves", "saved"))])
        return pa.RecordBatch.from_arrays([pa.array(made + [None] * len(left), node), pa.array([None] * len(made) + left, partial)], names=["node", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, nodes, rest = None, [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["ka"], row["kb"]) != key:
                    if held:
                        made, last = subtree(held)
                        nodes += made
                        rest.append(last)
                        if len(nodes) > 4 * MOST:
                            yield batch_of(nodes, rest)
                            nodes, rest = [], []
                    key, held = (row["ka"], row["kb"]), []
                held.append(row)
        if held:
            made, last = subtree(held)
            yield batch_of(nodes + made, [*rest, last])

    node = ", ".join(f"{f.split()[0]}:{f.split()[1]}" for f in NODE.split(", "))
    partial = ", ".join(f"{f.split(' ', 1)[0]}:{f.split(' ', 1)[1]}" for f in PARTIAL.split(", "))
    return dealt.mapInArrow(run, f"node struct<{node}>, left struct<{partial}>")


def reach(partials: DataFrame, deepest: int, most: int) -> int:
    """The least depth, of those 1, 2, 4, ... above ``deepest`` and the root, below none of whose nodes over ``most`` turns lie; else ``deepest``."""
    tried = sorted({max(deepest - (1 << i), 0) for i in range(deepest.bit_length() + 1)}, reverse=True)
    rows = partials.select("depth", F.explode(F.array(*[F.struct(F.lit(d).alias("low"), *[k.alias(n) for k, n in zip(key_at("path", d), "ab")]) for d in tried])).alias("at")).filter("depth > at.low")
    sizes = rows.groupBy("at").agg(F.sum(F.col("depth") - F.col("at.low")).alias("n")).groupBy("at.low").agg(F.max("n").alias("n")).collect()
    low = deepest
    for d in tried:
        if next((r.n for r in sizes if r.low == d), 0) > most:
            break
        low = d
    return low


def peeled(partials: DataFrame, most: int = MOST) -> DataFrame:
    """Every node (NODE) of the trie, from its ends (PARTIAL, one for each different sequence), deepest first.

    Each step takes all that is known of the depths from ``deepest`` on: conversations that end there and nodes that survived.
    Where subtrees are small, a task peels many depths of one at once (peel_band); where one node has
    too much below it, a single depth is peeled by all tasks together (peel_level).
    """
    ended = partials
    deepest = ended.agg(F.max("depth")).first()[0]
    nodes, left = [], None
    while deepest is not None and deepest >= 0:
        live = ended.filter(F.col("depth") <= deepest)
        live = live if left is None else live.union(left.select(live.columns))
        low = reach(live, deepest, most) if deepest else 0
        if low < deepest:
            made = stored(peel_band(live.filter(F.col("depth") > low), low))
            nodes.append(made.filter("node is not null").select("node.*"))
            left, deepest = made.filter("left is not null").select("left.*"), low
        else:
            found, rest = peel_level(live.filter(F.col("depth") == deepest), deepest)
            both = found.select(F.struct(*found.columns).alias("node"), F.lit(None).cast(_struct(rest)).alias("left"))
            made = stored(both.union(rest.select(F.lit(None).cast(_struct(found)).alias("node"), F.struct(*rest.columns).alias("left"))))
            nodes.append(made.filter("node is not null").select("node.*"))
            left, deepest = made.filter("left is not null").select("left.*"), deepest - 1
    made = nodes[0]
    for more in nodes[1:]:
        made = made.union(more)
    return made


def _struct(df: DataFrame) -> str:
    return df.schema.simpleString()


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of the conversations (a, b, c) that end at a node, ascending, joined by commas.

    Ids are range-partitioned by node and id, so a node that a third of them end at is sorted by many tasks, which write its list
    in pieces. The digest of one text has to be taken piece by piece; a task holds one piece at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, text, rows = None, 0, [], []
        for batch in batches:
            for a, b, c in zip(*(batch.column(f).to_pylist() for f in ("a", "b", "c"))):
                if (a, b) != key or len(text) * 8 >= PIECE:
                    if text:
                        rows.append((*key, first, ",".join(text)))
                    key, first, text = (a, b), c, []
                text.append(str(c))
            yield _rows(rows)
            rows = []
        if text:
            yield _rows([(*key, first, ",".join(text))])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(4)], names=["a", "b", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(f).to_pylist() for f in ("a", "b", "ids"))):
                if (a, b) != key:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if key is not None:
            rows.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 2 else pa.int64()) for i in range(3)], names=["a", "b", "ends_sha256"])

    pieces = ends.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(pack, "a long, b long, first long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = MOST) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node of the trie.

    Each conversation takes its first turns from the first one of its hundred (``rebuilt``). Equal sequences fall into one row
    first; from the greatest depth on, newly ended ones merge with the surviving nodes, lose their last turn and are grouped
    again, so nodes are found and summed up in one pass (``peeled``).

    Null roles and texts are empty; turns without a number come first, ties go by role, then MD5 of the text; repeated rows
    are turns of their own. Rows without a conversation's id belong to none and aren't read. A conversation without turns is a
    member of the root; an empty table has no node, as it has no member. A conversation is held as a row of 24 bytes a
    turn, whatever its texts are. Sequences are told apart by 128-bit hashes. Other columns aren't read.
    """
    paths = stored(with_keys(rebuilt(turn_table(conversations, conv_id=conv_id, turn=turn, role=role, text=text))))
    depth = F.size("path")
    a, b = (F.coalesce(k, F.lit(0)) for k in (F.try_element_at("path", F.greatest(depth, F.lit(1)))["a"], F.try_element_at("path", F.greatest(depth, F.lit(1)))["b"]))
    ends = paths.withColumns({"a": a, "b": b})
    zero = F.lit(0).cast("long")
    firsts = ends.groupBy("a", "b").agg(F.min(F.struct("c", "path")).alias("m"), F.count(F.lit(1)).alias("convs"))
    partials = stored(firsts.select(F.col("m.path").alias("path"), F.size("m.path").alias("depth"), F.col("m.c").alias("conv"), "convs", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved")))
    digests = stored(end_digests(ends.select("a", "b", "c")))
    if partials.isEmpty():
        nodes = partials.sparkSession.createDataFrame([], NODE)
    else:
        nodes = peeled(partials, most)
    nodes = stored(nodes)
    up = nodes.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(up, (F.col("pa") == F.col("ua")) & (F.col("pb") == F.col("ub")), "left")
    said = told.join(digests.withColumnsRenamed({"a": "ea", "b": "eb"}), (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), "left")
    released(paths, partials)
    return said.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
