"""Greedy paragraph packing as array accumulators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import is_blank, split_paragraphs, unnest
from sievework.operators.positions import with_neighbours, with_position
from sievework.session import cut

STRINGS = "array<string>"
SOURCE = "struct<url:string,title:string,search_query:string>"
PARAGRAPH = r"(?U)\n\s*\n"


def _no_strings() -> Column:
    return F.array().cast(STRINGS)


def cut_fixed(text: Column, step: int) -> Column:
    """Pieces of ``step`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(step)))


def split_sentences_pack(paragraph: Column, size: int) -> Column:
    """Sentences packed up to ``size``; a longer sentence is cut."""
    sentences = F.split(paragraph, r"(?U)(?<=[.!?])\s+")
    start = F.struct(_no_strings().alias("done"), _no_strings().alias("cur"), F.lit(0).alias("n"))

    def flushed(acc):
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(
            acc["done"]
        )

    def step(acc, s):
        n = F.length(s)
        return (
            F.when(
                n > size,
                F.struct(
                    F.concat(flushed(acc), cut_fixed(s, size)).alias("done"), _no_strings().alias("cur"), F.lit(0).alias("n")
                ),
            )
            .when(
                (acc["n"] + n > size) & (F.size(acc["cur"]) > 0),
                F.struct(flushed(acc).alias("done"), F.array(s).alias("cur"), (n + 1).alias("n")),
            )
            .otherwise(
                F.struct(
                    acc["done"].alias("done"),
                    F.concat(acc["cur"], F.array(s)).alias("cur"),
                    (acc["n"] + n + 1).alias("n"),
                )
            )
        )

    return F.aggregate(sentences, start, step, flushed)


def overlap_tail(paragraphs: Column, overlap: int) -> Column:
    """Last paragraphs up to ``overlap`` characters, as struct(cur, n)."""
    start = F.struct(_no_strings().alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(acc, p):
        n = F.length(p)
        taken = F.struct(
            F.concat(F.array(p), acc["cur"]).alias("cur"),
            (acc["n"] + n + 4).alias("n"),
            ((acc["n"] + n > overlap) | (acc["n"] + n + 4 >= overlap)).alias("stop"),
        )
        left = F.struct(acc["cur"].alias("cur"), acc["n"].alias("n"), F.lit(True).alias("stop"))
        too_big = acc["n"] + n > overlap
        allowed = (F.size(acc["cur"]) == 0) | (acc["n"] + n <= 2 * overlap)
        return F.when(acc["stop"], acc).when(too_big & ~allowed, left).otherwise(taken)

    return F.aggregate(
        F.reverse(paragraphs), start, step, lambda a: F.struct(a["cur"].alias("cur"), a["n"].alias("n"))
    )


def pack(paragraphs: Column, size: int, overlap: int = 0, by_sentence: bool = False) -> Column:
    """Greedy packing; a paragraph counts its length plus four."""
    start = F.struct(_no_strings().alias("done"), _no_strings().alias("cur"), F.lit(0).alias("n"))

    def flushed(acc):
        return F.when(
            F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n")))
        ).otherwise(acc["done"])

    def long_parts(p):
        return split_sentences_pack(p, size) if by_sentence else cut_fixed(p, size - 100)

    def step(acc, p):
        n = F.length(p)
        if overlap:
            tail = overlap_tail(acc["cur"], overlap)
            fresh_cur, fresh_n = F.concat(tail["cur"], F.array(p)), tail["n"] + n + 4
        else:
            fresh_cur, fresh_n = F.array(p), n + 4
        return (
            F.when(
                n > size,
                F.struct(F.concat(flushed(acc), long_parts(p)).alias("done"), _no_strings().alias("cur"), F.lit(0).alias("n")),
            )
            .when(
                (acc["n"] + n > size) & (F.size(acc["cur"]) > 0),
                F.struct(flushed(acc).alias("done"), fresh_cur.alias("cur"), fresh_n.alias("n")),
            )
            .otherwise(
                F.struct(
                    acc["done"].alias("done"),
                    F.concat(acc["cur"], F.array(p)).alias("cur"),
                    (acc["n"] + n + 4).alias("n"),
                )
            )
        )

    return F.aggregate(paragraphs, start, step, flushed)


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need size > 0 and 0 <= overlap < size")


def chunk_text(
    df: DataFrame, doc: str, text: str, size: int = 8000, overlap: int = 500, delimiter: str = PARAGRAPH
) -> DataFrame:
    """One row per chunk; a text that fits stays whole."""
    check_sizes(size, overlap)
    body = F.col(text)
    packed = pack(split_paragraphs(body, delimiter), size, overlap, by_sentence=True)
    chunks = F.when(is_blank(body), _no_strings()).when(F.length(body) <= size, F.array(body)).otherwise(packed)
    rows = df.select(doc, chunks.alias("_chunks"))
    return unnest(rows, [doc, F.size("_chunks").alias("total_chunks")], F.col("_chunks"), "chunk", "chunk_index")


def chunk_each(
    df: DataFrame, doc: str, text: str, size: int = 50000, delimiter: str = PARAGRAPH, max_paragraphs: int | None = None
) -> DataFrame:
    """Every text packed on its own, without overlap.

    Whole texts by default; ``max_paragraphs`` gives the capped form.
    """
    parts = split_paragraphs(F.col(text), delimiter)
    if max_paragraphs:
        parts = F.slice(parts, 1, max_paragraphs)
    rows = df.withColumn("_chunks", pack(parts, size))
    keep = [c for c in df.columns if c != text]
    return unnest(rows, [*keep, F.size("_chunks").alias("total_chunks")], F.col("_chunks"), "chunk", "chunk_index")


def separator(source: Column) -> Column:
    return F.concat(
        F.lit("--- SOURCE: "),
        F.coalesce(source["title"], F.lit("Unknown")),
        F.lit(" | URL: "),
        F.coalesce(source["url"], F.lit("Unknown")),
        F.lit(" ---"),
    )


def chunk_batch(
    df: DataFrame, group: str, order: str, text: str, size: int = 50000, delimiter: str = PARAGRAPH, apart_above: int | None = None
) -> DataFrame:
    """(group, part, chunk_index, total_chunks, chunk, sources).

    ``df`` has ``group``, ``order``, ``text`` and the source columns url, title and search_query. A group whose texts fit
    one chunk stays whole; all others are packed paragraph by paragraph, with a line between texts, the same way for any
    size of a group (pack_groups), and never gathered. With ``apart_above``, groups of over so many chunk sizes are chunked text by
    text instead (``part`` is then the order of the text).
    """
    check_sizes(size, 0)
    source = F.struct(F.col("url").cast("string"), F.col("title").cast("string"), F.col("search_query").cast("string"))
    texts = df.filter(~is_blank(F.col(text))).select(
        F.col(group).alias("_g"), F.col(order).cast("long").alias("part"), F.col(text).alias("text"), source.cast(SOURCE).alias("source")
    )
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))  # read five times
    totals = cut(texts.groupBy(F.col("_g").alias("_t")).agg(F.sum(F.length("text")).alias("_chars"), F.count(F.lit(1)).alias("_texts")))
    totals = F.broadcast(totals) if totals.count() <= FEW else totals
    sized = texts.join(totals, F.col("_g").eqNullSafe(F.col("_t"))).drop("_t")
    fits = F.col("_chars") + (F.col("_texts") - 1) * 6 <= size
    gathered = sized.filter(fits).groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("part", "text", "source"))).alias("m"))
    whole = F.aggregate(
        "m",
        F.lit(""),
        lambda acc, m: F.when(acc == "", m["text"]).otherwise(
            F.concat(acc, F.lit("\n\n"), separator(m["source"]), F.lit("\n\n"), m["text"])
        ),
    )
    columns = ["_g", "part", "chunk_index", "total_chunks", "chunk", "sources"]
    none = F.lit(None).cast("long").alias("part")
    single = gathered.select("_g", none, F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), whole.alias("chunk"), F.transform("m", lambda m: m["source"]).alias("sources"))
    rest, apart = sized.filter(~fits), F.lit(False)
    if apart_above is not None:
        apart = F.col("_chars") > apart_above * size
    packed = pack_groups(rest.filter(~apart).drop("_chars", "_texts"), size, delimiter).select("_g", none, "chunk_index", "total_chunks", "chunk", "sources")
    out = single.unionByName(packed)
    if apart_above is not None:
        each = chunk_each(rest.filter(apart).select("_g", "part", "text", "source"), "part", "text", size, delimiter)
        out = out.unionByName(each.withColumn("sources", F.array("source")).select(*columns))
    return out.withColumnRenamed("_g", group)


#: Blocks of a group's stream that a task packs, in chunk sizes.
BLOCK_CHUNKS = 16
#: Groups of which so many totals go to every executor; more are joined by a shuffle.
FEW = 100_000
ITEM, ENTRY, MARK = 0, 1, 2


def pack_groups(texts: DataFrame, size: int, delimiter: str = PARAGRAPH) -> DataFrame:
    """(_g, chunk_index, total_chunks, chunk, sources) from (_g, part, text, source): greedy packing without gathering a group.

    The paragraphs of a group are one stream, with a separator before each text but the first. With the characters before
    each of them (prefix sums), the chunk that starts at one ends at the first paragraph that lies beyond ``size`` characters, so
    each paragraph has a next start, whether it is one or not. The stream is cut into blocks of a bounded number of characters; a
    block needs the first chunk size of the next one only. Each block tells for every paragraph at its head where a chunk sequence that
    enters there leaves; which of these are real is found by pointer doubling over blocks; then blocks write their chunks.
    """
    line = separator(F.col("source"))
    paragraphs = split_paragraphs(F.col("text"), delimiter)
    # written texts are sent twice: to their numbers, and to their blocks
    rows = texts if "id" in texts.columns else cut(texts.withColumn("id", F.monotonically_increasing_id()))
    rows = rows.select("id", F.struct("_g").alias("g"), "part", "source", F.concat(F.array(line), paragraphs).alias("items"))
    lengths = F.transform("items", F.length)
    narrow = rows.select("id", "g", "part", F.xxhash64("source", "items").alias("same"), lengths.alias("lengths"), F.size("items").cast("long").alias("many"))
    narrow = narrow.withColumn("chars", F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x + 4))
    placed = cut(with_position(narrow, "part", ["g"], ["same"], sums={"j0": "many", "p0": "chars"}))
    numbers = placed.select("g", "j0", "p0", "pos", F.col("lengths").alias("items"), F.lit(None).cast(SOURCE).alias("source"))
    stream = cut(_stream(numbers, size).drop("text", "source"))
    block = [F.col("g"), F.col("b")]

    # a group of one block has no chunk sequence that enters from another one
    long = stream.groupBy("g").agg(F.max("b").alias("last")).filter("last > 0").select(F.col("g").alias("h"))
    several = stream.join(long, F.col("g") == F.col("h"), "left_semi")
    edges = cut(several.groupBy(*block).applyInPandas(_leaves(size), "g " + _type(stream, "g") + ", b long, a long, x long, known boolean"))
    reached = edges.filter("known").select("g", "a")
    jumps = edges.filter("x is not null").select("g", "a", "x")
    seen = reached.count()
    while True:
        on = lambda r, j: r.withColumnRenamed("g", "h").join(j, (F.col("h") == F.col("g")) & (F.col("at") == F.col("a")))
        further = on(reached.withColumnRenamed("a", "at"), jumps).select("g", F.col("x").alias("a"))
        reached = cut(reached.union(further).distinct())
        if (now := reached.count()) == seen:
            break
        seen = now
        jumps = cut(on(jumps.select("g", F.col("a").alias("first"), F.col("x").alias("at")), jumps).select("g", F.col("first").alias("a"), "x"))

    real = edges.select("g", "b", "a").join(reached, ["g", "a"], "left_semi")
    entries = cut(real.select("g", "b", F.lit(ENTRY).alias("kind"), F.lit(True).alias("home"), F.col("a").alias("j")))
    # how many chunks start in a block follows from the numbers; one row for each block is summed up here
    counts = cut(stream.unionByName(entries, allowMissingColumns=True).groupBy(*block).applyInPandas(_count(size), "g " + _type(stream, "g") + ", b long, n long"))
    by_group = Window.partitionBy("g")
    starts = counts.select("g", "b", F.coalesce(F.sum("n").over(by_group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by_group).alias("all"))
    told = placed.select(F.col("id").alias("_id"), "j0", "p0", "pos")
    whole = _stream(rows.join(told, F.col("id") == F.col("_id")), size)
    made = whole.unionByName(entries, allowMissingColumns=True).groupBy(*block).applyInPandas(_write(size), "g " + _type(stream, "g") + f", b long, i int, chunk string, sources array<{SOURCE}>")
    told = made.join(starts.withColumnsRenamed({"g": "h", "b": "c"}), (F.col("g") == F.col("h")) & (F.col("b") == F.col("c")))
    return told.select("g._g", (F.col("before") + F.col("i")).cast("int").alias("chunk_index"), F.col("all").cast("int").alias("total_chunks"), "chunk", "sources")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _stream(placed: DataFrame, size: int) -> DataFrame:
    """(g, b, kind, home, j, p, n, text, source): each paragraph with its number and the characters before it, in its block, and once
    more in the block before if it stands within a chunk size of its head. MARK rows say that a chunk starts at a number anyhow.
    Where ``items`` are lengths instead of paragraphs, there are no texts."""
    width, whole = BLOCK_CHUNKS * size, _type(placed, "items") == STRINGS

    def run(batches):
        for batch in batches:
            at, out = {n: batch.column(n).to_pylist() for n in ("j0", "p0", "pos", "items")}, []
            for row, (j, p, pos, items) in enumerate(zip(at["j0"], at["p0"], at["pos"], at["items"])):
                for k, text in enumerate(items):
                    n, text = (len(text), text) if whole else (text, None)
                    if k or pos > 1:
                        said = row if k else None  # separators have no source
                        out.append((row, p // width, ITEM, True, j, p, n, text, said))
                        if p % width < size + 5 and p >= width:
                            out.append((row, p // width - 1, ITEM, False, j, p, n, text, said))
                    if n > size and (k or pos > 1) or pos == 1 and k == 0:
                        out.append((row, (p + n + 4) // width, MARK, True, j + 1, p + n + 4, 0, None, None))
                    j, p = j + 1, p + n + 4
            rows, *columns, said = zip(*out) if out else [()] * 9
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            g, source = (batch.column(c).take(pa.array(r, pa.int64())) for c, r in (("g", rows), ("source", said)))
            yield pa.RecordBatch.from_arrays([g, *arrays, source], names=["g", "b", "kind", "home", "j", "p", "n", "text", "source"])

    schema = f"g {_type(placed, 'g')}, b long, kind int, home boolean, j long, p long, n long, text string, source {SOURCE}"
    return placed.select("g", "j0", "p0", "pos", "items", "source").mapInArrow(run, schema)


def _next_starts(items: pd.DataFrame, size: int) -> np.ndarray:
    """For each paragraph the row of the one that starts the chunk after a chunk that starts there; the number of rows if none is at hand."""
    p, n = (items[c].to_numpy().astype(np.int64) for c in ("p", "n"))
    after = np.searchsorted(p + n, p + size, side="right")
    return np.maximum(after, np.arange(len(p)) + 1)


def _leaves(size: int):
    """Of a block: (a, x, known) for each paragraph where a chunk may start first, and the start behind the block that follows from it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        items = frame[frame["kind"] == ITEM].sort_values("j").reset_index(drop=True)
        own = items["home"].to_numpy().astype(bool)
        j, n, ahead = items["j"].to_numpy(), items["n"].to_numpy().astype(np.int64), _next_starts(items, size)
        known = np.isin(j, frame.loc[frame["kind"] == MARK, "j"].to_numpy())
        leave = np.full(len(items), -1, np.int64)  # row behind the block
        for i in range(len(items) - 1, -1, -1):
            if not own[i]:
                leave[i] = i
            elif n[i] <= size and ahead[i] < len(items) and n[ahead[i]] <= size:
                leave[i] = leave[ahead[i]]
        p = items["p"].to_numpy()
        asked = np.flatnonzero(own & (n <= size) & (known | (p % (BLOCK_CHUNKS * size) < size + 5)))
        found = [int(j[leave[i]]) if leave[i] >= 0 else None for i in asked]
        first = frame["b"].iloc[0]
        return pd.DataFrame({"g": pd.Series([frame["g"].iloc[0]] * len(asked), dtype=object), "b": first, "a": j[asked], "x": pd.array(found, "Int64"), "known": known[asked]})

    return run


def _started(frame: pd.DataFrame, size: int) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """The paragraphs of a block in order, and (first, end) of what becomes a chunk, or several of one long paragraph, and starts there."""
    items = frame[frame["kind"] == ITEM].sort_values("j").reset_index(drop=True)
    own, j, n, ahead = items["home"].to_numpy().astype(bool), items["j"].to_numpy(), items["n"].to_numpy().astype(np.int64), _next_starts(items, size)
    start, out = np.isin(j, frame.loc[frame["kind"] != ITEM, "j"].to_numpy()) | (n > size), []
    for i in np.flatnonzero(own).tolist():
        if start[i]:
            end = i + 1 if n[i] > size else int(ahead[i])
            if n[i] <= size and end < len(items):
                start[end] = True
            out.append((i, end))
    return items, out


def _count(size: int):
    """Of a block: how many chunks start in it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        items, found = _started(frame, size)
        n = items["n"].to_numpy().astype(np.int64)
        chunks = sum(-(-int(n[i]) // (size - 100)) if n[i] > size else 1 for i, _ in found)
        return pd.DataFrame({"g": pd.Series([frame["g"].iloc[0]], dtype=object), "b": [frame["b"].iloc[0]], "n": [chunks]})

    return run


def _write(size: int):
    """Of a block: (i, chunk, sources) of the chunks that start in it, in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        items, found = _started(frame, size)
        texts, sources, out = items["text"].tolist(), items["source"].tolist(), []
        for i, end in found:
            if len(texts[i]) > size:
                own_source = [sources[i]] if isinstance(sources[i], dict) else []
                out += [(texts[i][k : k + size - 100], own_source) for k in range(0, len(texts[i]), size - 100)]
                continue
            by_url: dict = {}
            for text, source in zip(texts[i:end], sources[i:end]):
                if isinstance(source, dict) and source["url"]:
                    by_url[source["url"]] = source
            out.append(("\n\n".join(texts[i:end]), list(by_url.values())))
        made = pd.DataFrame({"chunk": pd.Series([c for c, _ in out], dtype=object), "sources": pd.Series([s for _, s in out], dtype=object)})
        made.insert(0, "i", np.arange(len(out), dtype="int32"))
        made.insert(0, "b", frame["b"].iloc[0])
        made.insert(0, "g", pd.Series([frame["g"].iloc[0]] * len(out), dtype=object))
        return made

    return run


def chunk_stats(chunks: DataFrame, text: str = "chunk", sources: str | None = None) -> DataFrame:
    """C09."""
    size = F.length(text)
    out = [
        F.count(F.lit(1)).alias("chunks"),
        F.avg(size).alias("avg_size"),
        F.min(size).alias("min_size"),
        F.max(size).alias("max_size"),
    ]
    if sources:
        out.append(F.avg(F.size(sources)).alias("avg_sources"))
    return chunks.agg(*out)


def chunk_overlap_check(chunks: DataFrame, doc: str, window: int = 1000) -> DataFrame:
    """Shortest and longest suffix of a chunk that is found in the head of the next one.

    A suffix that is found has all its own suffixes found too, so the shortest one is a
    single character and the longest one is found by halving.
    """
    pairs = with_neighbours(
        chunks.select(doc, "chunk_index", "chunk"), "chunk_index", [doc], following={"next_chunk": "chunk"}
    ).filter(F.col("next_chunk").isNotNull())
    tail, head = F.right("chunk", F.lit(window)), F.left("next_chunk", F.lit(window))
    rows = pairs.select(doc, "chunk_index", tail.alias("tail"), head.alias("head"))
    top = F.least(F.lit(window), F.length("tail"), F.length("head")) - 1
    steps = F.array(*[F.lit(1 << k) for k in range(window.bit_length(), -1, -1)])
    longest = F.aggregate(
        steps,
        F.lit(0),
        lambda n, k: F.when((n + k <= top) & F.contains("head", F.right("tail", n + k)), n + k).otherwise(n),
    )
    rows = rows.withColumn("longest", longest)
    return rows.select(
        doc,
        "chunk_index",
        F.least("longest", F.lit(1)).alias("overlap"),
        "longest",
        F.contains("head", F.lit("---")).alias("has_separator"),
    )


def rows_to_text_chunks(df: DataFrame, group: str, order: str, size: int = 50000) -> DataFrame:
    """C11: each record as indented JSON text, then batch chunking."""
    columns = [c for c in df.columns if c not in (group, order)]
    body = F.to_json(F.struct(*columns), {"pretty": "true"})
    texts = df.select(
        group,
        order,
        body.alias("text"),
        F.col(order).cast("string").alias("url"),
        F.lit("record").alias("title"),
        F.lit(None).cast("string").alias("search_query"),
    )
    return chunk_batch(texts, group, order, "text", size)
