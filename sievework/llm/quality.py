"""Quality rules whose limits come from the corpus: mergeable quantile sketches by language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.llm.common import cut, group_key, named, pieces, renamed

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct"]
#: Measures in thousandths, each with the side on which it is bad and the least spread that counts as a spread:
#: a group whose texts are all alike in a measure still lets its texts differ by three of those.
MEASURES = {
    "symbols": ("high", 5), "marks": ("high", 15), "capitals": ("high", 100), "dup_lines": ("high", 200), "repeats": ("high", 60),
    "word_length": ("both", 800), "variety": ("low", 100),
}


#: So many groups' limits are sent to every executor; more are joined by a shuffle.
FEW_GROUPS = 20_000


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 5-word windows that are found twice or more in the text, the first included; distinct words."""
    if not words:
        return 0, 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n, m = len(ids), len(number)
    if n < 6 or m == n:
        return 0, m
    window = ids
    for size in range(2, 6):  # ids of windows, one word longer each time, as small numbers
        window = window[:-1] * m + ids[size - 1 :]
        if size == 5 or int(window.max()) >= (1 << 62) // m:
            window = np.unique(window, return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    if not again.any():
        return 0, m
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + 5, -1)
    return int((np.cumsum(edges)[:n] > 0).sum()), m


def counts_of(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    raw = text.encode()
    words = raw.split()  # of bytes: exactly the six blanks
    repeat, distinct = repeated_words(words)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text.isascii() else sum(map(str.isupper, text))
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
        len(lines), upper, text.count("!"), distinct,
    )


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds COUNTS to the other columns, in Arrow batches cut by bytes; null counts as empty."""
    fields = [f for f in docs.schema.fields if f.name != text or keep_text]
    names = [f.name for f in fields]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            made = np.array([counts_of(t or "") for t in part.column(text).to_pylist()], np.int64).T
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *map(pa.array, made)], names=[*names, *COUNTS])

    return docs.mapInArrow(add, StructType(fields + [StructField(c, LongType()) for c in COUNTS]))


def measures() -> Column:
    """(measure, value) of a row with COUNTS, as whole thousandths, so that every engine gets the same."""

    def thousandths(a: str, b: str) -> Column:
        return F.expr(f"case when {b} > 0 then (1000L * {a}) div {b} else 0L end")

    made = {
        "symbols": thousandths("n_symbols", "word_chars"), "marks": thousandths("n_marks", "word_chars"), "capitals": thousandths("n_upper", "word_chars"),
        "dup_lines": thousandths("n_dup_lines", "n_lines"), "repeats": thousandths("n_repeat_words", "n_words"),
        "word_length": thousandths("word_chars", "n_words"), "variety": thousandths("n_distinct", "n_words"),
    }
    return F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in made.items()])


def bin_of(value: Column, bits: int = 6) -> Column:
    """The sketch's bin: a whole number with all but its first ``bits`` bits cleared, so within 1/32 of the value."""
    shift = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, bin, n): log-linear histograms. Two of them merge by adding up n, in any order, with one outcome."""
    return measured.groupBy(*by, "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, measure, n, q0, q1, ...) read from sketches: at most a few hundred bins each, whatever the table holds."""
    group = Window.partitionBy(*by, "measure")
    so_far = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = sketch.withColumn("upto", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(group))
    picked = [F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))).alias(f"q{i}") for i, q in enumerate(at)]
    return placed.groupBy(*by, "measure").agg(F.max("all").alias("n"), *picked)


def fences(quartiles: DataFrame, times: float = 3.0) -> DataFrame:
    """Adds ``low`` and ``high``: ``times`` the spread of the middle half outside of it."""
    least = F.element_at(F.create_map(*[F.lit(x) for k, (_, s) in MEASURES.items() for x in (k, s)]), F.col("measure"))
    side = F.element_at(F.create_map(*[F.lit(x) for k, (s, _) in MEASURES.items() for x in (k, s)]), F.col("measure"))
    spread = F.greatest(F.col("q2") - F.col("q0"), least)
    low = F.when(side == "high", F.lit(-1.0)).otherwise(F.col("q0") - times * spread)
    high = F.when(side == "low", F.lit(float(1 << 62))).otherwise(F.col("q2") + times * spread)
    return quartiles.withColumn("low", low.cast("double")).withColumn("high", high.cast("double"))


def thresholds(counted: DataFrame, least_rows: int = 200, times: float = 3.0, trusted: Column | None = None) -> DataFrame:
    """(_l, _s, limits): for each language and source a map from measure to its low and high limit.

    A source's own sketch is used from ``least_rows`` documents on; a smaller one is merged with its language's,
    and where that is small too, with the whole corpus's. Only ``trusted`` rows are learned from.
    """
    learned = counted if trusted is None else counted.filter(trusted)
    long = learned.select("_l", "_s", F.inline(measures())).select("_l", "_s", "measure", bin_of(F.col("value")).alias("bin"))
    own = cut(sketches(long, ["_l", "_s"]))
    by_language = own.groupBy("_l", "measure", "bin").agg(F.sum("n").alias("n"))
    corpus = own.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    wholes = [fences(quantiles(s, by), times) for s, by in ((own, ["_l", "_s"]), (by_language, ["_l"]), (corpus, []))]
    mine, language, every = [w.select(*by, "measure", F.struct("n", "low", "high").alias(name)) for w, by, name in zip(wholes, (["_l", "_s"], ["_l"], []), ("mine", "language", "every"))]
    groups = counted.select("_l", "_s").distinct().withColumn("measure", F.explode(F.array(*[F.lit(k) for k in MEASURES])))
    joined = groups.join(mine, ["_l", "_s", "measure"], "left").join(language, ["_l", "measure"], "left").join(every, "measure", "left")
    enough = [F.when(F.col(f"{k}.n") >= least_rows, F.struct(f"{k}.low", f"{k}.high")) for k in ("mine", "language")]
    limit = F.coalesce(*enough, F.when(F.col("every.n").isNotNull(), F.struct("every.low", "every.high")), F.struct(F.lit(-1.0).alias("low"), F.lit(float(1 << 62)).alias("high")))
    return joined.groupBy("_l", "_s").agg(F.map_from_entries(F.collect_list(F.struct("measure", limit.alias("limit")))).alias("limits"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _verdicts(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds failed and kept: the rows joined with their group's limits."""
    limits = limits.withColumnsRenamed({"_l": "_l2", "_s": "_s2"})
    checked = counted.join(limits, (F.col("_l") == F.col("_l2")) & (F.col("_s") == F.col("_s2")))
    outside = F.filter(measures(), lambda m: (m["value"] < F.element_at("limits", m["measure"])["low"]) | (m["value"] > F.element_at("limits", m["measure"])["high"]))
    return checked.withColumn("failed", F.transform(outside, lambda m: m["measure"])).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def _rows(docs: DataFrame, kept: list[str], text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)], group_key(named(lang)).alias("_l"), group_key(named(source)).alias("_s"), named(text).alias("text"))


def judged(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, **settings) -> DataFrame:
    """``carry`` (default: all columns but the text) with COUNTS, base_failed, failed (measures outside their limits) and kept.

    A text fails the base rules with under 10 words or over a fifth of them in repeated windows; those texts are
    not learned from. Null and empty texts have no words and fail; null languages and sources are groups of their
    own; repeated rows count each; an empty table gives no rows. The table of limits has one row for each
    language and source: the optimizer sends it to every executor while it is small, else it is joined by shuffle.
    """
    kept = [c for c in docs.columns if c != text] if carry is None else carry
    counted = cut(with_counts(_rows(docs, kept, text, lang, source)).withColumn("base_failed", base_failed()))
    result = _verdicts(counted, thresholds(counted, trusted=~F.col("base_failed"), **settings))
    return result.select(*renamed(kept, [*COUNTS, "base_failed", "failed", "kept"]), *COUNTS, "base_failed", "failed", "kept")


def good(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", **settings) -> DataFrame:
    """The documents that are kept, all columns. Texts are read twice, for the limits and for the filter, and never shuffled."""
    counted = cut(with_counts(_rows(docs, [], text, lang, source)).withColumn("base_failed", base_failed()))
    limits = cut(thresholds(counted, trusted=~F.col("base_failed"), **settings))
    rows = with_counts(_rows(docs, docs.columns, text, lang, source), keep_text=True).withColumn("base_failed", base_failed())
    few = limits.count() <= FEW_GROUPS
    return _verdicts(rows, F.broadcast(limits) if few else limits).filter("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
