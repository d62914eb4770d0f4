"""Secret scans with an incremental blob ledger."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import bytes_of, named, pieces, shared_folder, stored

#: Contents (40 bytes each) of which so many go to every executor; more are joined by a shuffle.
FEW = 1_000_000
SCANS = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, start int, `end` int"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    A rule is known by kind and version: a new version has all contents scanned for it again.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds in their order, then public formats of keys and tokens.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", ASSIGN, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login_url", r"[a-z]+://[A-Za-z0-9._%+-]+:[^\x00-\x20/@:]+@"),
]
RULES = [*BASE, *MORE]


def searcher(rule: Rule):
    """Function from a text to the rule's (start, end), in code points.

    A pattern of one sign class with a least length is asked for that length at once, which gives the same runs, sooner.
    """
    simple = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    found = re.compile(f"{simple[1]}{{{rule.least},}}" if simple else rule.pattern)

    def search(text: str) -> list[tuple[int, int]]:
        return [m.span() for m in found.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]

    return search


#: A text without any of these signs in a row has no match of the rule, which spares the slower search.
HINTS = {"assign": ("=", ":"), "access": ("AKIA",), "github": ("gh",), "slack": ("xox",), "google": ("AIza",), "web_token": ("eyJ",), "private_key": ("-----BEGIN ",), "login_url": ("://",)}


def scanned(contents: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, rules, found) from (blob, text, todo): whole texts are searched for the rules that ``todo`` names, all rules if null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(r.name, searcher(r), HINTS.get(r.kind, ()) if r in RULES else ()) for r in rules]
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in pieces(batches, "text"):
            names, out = [], []
            for text, todo in zip(bytes_of(part.column("text")), part.column("todo").to_pylist()):
                text = text.decode("utf-8", "replace")
                mine = [k for k in known if todo is None or k[0] in todo]
                names.append([k[0] for k in mine])
                out.append([{"rule": n, "start": s, "end": e} for n, search, hints in mine if not hints or any(h in text for h in hints) for s, e in search(text)])
            yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(names, pa.list_(pa.string())), pa.array(out, kind)], names=["blob", "rules", "found"])

    return contents.mapInArrow(run, "blob binary, rules array<string>, found array<struct<rule:string,start:int,`end`:int>>")


class Ledger:
    """What has been searched for what: a folder with ``scans`` (a content, the rules it was searched for) and ``findings``.

    Both only grow. A run writes its findings before its scans, so one that breaks off is done again, and findings that
    are there twice count once.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def scans(self) -> DataFrame:
        return self._read("scans", SCANS)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).distinct()

    def unseen(self, addressed: DataFrame, rules: list[Rule]) -> DataFrame:
        """(blob, source, todo): contents of ``addressed`` (blob, source) not searched for all rules yet, one source of each, the rules to go.

        ``todo`` is null for a content that was never met.
        """
        wanted = F.array(*[F.lit(r.name) for r in rules])
        once = addressed.groupBy("blob").agg(F.min("source").alias("source"))
        if not self._there("scans"):
            return once.select("blob", "source", F.lit(None).cast("array<string>").alias("todo"))
        done = self.scans().select(F.col("blob").alias("k"), F.explode("rules").alias("rule")).groupBy("k").agg(F.collect_set("rule").alias("done"))
        both = once.join(done, F.col("blob") == F.col("k"), "left")
        return both.select("blob", "source", F.when(F.col("done").isNotNull(), F.array_except(wanted, F.col("done"))).alias("todo")).filter("todo is null or size(todo) > 0")

    def add(self, results: DataFrame) -> None:
        """Takes (blob, rules, found) in; findings first."""
        results.select("blob", F.explode("found").alias("f")).select("blob", "f.rule", "f.start", "f.end").write.mode("append").parquet(f"{self.folder}/findings")
        results.select("blob", "rules").write.mode("append").parquet(f"{self.folder}/scans")


def address(text: Column) -> Column:
    """Content address of a text: SHA-256 of its UTF-8; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger: Ledger, rules: list[Rule] | None = None, *, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob) for each row of ``versions``, and the ledger brought up to date with the texts.

    Every version of every path is addressed by its content. Contents that the ledger doesn't know for a rule's version are
    searched, each from one row that has it; texts stay in their scan. ``findings_of`` joins what was found back to
    all paths.

    Null texts are empty; null paths and repeated rows are versions like any other; an empty table adds nothing.
    """
    rules = RULES if rules is None else rules
    narrow = versions.select(named(path).alias("path"), named(text).alias("text"))
    source = F.struct(F.col("path").isNull().alias("none"), F.col("path").alias("path"))
    addressed = stored(narrow.select("path", address(F.col("text")).alias("blob")))
    unseen = stored(ledger.unseen(addressed.select("blob", source.alias("source")), rules))
    # All rows but the ones to leave out are searched where they are; those few go to every task.
    every = addressed.select("blob", source.alias("source"))
    more = every.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("blob").alias("m"))
    firsts = unseen.select(F.col("blob").alias("k"), F.col("source").alias("s"), "todo")
    known = every.select(F.col("blob").alias("k")).distinct().join(firsts.select("k"), "k", "left_anti").select("k", F.lit(None).cast(firsts.schema["s"].dataType).alias("s"), F.lit(None).cast("array<string>").alias("todo"), F.lit(True).alias("skip"))
    some = firsts.join(more, F.col("k") == F.col("m"), "left").filter("m is not null or todo is not null").select("k", "s", "todo", F.lit(False).alias("skip"))
    told = stored(known.union(some))
    texts = narrow.select("path", "text", address(F.col("text")).alias("blob"), source.alias("source"))
    told = F.broadcast(told) if told.count() <= FEW else told
    held = texts.join(told, F.col("blob") == F.col("k"), "left").filter(F.col("k").isNull() | (~F.col("skip") & F.col("source").eqNullSafe(F.col("s"))))
    ledger.add(stored(scanned(held.select("blob", "text", "todo"), rules)))
    return addressed


def findings_of(addressed: DataFrame, ledger: Ledger, rules: list[Rule] | None = None) -> DataFrame:
    """(path, blob, spans) for each row of (path, blob): what the given versions of the rules found in its content.

    ``spans`` has (start, rank, kind, end) by start, then rule; it is null where nothing was found.
    """
    rules = RULES if rules is None else rules
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind")))])
    found = ledger.findings().withColumn("of", F.try_element_at(order, F.col("rule"))).filter("of is not null")
    spans = found.groupBy(F.col("blob").alias("k")).agg(F.array_sort(F.collect_list(F.struct("start", F.col("of.rank").alias("rank"), F.col("of.kind").alias("kind"), "end"))).alias("spans"))
    spans = stored(spans)  # so that both sides of the join are dealt anew, and a content of many paths can be split
    return addressed.join(spans, F.col("blob") == F.col("k"), "left").select("path", "blob", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest_of(spans: Column) -> Column:
    return F.sha2(listed(spans).cast("binary"), 256)
