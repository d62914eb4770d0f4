"""Token counts of whole texts: Arrow batches balanced by bytes, texts cut at safe boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.llm.common import named, pieces, renamed

#: White space after another sign. Byte-level BPE splits a text before it is merged, and no part of that split holds white
#: space after another sign; so a part may end there and another one start with it, whatever stands around: counts
#: of both sides add up. The special string has no white space, so it is never cut.
SAFE = re.compile(r"(?<=\S)(?=\s)")
#: Within a long run without white space: where letters, digits and other signs meet, as none of them share a part (but for an
#: apostrophe and the letters behind it, and the special string, which starts and ends with its own signs).
FINER = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
#: Signs from which on a part is cut finer.
LONG = 256
#: Signs of the parts that a task remembers with their length, 100 more for each; then it starts over.
REMEMBERED = 64 << 20
#: Characters that one call of the library gets.
CALL = 1 << 20


class Counter:
    """Lengths of texts in tokens. Parts that repeat are encoded once for as long as they are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.held = 0
        self.special = list(filter(None, (t.content for t in self.tokenizer.get_added_tokens_decoder().values())))

    def _learn(self, parts: list[str]) -> None:
        """Encodes new parts, in calls of about equal size."""
        start, size = 0, 0
        for end, part in enumerate(parts, 1):
            size += len(part)
            if size >= CALL or end == len(parts):
                call = parts[start:end]
                self.known.update(zip(call, map(len, self.tokenizer.encode_batch_fast(call, add_special_tokens=False))))
                self.held += size + 100 * len(call)
                start, size = end, 0

    def parts(self, text: str) -> list[str]:
        """The text in parts whose counts add up. A run that holds a special string is left whole."""
        cut = SAFE.split(text)
        if len(text) > LONG and max(map(len, cut)) > LONG:
            cut = [p for x in cut for p in ([x] if len(x) <= LONG or any(s in x for s in self.special) else FINER.split(x))]
        return cut

    def lengths(self, texts: list[str]) -> list[int]:
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        cut = [self.parts(t) for t in texts]
        self._learn(list({p for parts in cut for p in parts if p not in self.known}))
        return [sum(map(self.known.__getitem__, parts)) for parts in cut]


def token_counts(docs: DataFrame, path: str, *, text: str = "text", carry: list[str] | None = None, limit: int = 1024, batch_bytes: int = 4 << 20) -> DataFrame:
    """``carry`` (default: all columns but the text) with n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    ``path`` names the tokenizer's file on every machine; texts are encoded without special tokens added,
    truncation or padding, and only lengths leave the function. A long text is cut before white space, and a long run without
    any also where letters, digits and other signs meet; only a run of one kind stays whole, as the library may merge
    all of it. Null and empty texts have 0 bytes and
    0 tokens, repeated rows are counted each, an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != text] if carry is None else carry
    rows = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(named(text), F.lit("")).alias("text"))
    names = [f"c{i}" for i in range(len(kept))] + ["n_bytes", "n_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for part in pieces(batches, "text", batch_bytes):
            counter = counter or Counter(path)
            texts = part.column("text")
            made = [pa.compute.binary_length(texts).cast(pa.int64()), pa.array(counter.lengths(texts.to_pylist()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=names)

    schema = StructType([*rows.schema.fields[: len(kept)], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    counted = rows.mapInArrow(count, schema)
    return counted.select(*renamed(kept, ["n_bytes", "n_tokens", "over_limit"]), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
