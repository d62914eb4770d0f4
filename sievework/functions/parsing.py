"""Parsing of model answers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.fields import strip_query_marker
from sievework.functions.text import is_blank, strip


def _between(c: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the last ``closing``; NULL when either is missing."""
    start = F.instr(c, opening)
    end = F.length(c) - F.instr(F.reverse(c), closing) + 1
    both = (start > 0) & (F.instr(c, closing) > 0)
    return F.when(both & (end >= start), F.substring(c, start, end - start + 1))


def _whole_json(c: Column) -> Column:
    """The one JSON value that a text is; NULL for anything behind it, which a lenient parser would not see."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def parse_model_json(df: DataFrame, answer: str, keep: list[str]) -> DataFrame:
    """(keep, valid, json, error) with ``json`` as canonical text.

    A text that is not one JSON value is searched: from its first to its last brace, and where that is not
    one value either, from its first to its last bracket.
    """
    text = strip(F.col(answer))
    block = (
        F.when(
            text.contains("```json"),
            strip(F.split_part(F.split_part(text, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))),
        )
        .when(text.contains("```"), strip(F.split_part(text, F.lit("```"), F.lit(2))))
        .otherwise(text)
    )
    staged = df.select(*keep, F.col(answer).alias("_raw"), block.alias("_text")).withColumns(
        {"_v": _whole_json(F.col("_text")), "_braces": _whole_json(_between(F.col("_text"), "{", "}"))}
    )
    found = F.coalesce("_v", "_braces", _whole_json(_between(F.col("_text"), "[", "]")))
    staged = staged.withColumn("_found", found)
    shape = F.schema_of_variant("_found")
    items = F.try_variant_get("_found", "$", "array<variant>")
    all_objects = F.forall(items, lambda i: F.schema_of_variant(i).startswith("OBJECT"))
    good_first = shape.startswith("OBJECT") | (shape.startswith("ARRAY") & all_objects)
    error = (
        F.when(is_blank(F.col("_raw")), "Empty response")
        .when(F.col("_found").isNull(), "JSON parsing error")
        .when(shape.startswith("ARRAY") & ~all_objects, "List response contains non-object items")
        .when(~good_first, "Unexpected response type")
    )
    staged = staged.withColumn("error", error)
    return staged.select(
        *keep,
        F.col("error").isNull().alias("valid"),
        F.when(F.col("error").isNull(), F.to_json("_found")).alias("json"),
        "error",
    )


def parse_name_list(c: Column) -> Column:
    """A JSON array of names, or comma-separated names; "No ... found" means none."""
    text = strip(c)
    as_json = F.from_json(text, "array<string>")
    as_list = F.split(text, ",")
    none = text.isNull() | text.rlike(r"(?i)^no .*found\.?$")
    names = F.when(none, F.array().cast("array<string>")).otherwise(
        F.when(text.startswith("["), F.coalesce(as_json, as_list)).otherwise(as_list)
    )
    return F.filter(F.transform(names, strip), lambda n: n != "")


def parse_query_expansions(query: Column, answer: Column, n: int) -> Column:
    """The original first, then at most ``n`` new distinct lines."""
    lines = F.transform(F.split(answer, "\n"), strip_query_marker)
    fresh = F.filter(lines, lambda q: (q != "") & (F.lower(q) != F.lower(query)))
    return F.slice(F.concat(F.array(query), F.array_distinct(F.coalesce(fresh, F.array().cast("array<string>")))), 1, n + 1)
