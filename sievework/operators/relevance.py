"""Relevance and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import rules
from sievework.functions.text import extract_terms, is_blank, split_paragraphs, unnest
from sievework.operators.keys import limit_per_key


def content_relevance(fields: list[Column], query: Column) -> Column:
    """Share of the query's terms that occur in any field."""
    wanted = F.array_distinct(extract_terms(query))
    present = extract_terms(F.concat_ws(" ", *fields))
    share = F.size(F.array_intersect(wanted, present)) / F.size(wanted)
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.least(F.lit(1.0), share))


def information_quality(columns: dict[str, str]) -> Column:
    """Share of the important fields that are filled; ``columns`` maps field to column."""
    filled = F.lit(0)
    for field in rules.IMPORTANT_FIELDS:
        if field in columns:
            blank = F.col(columns[field]).isNull() | F.col(columns[field]).isin("", rules.UNKNOWN)
            filled = filled + F.when(blank, 0).otherwise(1)
    return filled / float(len(rules.IMPORTANT_FIELDS))


def score(relevance: Column, quality: Column) -> Column:
    """R03."""
    return rules.RELEVANCE_WEIGHT * relevance + rules.QUALITY_WEIGHT * quality


def rank(df: DataFrame, query: str, columns: dict[str, str], order: str, min_confidence: float = 0.0) -> DataFrame:
    """Best first, ties in input order."""
    fields = [F.col(c) for c in columns.values()]
    confidence = score(content_relevance(fields, F.lit(query)), information_quality(columns))
    scored = df.withColumn("confidence", confidence)
    return scored.filter(F.col("confidence") >= min_confidence).orderBy(F.desc("confidence"), F.asc(order))


def _query_words(query: str) -> list[str]:
    return [w for w in query.lower().split() if len(w) > 3]


def word_hits(text: Column, query: str) -> Column:
    """How many of the query's longer words are substrings of the text."""
    low = F.lower(text)
    total = F.lit(0)
    for word in _query_words(query):
        total = total + low.contains(word).cast("int")
    return total


def is_relevant(text: Column, query: str, threshold: float = 0.1) -> Column:
    """R05."""
    words = _query_words(query)
    if not words:
        return F.lit(False)
    return ~is_blank(text) & (word_hits(text, query) / float(len(words)) >= threshold)


def top_paragraphs(
    df: DataFrame, doc: str, text: str, query: str, k: int = 10, delimiter: str = r"(?U)\n\s*\n"
) -> DataFrame:
    """The k best paragraphs of each document by hits per 100 characters."""
    rows = unnest(df, [doc], split_paragraphs(F.col(text), delimiter), "paragraph", "pos")
    rows = rows.withColumn("score", word_hits(F.col("paragraph"), query) / (F.length("paragraph") / 100.0))
    return limit_per_key(rows, [doc], [F.desc("score"), F.asc("pos")], k)
