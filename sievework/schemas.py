"""Declared schemas of the tables this library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

from sievework import rules

PAGES = "page_id long, url string, html string"
SEARCH_HITS = (
    "query_id long, rank int, title string, url string, link string, snippet string, source string"
)
CHUNKS = (
    "chunk string, chunk_index int, total_chunks int, sources array<struct<url:string,title:string,search_query:string>>"
)
EXPORT = T.StructType([T.StructField(c, T.StringType()) for c in rules.EXPORT_COLUMNS])

# key-value tables: columns and the columns that identify a row
KV_TABLES = {
    "startups": ("name string, data string, source string, query string, updated_at timestamp", ["name"]),
    "urls": ("url string, content string, cleaned_content string, updated_at timestamp", ["url"]),
    "queries": ("query string, expanded_queries string, updated_at timestamp", ["query"]),
    "sessions": ("session_id string, status string, data string, updated_at timestamp", ["session_id"]),
    "metrics": (
        "session_id string, metric_name string, metric_value string, updated_at timestamp",
        ["session_id", "metric_name"],
    ),
}
