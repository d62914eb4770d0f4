"""Registered queries, each with the SQL that must give the same rows where SQL can say it."""

from sievework.catalog import (  # noqa: F401
    aggregates,
    chunking,
    dedupe,
    extraction,
    fields,
    joining,
    modelled,
    sources,
    streams,
    texts,
    web,
    windowing,
)
from sievework.catalog.base import ORACLE, QUERIES  # noqa: F401
