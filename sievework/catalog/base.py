"""Registry of queries and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import spread
from sievework.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

def query(key: str, sql: str | None = None):
    """Register ``fn(t)``, where ``t(name)`` is the table of that name.

    ``t(name, True)`` deals a small table out to all cores, for work that is heavy per row.
    """

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str, heavy: bool = False) -> DataFrame:
                df = load(spark, sf_dir, name)
                return spread(df) if heavy else df

            return fn(table)

        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def like_any(expression: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains({expression}, '{n}')" for n in needles) + ")"


WORD = r"\p{L}\p{M}\p{N}\p{Pc}"


def number(c, digits: int = 6):
    return F.round(c, digits)
