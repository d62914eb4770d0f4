"""Name grouping and company dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.fields import basic_clean_name, name_key
from sievework.operators.keys import first_per_key
from sievework.operators.leaders import groups_in_waves
from sievework.operators.similarity import fuzzy_between, fuzzy_index
from sievework.session import cut


def group_names(df: DataFrame, id: str, name: str, threshold: float = 0.8, waves: int | None = None) -> DataFrame:
    """(id, name, leader, kind); ``kind`` is exact, fuzzy or single.

    Names equal in letters and digits form exact groups; only the others are compared.
    Names without any ASCII letter or digit share the empty key and so one group.
    """
    cleaned = df.select(F.col(id).alias("id"), basic_clean_name(F.col(name)).alias("name")).filter(F.col("name") != "")
    keyed = cleaned.withColumn("key", name_key(F.col("name")))
    groups = cut(
        keyed.groupBy("key").agg(
            F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"), F.min_by("name", "id").alias("first_name")
        )
    )
    single = groups.filter("n = 1").select(F.col("leader").alias("id"), F.col("first_name").alias("name"))
    index = cut(fuzzy_index(single, "id", "name"))
    fuzzy = cut(groups_in_waves(index, lambda a, b: fuzzy_between(a, b, threshold), waves))
    sizes = fuzzy.groupBy("leader").agg(F.count(F.lit(1)).alias("members"))
    fuzzy = fuzzy.join(sizes, "leader").select(F.col("id").alias("fid"), F.col("leader").alias("fl"), "members")
    rows = keyed.join(groups.select("key", "leader", "n"), "key").join(fuzzy, F.col("id") == F.col("fid"), "left")
    return rows.select(
        "id",
        "name",
        F.coalesce("fl", "leader").alias("leader"),
        F.when(F.col("n") > 1, "exact").when(F.col("members") > 1, "fuzzy").otherwise("single").alias("kind"),
    )


def pick_representative(groups: DataFrame) -> DataFrame:
    """(leader, name, members) with the first name of each group."""
    return groups.groupBy("leader").agg(F.min_by("name", "id").alias("name"), F.count(F.lit(1)).alias("members"))


def dedupe_companies(df: DataFrame, id: str, name: str, threshold: float = 0.8) -> DataFrame:
    """The first row of each group under the chosen name."""
    chosen = pick_representative(group_names(df, id, name, threshold))
    chosen = chosen.select(F.col("leader").alias("_leader"), F.col("name").alias("_name"))
    return df.join(chosen, F.col(id) == F.col("_leader")).withColumn(name, F.col("_name")).drop("_leader", "_name")


def dedupe_basic(df: DataFrame, id: str, name: str) -> DataFrame:
    """The first original row of each cleaned name."""
    return first_per_key(df, [basic_clean_name(F.col(name))], id)
