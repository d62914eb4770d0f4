"""Company files: reading, checking, checkpoints and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from sievework import rules
from sievework.functions.text import is_blank, strip
from sievework.operators.joins import append_new, merge_append, union_by_key_set
from sievework.operators.keys import last_per_key
from sievework.operators.names import dedupe_basic
from sievework.sources.tables import is_missing


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; the header is the only thing read ahead."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def name_column(columns: list[str]) -> str:
    for candidate in ("Name", "Company Name"):
        if candidate in columns:
            return candidate
    raise ValueError("no column 'Name' or 'Company Name'")


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """S01."""
    df = _csv(spark, path)
    column = name_column(df.columns)
    return df.withColumn("Company Name", strip(F.col(f"`{column}`"))).filter(~is_blank(F.col("Company Name")))


def validate_company_csv(spark: SparkSession, path: str) -> list[str]:
    """The problems found, none when the file can be used."""
    if not path:
        return ["no path given"]
    try:
        df = _csv(spark, path)
    except AnalysisException:
        return [f"file not found: {path}"]
    if not df.columns:
        return ["no header"]
    try:
        name_column(df.columns)
    except ValueError as problem:
        return [str(problem)]
    return ["no rows"] if df.isEmpty() else []


def write_checkpoint(df: DataFrame, base: str, phase: str, batch: int | None = None, stamp: str | None = None) -> str:
    """One dataset per phase, batch and time; name first, other columns sorted."""
    if stamp is None:
        stamp = df.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    part = f"_batch{batch}" if batch is not None else ""
    path = f"{base}_{phase}{part}_{stamp}"
    union_by_key_set([df], "Company Name" if "Company Name" in df.columns else None).write.mode("overwrite").parquet(path)
    return path


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """All text; an empty table when there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as problem:
        if not is_missing(problem):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("Company Name", T.StringType())]))
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def latest_checkpoint(paths: DataFrame, phase: str, path: str = "path", modified: str | None = None) -> DataFrame:
    """Newest path of a phase by the last time stamp in its name (or by ``modified``)."""
    of_phase = paths.filter(F.col(path).contains(f"_{phase}_") | F.col(path).contains(f"_{phase}."))
    stamps = F.regexp_extract_all(F.col(path), F.lit(r"(\d{8}_\d{6})"), F.lit(1))
    stamp = F.coalesce(F.try_element_at(stamps, F.lit(-1)), F.lit(""))
    order = F.struct(F.col(modified), F.col(path)) if modified else F.struct(stamp, F.col(path))
    return of_phase.agg(F.max_by(path, order).alias(path))


def checkpoint_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified) of the datasets that match a glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    folder = F.regexp_extract("path", r"^(.*_\d{8}_\d{6})(?:/|\.|$)", 1)
    return files.groupBy(F.coalesce(F.nullif(folder, F.lit("")), "path").alias("path")).agg(
        F.max("modificationTime").alias("modified")
    )


def resume_phase(df: DataFrame, enriched: list[str] | None = None) -> DataFrame:
    """One row with the phase to go on with."""
    columns = [c for c in (enriched or ["Product Description", "Founded Year"]) if c in df.columns]
    filled = F.lit(False)
    for c in columns:
        filled = filled | ~is_blank(F.col(f"`{c}`"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(filled.cast("int")).alias("f")).select(
        F.when(F.col("n") == 0, "discovery").when(F.col("f") == 1, "validation").otherwise("enrichment").alias("phase")
    )


def export_rows(df: DataFrame) -> DataFrame:
    """The 23 export columns, missing ones blank; Source URL comes from Original URL."""

    def cell(title: str) -> Column:
        source = "Original URL" if title == "Source URL" else title
        if source not in df.columns:
            return F.lit("").alias(title)
        return F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias(title)

    return df.select(*[cell(c) for c in rules.EXPORT_COLUMNS])


def export_companies_csv(df: DataFrame, path: str) -> None:
    export_rows(df).write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def csv_text(df: DataFrame) -> DataFrame:
    """Every column of a row as one CSV line."""
    return df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))


def json_rows(df: DataFrame, order: str, name: str = "Company Name") -> DataFrame:
    """(company, json) with basic, detailed and meta blocks; the last row of a name counts."""
    basic, meta = ["Founded Year", "Location", "Website"], ["confidence", "last_updated", "Source"]
    last = last_per_key(df, [name], order)
    rest = [c for c in df.columns if c not in [name, order, *basic, *meta]]

    def block(columns: list[str], key) -> Column:
        present = [c for c in columns if c in df.columns]
        if not present:
            return F.create_map().cast("map<string,string>")
        pairs = F.map_from_arrays(
            F.array(*[F.lit(key(c)) for c in present]), F.array(*[F.col(f"`{c}`").cast("string") for c in present])
        )
        return F.map_filter(pairs, lambda _, v: v.isNotNull())

    lower = lambda c: c.lower().replace(" ", "_")
    m = block(meta, str.lower)
    body = F.struct(
        block(basic, lower).alias("basic_info"),
        block(rest, lower).alias("detailed_info"),
        F.when(F.size(m) > 0, m).alias("meta"),
    )
    return last.select(F.coalesce(F.col(f"`{name}`"), F.lit(rules.UNKNOWN)).alias("company"), F.to_json(body).alias("json"))


def export_companies_json(df: DataFrame, order: str, path: str, name: str = "Company Name") -> None:
    """One JSON object per line, keyed by company."""
    rows = json_rows(df, order, name)
    keyed = F.to_json(F.map_from_arrays(F.array("company"), F.array(F.parse_json("json"))))
    rows.select(keyed.alias("value")).write.mode("overwrite").text(path)


def append_to_target(spark: SparkSession, results: DataFrame, target: str, order: str, batch_info: str) -> int:
    """Append to a Parquet target and tell how many rows were new."""
    from pyspark.sql import Observation

    try:
        known = spark.read.parquet(target).select("Company Name")
    except AnalysisException as problem:
        if not is_missing(problem):
            raise
        known = spark.createDataFrame([], "`Company Name` string")
    seen = Observation("appended")
    fresh = append_new(results, known, "Company Name", order, batch_info)
    fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(target)
    return seen.get["rows"]


def merge_append_file(source: DataFrame, target: DataFrame, order: str, source_file: str, out: str) -> None:
    """Writes a new target; what is being read is never overwritten."""
    merge_append(source, target, "Company Name", order, source_file).write.mode("overwrite").parquet(out)


def dedupe_to_version(spark: SparkSession, path: str, out: str, order: str) -> None:
    """The deduplicated version goes next to the original, which stays as the backup."""
    if path.rstrip("/") == out.rstrip("/"):
        raise ValueError("write the new version to another folder")
    dedupe_basic(spark.read.parquet(path), order, "Company Name").write.mode("errorifexists").parquet(out)
