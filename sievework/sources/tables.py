"""Lists, pages, hits, chunks and key-value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sievework import schemas
from sievework.functions.text import is_blank, strip
from sievework.operators.joins import kv_upsert

QUERY_LIST_HEADER = [
    "# Search queries, one per line.",
    "# Blank lines and lines that start with # are skipped.",
    "# Edit, add or remove lines, then save.",
    "#",
]


def is_missing(problem: AnalysisException) -> bool:
    """Whether a read failed because nothing has been written at the path yet."""
    return problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def name_lines(lines: DataFrame) -> DataFrame:
    """Trimmed, non-blank lines of a text table."""
    return lines.select(strip(F.col("value")).alias("name")).filter(F.col("name") != "")


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    return name_lines(spark.read.text(path))


def query_lines(lines: DataFrame) -> DataFrame:
    """As names, without comment lines."""
    return lines.select(strip(F.col("value")).alias("query")).filter((F.col("query") != "") & ~F.col("query").startswith("#"))


def read_query_list(spark: SparkSession, path: str) -> DataFrame:
    return query_lines(spark.read.text(path))


def write_query_list(queries: DataFrame, path: str) -> None:
    """Comment lines first; a query list is small, so it goes into one ordered file."""
    spark = queries.sparkSession
    head = spark.createDataFrame([(-1, i, l) for i, l in enumerate(QUERY_LIST_HEADER)], "a int, pos long, value string")
    body = queries.select(F.lit(0).alias("a"), F.col("pos").cast("long").alias("pos"), F.col("query").alias("value"))
    head.unionByName(body).orderBy("a", "pos").select("value").coalesce(1).write.mode("overwrite").text(path)


def map_lines(spark: SparkSession, path: str, fn, stream: bool = False) -> DataFrame:
    """``fn`` is a function from the line column to a column."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(fn(F.col("value")).alias("value"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """S15."""
    chunks.select("chunk", "chunk_index", "total_chunks", "sources").write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """``array_file`` reads files that hold one JSON array."""
    return spark.read.schema(schemas.CHUNKS).json(path, multiLine=array_file)


def search_hits(df: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """One URL column whichever name the client used; paging by rank (1-based)."""
    have = df.columns
    url = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("url", "link") if c in have])
    hits = df.withColumn("url", url).drop("link").filter(~is_blank(F.col("url")))
    if limit is not None:
        hits = hits.filter((F.col("rank") > start) & (F.col("rank") <= start + limit))
    return hits


KV_BUCKETS = 64


def bucket_of(keys: list[str | Column], buckets: int) -> Column:
    """The folder that a key's rows lie in."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, bucket: str = "bucket") -> list[int]:
    """The folders that rows fall into: as many numbers as there are buckets at most."""
    return sorted(r[0] for r in rows.select(bucket).distinct().collect())


def read_kv(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table that has never been written is empty; buckets of a write on its way come from where it is staged."""
    ddl, _ = schemas.KV_TABLES[table]
    rows = _stored_rows(spark, f"{root}/{table}", ddl)
    if _is_staged(spark, root, table):
        staged = _stored_rows(spark, f"{root}/{table}.next", ddl)
        rows = rows.filter(~F.col("bucket").isin(touched(staged))).unionByName(staged)
    return rows.drop("bucket")


def _stored_rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(f"{ddl}, bucket int").parquet(path)
    except AnalysisException as problem:
        if not is_missing(problem):
            raise
        return spark.createDataFrame([], f"{ddl}, bucket int")


def _file(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _is_staged(spark: SparkSession, root: str, table: str) -> bool:
    files, mark = _file(spark, f"{root}/{table}.next/_SUCCESS")
    return files.exists(mark)


def _put(rows: DataFrame, path: str, mode: str) -> None:
    """One folder a bucket; large buckets are written by several tasks."""
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", mode).mode("overwrite").parquet(path)


def _finish(spark: SparkSession, root: str, table: str) -> None:
    """Replace the buckets of the table by those that are staged, as often as it takes; then drop the staged ones."""
    if _is_staged(spark, root, table):
        ddl, _ = schemas.KV_TABLES[table]
        _put(_stored_rows(spark, f"{root}/{table}.next", ddl), f"{root}/{table}", "dynamic")
        files, folder = _file(spark, f"{root}/{table}.next")
        files.delete(folder, True)


def write_kv(spark: SparkSession, root: str, table: str, rows: DataFrame, buckets: int = KV_BUCKETS) -> None:
    """Only the buckets that ``rows`` fall into are read, merged and replaced; files of the others stay as they are.

    The new buckets are staged as a whole before they replace the old ones: if the driver is lost in between, reads
    take them from there and the next write puts them in place first. Writing the same rows again changes nothing, so
    a micro-batch may be run again. One writer a table; ``buckets`` has to stay as it was at the first write.
    """
    ddl, keys = schemas.KV_TABLES[table]
    _finish(spark, root, table)
    fresh = rows.withColumn("bucket", bucket_of(keys, buckets))
    stored = _stored_rows(spark, f"{root}/{table}", ddl).filter(F.col("bucket").isin(touched(fresh)))
    _put(kv_upsert(stored, fresh, keys, "updated_at"), f"{root}/{table}.next", "static")
    _finish(spark, root, table)


def run_summary(df: DataFrame, cached: str, session_id: str, status: str) -> DataFrame:
    """One session row with counts of processed, cached and new rows."""
    counts = df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col(cached)).alias("from_cache"))
    data = F.to_json(
        F.struct("processed", "from_cache", (F.col("processed") - F.col("from_cache")).alias("new"))
    )
    return counts.select(
        F.lit(session_id).alias("session_id"), F.lit(status).alias("status"), data.alias("data"),
        F.current_timestamp().alias("updated_at"),
    )


def write_with_summary(spark: SparkSession, df: DataFrame, cached: str, path: str, root: str, session_id: str) -> None:
    """S23 in one pass: counts are observed while the result is written."""
    seen = Observation("run")
    watched = df.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if(F.col(cached)).alias("from_cache"))
    watched.write.mode("overwrite").parquet(path)
    got = seen.get
    row = spark.range(1).select(
        F.lit(session_id).alias("session_id"),
        F.lit("completed").alias("status"),
        F.to_json(
            F.struct(
                F.lit(got["processed"]).alias("processed"),
                F.lit(got["from_cache"]).alias("from_cache"),
                F.lit(got["processed"] - got["from_cache"]).alias("new"),
            )
        ).alias("data"),
        F.current_timestamp().alias("updated_at"),
    )
    write_kv(spark, root, "sessions", row)
