"""What several operators of this folder share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import cut, freed
from sievework.sources.tables import load

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs: the one that the cluster names, a folder of this machine on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="sievework-")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage of large tables, in few bytes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` returned, once nothing reads them any more."""
    for table in tables:
        _remove(table.sparkSession, table.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``stored`` at the end of the driver, if its session is still there."""
    if spark.sparkContext._jsc is not None:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def named(column: str) -> Column:
    """A column by its very name, whatever signs the name has."""
    return F.col(f"`{column.replace('`', '``')}`")


def group_key(column: Column) -> Column:
    """A text that is never null: equal for equal values, last for null by code point."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), column.cast("string")))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet, so that no column of the user clashes."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def renamed(kept: list[str], made: list[str]) -> list[Column]:
    """The columns c0, c1, ... under their own names; one that a result column has gets underscores behind its name."""
    taken, out = {m.lower() for m in made}, []
    for i, name in enumerate(kept):
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(F.col(f"c{i}").alias(name))
    return out


def is_remainder(doc_id: Column, modulus: int, value: int) -> Column:
    """crc32 of the id as text, by its remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == value


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).cast("int64")).to_numpy(zero_copy_only=False)
        start, given = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(ends.searchsorted(given + most, side="right")))
            yield batch.slice(start, end - start)
            start, given = end, int(ends[end - 1])


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def table_of(spark: SparkSession, frame: pd.DataFrame, schema: str) -> DataFrame:
    """A small table of the driver, also where it has no rows."""
    return spark.createDataFrame(list(frame.itertuples(index=False, name=None)), schema)


def buckets_for(df: DataFrame, rows: int, per_bucket: int = 100_000) -> int:
    """Enough buckets for ``rows`` rows, and some for each shuffle partition, so that all are busy."""
    return max(1, -(-rows // per_bucket), 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


__all__ = ["WORD", "buckets_for", "bytes_of", "cut", "documents", "free_name", "freed", "group_key", "is_remainder", "load", "named", "pieces", "released", "renamed", "shared_folder", "stored", "table_of", "word_count", "words_of"]
