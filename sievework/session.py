"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "sievework", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIEVEWORK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``, so that a lost executor never replays a loop.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master may fall back to a folder of this machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="sievework-ckpt-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Has shuffle files of finished steps deleted now: Spark drops them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate of a plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, below: int = 1 << 30) -> DataFrame:
    """Deal a small input out to all cores before work that is heavy per row.

    A small table is often one file with one row group, so one task would do everything.
    Inputs from ``below`` bytes on keep the partitions of their scan: no shuffle is added.
    """
    if estimated_bytes(df) >= below:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def parts_for(rows: int, most: int = 50_000) -> int:
    """Partitions that about ``most`` rows fall into each, at least one for each core. The optimizer leaves a number that is named as it
    is; left alone it goes by compressed bytes, and puts millions of rows in one task where they are much alike."""
    return max(SparkSession.active().sparkContext.defaultParallelism, math.ceil(rows / most))


def dealt(df: DataFrame, *keys: str, most: int = 50_000) -> DataFrame:
    """Rows dealt out by the hash of ``keys`` (parts_for); for narrow rows that are made much wider, as a scan puts millions of them in one task."""
    return df.repartition(parts_for(df.count(), most), *keys)
