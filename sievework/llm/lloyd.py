"""Centroid clustering: Lloyd's rounds over column blocks of the vectors, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import named, released, stored

#: A component's size after scaling: with it, squared distances of up to 1,024 components are exact 64-bit numbers.
MOST = 1 << 26
#: Blocks in a task, 128 kB each with the default width and chunk.
PER_TASK = 256


def whole_vectors(vectors: DataFrame, dims: int, *, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): the vectors with exactly ``dims`` components, none of them null or not finite."""
    narrow = vectors.select(named(vec_id).alias("vec_id"), named(embedding).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return narrow.filter((F.size("x") == dims) & F.coalesce(finite, F.lit(False)))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    made = np.floor(x * float(scale))
    if made.size and np.abs(made).max() > MOST:
        raise ValueError(f"a component is over {MOST // scale} in size: its distances are no 64-bit numbers")
    return made.astype(np.int64)


def column_blocks(vectors: DataFrame, dims: int, width: int, chunk: int, scale: int) -> DataFrame:
    """(chunk, block, n, ids, m): ``m`` has ``width`` columns of ``n`` vectors, row by row; the first block has their ids too.

    A chunk is made of vectors that stand together in a partition of the input, ``chunk`` at most, whatever
    their ids or values are: equal ids or vectors don't meet in one task.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                n = part.num_rows
                x = scaled(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, dims), scale)
                starts = range(0, dims, width)
                columns = [
                    pa.array([number] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array([n] * len(starts), pa.int32()),
                    pa.array([part.column("vec_id").to_pylist() if s == 0 else None for s in starts], pa.list_(pa.int64())),
                    pa.array([x[:, s : s + width].ravel() for s in starts], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "block", "n", "ids", "m"])
                number += 1

    return vectors.mapInArrow(cut_up, "chunk long, block int, n int, ids array<long>, m array<long>")


def _matrix(part: pa.RecordBatch, i: int) -> np.ndarray:
    return part.column("m")[i].values.to_numpy(zero_copy_only=False).reshape(part.column("n")[i].as_py(), -1)


def partial_distances(blocks: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """(chunk, block, part): of each block the squared distances to the block's slice of all centroids, vector by vector.

    A batch holds a few blocks, and a block n x k numbers: bounded by the chunk's size and the number of centroids.
    """
    slices = [centres[:, s : s + width] for s in range(0, centres.shape[1], width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m, c = _matrix(batch, i), slices[batch.column("block")[i].as_py()]
                part = (m * m).sum(axis=1)[:, None] - 2 * (m @ c.T) + (c * c).sum(axis=1)
                columns = [batch.column("chunk").slice(i, 1), batch.column("block").slice(i, 1), pa.array([part.ravel()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "block", "part"])

    return blocks.select("chunk", "block", "n", "m").mapInArrow(run, "chunk long, block int, part array<long>")


def nearest(partial: DataFrame, k: int) -> DataFrame:
    """(chunk, labels, distances): the blocks of each chunk added up, and of equal distances the smaller number.

    A group has one row for each block, so its size is that of a chunk, whatever the data are.
    """

    def add(table: pa.Table) -> pa.Table:
        whole = None
        for part in table.column("part").combine_chunks():
            own = part.values.to_numpy(zero_copy_only=False).reshape(-1, k)
            whole = own if whole is None else whole + own
        labels = whole.argmin(axis=1)
        columns = [table.column("chunk").slice(0, 1), pa.array([labels.astype(np.int32)], pa.list_(pa.int32())), pa.array([whole[np.arange(len(whole)), labels]], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, names=["chunk", "labels", "distances"])

    return partial.groupBy("chunk").applyInArrow(add, "chunk long, labels array<int>, distances array<long>")


def slice_sums(blocks: DataFrame, told: DataFrame, k: int, width: int, count: int) -> DataFrame:
    """(dim, cluster, total, n): each shard's own column sums by cluster, added up; only labels travel to the blocks."""
    to_blocks = told.select(F.col("chunk").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("b"), "labels")
    held = blocks.join(to_blocks, (F.col("chunk") == F.col("c")) & (F.col("block") == F.col("b"))).select("block", "n", "m", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m, labels = _matrix(batch, i), batch.column("labels")[i].values.to_numpy(zero_copy_only=False)
                total, n = np.zeros((k, m.shape[1]), np.int64), np.bincount(labels, minlength=k)
                np.add.at(total, labels, m)
                cluster, place = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
                first = batch.column("block")[i].as_py() * width
                columns = [pa.array((place + first).astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(total[cluster, place]), pa.array(n[cluster].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "cluster", "total", "n"])

    return held.mapInArrow(run, "dim int, cluster int, total long, n long").groupBy("dim", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def first_centres(vectors: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, of equal ones the smaller vector; fewer if there are fewer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return scaled(np.array([r.x for r in rows], np.float64), scale)


def cluster(vectors: DataFrame, *, k: int = 8, dims: int = 64, rounds: int = 10, seed: int = 3, scale: int = 1024, width: int = 16, chunk: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    The columns are sharded: a task holds ``width`` of them for a chunk of vectors and works out exact partial distances to its
    slice of the centroids. The parts of a chunk are added up by key, the least total is the cluster, and only labels go back
    to the blocks, which stay where they are (hash-partitioned by block and chunk, and kept). Each shard sums its
    own slice, and each component of a centroid becomes the floor of sum / count. All numbers are whole, so a run
    gives the same result in any order. The driver holds k x dims numbers, by the parameters.

    Vectors with another number of components, or with a component that is null or not finite, aren't kept. Null ids
    are kept; repeated ids and rows count as often as they are there. Fewer vectors than ``k`` make fewer centroids; none give no
    rows. Components over 65,536 in size raise an error, as their distances are no 64-bit numbers. Other columns aren't read.
    """
    kept = whole_vectors(vectors, dims, vec_id=vec_id, embedding=embedding).withColumn("vec_id", F.col("vec_id").cast("long"))
    spark = vectors.sparkSession
    centres = first_centres(kept, k, seed, scale)
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k, count = len(centres), -(-dims // width)
    table = stored(column_blocks(kept, dims, width, chunk, scale))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // PER_TASK))
    shards = table.repartition(parts, "block", "chunk").persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        told = nearest(partial_distances(shards, centres, width), k)
        before = centres.copy()
        for row in slice_sums(shards, told, k, width, count).collect():
            centres[row.cluster, row.dim] = row.total // row.n
        if np.array_equal(before, centres):
            break  # every later round would give the same
    told = nearest(partial_distances(shards, centres, width), k)
    ids = table.filter("block = 0").select(F.col("chunk").alias("c"), "ids")
    rows = told.join(ids, F.col("chunk") == F.col("c")).select(F.explode(F.arrays_zip("ids", "labels", "distances")).alias("r"))
    found = stored(rows.select(F.col("r.ids").alias("vec_id"), F.col("r.labels").alias("cluster"), F.col("r.distances").alias("distance")))
    shards.unpersist()
    released(table)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    about = spark.createDataFrame([(i, sums[i], sum(sums.values()), digests[i]) for i in sums], "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), F.col("cluster") == F.col("_c")).drop("_c")
