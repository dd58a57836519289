"""Centroid clustering of vectors by Lloyd's rounds, sharded by dimension.

Vectors are cut into blocks of columns; a shard row holds one block of a chunk
of vectors, and the shards are dealt out by (block, chunk) once and stay where
they are. In each round a task of a block computes exact partial distances to
its slice of the centroids; the partial distances of a chunk are added over its
blocks and the nearest centroid taken; the assignment goes back to the shards,
and each block sums its own columns and updates its own slice. All numbers
are whole, so the result depends neither on the order of rows nor on the
partitions. The driver holds the centroids (clusters times columns) and nothing
that grows with the vectors.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrends.llm.shared_store import bound_batches, written
from geotrends.session import materialize

# Components up to this bound keep squared distances over 64 columns within 64 bits.
_LARGEST = 2**27


@dataclass(frozen=True)
class Settings:
    clusters: int = 8
    rounds: int = 10
    columns: int = 64  # of a vector
    block: int = 16  # columns of a shard
    scale: int = 1024
    seed: str = "3"
    chunk: int = 4096  # vectors of a chunk


def _usable(vec: Column, s: Settings) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vec) == s.columns) & finite, F.lit(False))


def _whole(x: np.ndarray, s: Settings) -> np.ndarray:
    """``floor(scale * x)`` as 32-bit numbers."""
    out = np.floor(x * float(s.scale))
    if out.size and np.abs(out).max() > _LARGEST:
        raise ValueError(f"a component times {s.scale} is beyond {_LARGEST}: distances would not fit into 64 bits")
    return out.astype(np.int32)


def _slices(s: Settings) -> list[slice]:
    return [slice(at, min(at + s.block, s.columns)) for at in range(0, s.columns, s.block)]


def shards(vectors: DataFrame, s: Settings) -> DataFrame:
    """(chunk, block, size, data, ids) of rows (id, vec): a row per chunk and block, the ids with block 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, ids, kept = TaskContext.get().partitionId() << 32, 0, [], []

        def chunk(n: int) -> pa.RecordBatch:
            nonlocal ids, kept, made
            x = np.concatenate(kept) if len(kept) > 1 else kept[0]
            own, ids, kept = ids[:n], ids[n:], [x[n:]]
            x, blocks, made = x[:n], _slices(s), made + 1
            count = len(blocks)
            columns = [
                pa.array([first + made - 1] * count, pa.int64()), pa.array(range(count), pa.int32()), pa.array([n] * count, pa.int32()),
                pa.array([np.ascontiguousarray(x[:, b]).astype("<i4").tobytes() for b in blocks], pa.binary()),
                pa.array([own] + [None] * (count - 1), pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "block", "size", "data", "ids"])

        for batch in batches:
            ids += batch["id"].to_pylist()
            kept.append(_whole(batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, s.columns), s))
            while len(ids) >= s.chunk:
                yield chunk(s.chunk)
        if ids:
            yield chunk(len(ids))

    return vectors.mapInArrow(cut, "chunk bigint, block int, size int, data binary, ids array<bigint>")


def dealt_out(cut: DataFrame) -> DataFrame:
    """The shards stored by (block, chunk), so that joins on both find them in place.

    A stored frame keeps its partitioning only where its plan is fixed beforehand, so
    adaptive execution is off for this one step.
    """
    spark = cut.sparkSession
    parts, adaptive = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return materialize(cut.select("chunk", "block", "size", "data").repartition(parts, "block", "chunk"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def first_centroids(vectors: DataFrame, s: Settings) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, at most ``clusters``; null ids come last, ties go by the components."""
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("id").cast("string")), 256)
    chosen = vectors.select(digest.alias("digest"), "vec").orderBy(F.asc_nulls_last("digest"), "vec").limit(s.clusters).collect()
    return _whole(np.array([r["vec"] for r in chosen], np.float64).reshape(-1, s.columns), s).astype(np.int64)


def _matrix(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(size, -1).astype(np.int64)


def assigned(parts: DataFrame, centroids: np.ndarray, s: Settings, distances: bool = False) -> DataFrame:
    """(chunk, own, distance): number of the nearest centroid of each vector (ties: the smaller), and its distance."""
    blocks = _slices(s)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, size, data in zip(batch["block"].to_pylist(), batch["size"].to_pylist(), batch["data"].to_pylist()):
                x, c = _matrix(data, size), centroids[:, blocks[block]]
                out.append(((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["size"], pa.array(out, pa.binary())], ["chunk", "size", "part"])

    def nearest(rows: pa.Table) -> pa.Table:
        size = rows["size"][0].as_py()
        total = np.zeros((size, len(centroids)), np.int64)
        for part in rows["part"]:
            total += np.frombuffer(part.as_py(), "<i8").reshape(total.shape)
        own = total.argmin(1)
        least = total[np.arange(size), own].astype("<i8").tobytes() if distances else None
        columns = [rows["chunk"][:1], pa.array([own.astype("<i4").tobytes()], pa.binary()), pa.array([least], pa.binary())]
        return pa.Table.from_arrays(columns, ["chunk", "own", "distance"])

    sums = parts.select("chunk", "block", "size", "data").mapInArrow(partial, "chunk bigint, size int, part binary")
    return sums.groupBy("chunk").applyInArrow(nearest, "chunk bigint, own binary, distance binary")


def updated(parts: DataFrame, nearest: DataFrame, centroids: np.ndarray, s: Settings) -> np.ndarray:
    """The centroids after a round: each block's exact floored means; a centroid without vectors stays."""
    blocks, k = _slices(s), len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times, seen = np.zeros((k, s.columns), np.int64), np.zeros((k, s.columns), np.int64), False
        for batch in batches:
            for block, size, data, own in zip(*(batch[c].to_pylist() for c in ("block", "size", "data", "own"))):
                members = (np.frombuffer(own, "<i4")[None, :] == np.arange(k)[:, None]).astype(np.int64)
                total[:, blocks[block]] += members @ _matrix(data, size)
                times[:, blocks[block]] += members.sum(1)[:, None]
                seen = True
        if seen:
            cluster, column = np.nonzero(times)
            columns = (cluster, column, total[cluster, column], times[cluster, column])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "column", "total", "times"])

    every = F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1)))
    told = nearest.select("chunk", "own", every.alias("block"))
    own_sums = (
        parts.select("chunk", "block", "size", "data")
        .join(told, ["block", "chunk"])
        .select("block", "size", "data", "own")
        .mapInArrow(sums, "cluster bigint, column bigint, total bigint, times bigint")
        .groupBy("cluster", "column")
        .agg(F.sum("total").alias("total"), F.sum("times").alias("times"))
    )
    mean = F.call_function("div", F.col("total") - F.pmod("total", F.col("times")), F.col("times"))
    out = centroids.copy()
    for row in own_sums.select("cluster", "column", mean.alias("mean")).collect():  # clusters times columns
        out[row["cluster"], row["column"]] = row["mean"]
    return out


def _by_cluster(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)


def clusters(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per kept vector.

    Kept are vectors of exactly ``columns`` components, none null or not finite;
    the others give no row. A component ``x`` counts as ``floor(scale * x)``; one
    beyond 2^27 after that stops the job, as its distances may not fit into 64 bits.
    Rows that repeat an id, also a null one, are vectors of their own. With
    fewer vectors than clusters there are that many clusters, and no rows if there
    are none. Other columns are left out.
    """
    s, spark = settings, rows.sparkSession
    bound_batches(spark)
    out = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    vec = F.col(f"`{vec_col}`").cast("array<double>").alias("vec")
    vectors = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec).where(_usable(F.col("vec"), s))
    centroids = first_centroids(vectors, s)
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` bigint, {out}")
    cut = written(shards(vectors, s), "vector-shards")
    parts = dealt_out(cut)
    for _ in range(s.rounds):
        centroids = updated(parts, assigned(parts, centroids, s), centroids, s)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, distance in zip(*(batch[c] for c in ("ids", "own", "distance"))):
                numbers = [np.frombuffer(own.as_py(), "<i4"), np.frombuffer(distance.as_py(), "<i8")]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(numbers[0]), pa.array(numbers[1])], ["id", "cluster", "distance"])

    named = cut.where("block = 0").select("chunk", "ids").join(assigned(parts, centroids, s, distances=True), "chunk")
    found = written(named.mapInArrow(unpacked, "id bigint, cluster int, distance bigint"), "clusters")
    inertia = [0] * len(centroids)
    for row in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect():  # a row per cluster
        inertia[row["cluster"]] = row["inertia"]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select(
        F.col("id").alias(id_col), "cluster", "distance", _by_cluster(inertia).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"), _by_cluster(digests).alias("centroid_sha256"),
    )
