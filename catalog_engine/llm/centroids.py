"""Centroid clustering with geometric drift tightening (operator 13).

Exact k-means on vectors of whole numbers. Each vector keeps an upper bound of the distance to its
centroid and a lower bound of the distance to all others. After a round a cluster's vectors lie in a
sphere around its centroid, of the largest upper bound. How much nearer another centroid can have
come to any point of that sphere follows from the plane through the sphere's centre and the old and
the new place: a point seen from the old place lies within asin(radius / distance) of the centre's
direction, and only the part of the move in the point's direction counts. So lower bounds are
loosened by less than the full drift, and grow where a centroid moves away. Vectors whose bounds do
not tell the nearest centroid are scanned exactly, in whole numbers; ties go to the smaller number.

Vectors are packed into blocks, which lie in a table bucketed by block. Bounds are a small table of
their own, one a round, bucketed alike: a round reads both where they lie and shuffles neither. Only
sums by cluster come to the driver. Every table is in the shared folder, so a lost executor costs
the tasks it had.

Vectors that are null, of another length, or hold null or non-finite components are left out; other
columns are not looked at. Repeated rows count as often as they stand there. Rows without an id are
clustered, but no start centroid. Of equal ids the smaller vector comes first among the starts.
Fewer vectors than ``k`` make as many clusters; without a vector the result has no rows. Components
of 2^17 or more are an error, as distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.llm.common import show_library
from catalog_engine.llm.vectors import whole_rows
from catalog_engine.session import work_dir

K = 8
ROUNDS = 10
SIZE = 64
SCALE = 1024
#: Whole components lie below this, so that squared distances of SIZE of them fit 63 bits.
MOST = 1 << 27
#: Below this the products of a block are exact in double precision.
EXACT = 1 << 22
#: Vectors of a block, and of the part of a table that one task reads.
BLOCK = 1_024
BUCKET = 1 << 17
#: Room for the rounding of bounds, against distances of whole numbers.
SLACK = 1e-6

#: Bounds of a block: bytes of the clusters, of double and of 64-bit numbers, and sums by cluster.
STATE = (
    "block long, n int, scanned int, cluster binary, upper binary, lower binary, distance binary, "
    "sums array<struct<cluster:int,n:long,total:array<long>,radius:double,inertia:long>>"
)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole points to whole centroids."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if most < EXACT:
        # Every partial sum is a whole number below 2^53, so the order does not matter.
        a, b = points.astype(np.float64), centroids.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each pair (i, j) the most by which the distance from a point of the sphere of cluster i
    (centre ``old[i]``, ``radii[i]``) to centroid j can have fallen; below 0 where it must have
    grown. Never more than the drift of j."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    apart = old[:, None] - old[None, :]
    distance = np.sqrt((apart**2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        # Angle at old[j] between its move and the centre of sphere i, and that of the sphere.
        turn = np.arccos(np.clip((apart * move[None]).sum(2) / (distance * drift[None]), -1, 1))
        width = np.arcsin(np.clip(radii[:, None] / distance, 0, 1))
    inside = radii[:, None] >= distance
    # The part of the move in the direction of a point only shrinks as the centroid moves.
    most = drift[None] * np.cos(np.maximum(turn - width, 0))
    most = np.where(inside | ~np.isfinite(most), drift[None], most)
    return np.where(drift[None] > 0, most, 0.0)


def _sums(cluster: np.ndarray, points: np.ndarray, upper: np.ndarray, distance: np.ndarray) -> list[dict]:
    made = []
    for c in np.unique(cluster):
        of = cluster == c
        made.append(
            {
                "cluster": int(c),
                "n": int(of.sum()),
                "total": points[of].sum(axis=0).tolist(),
                "radius": float(upper[of].max()),
                "inertia": int(distance[of].sum()),
            }
        )
    return made


def assign(
    points: np.ndarray,
    centroids: np.ndarray,
    before: tuple[np.ndarray, np.ndarray, np.ndarray] | None,
    moved: tuple[np.ndarray, np.ndarray] | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper and lower bound of each point, and how many were scanned.

    ``before`` has the three of the round before, ``moved`` the drift of each centroid and the
    loosening of the lower bound of each cluster."""
    if before is None:
        cluster = np.zeros(len(points), np.int8)
        upper, lower = np.full(len(points), np.inf), np.zeros(len(points))
    else:
        cluster, upper, lower = (x.copy() for x in before)
        drift, loose = moved
        upper += drift[cluster] + SLACK
        lower -= loose[cluster] + SLACK
    # The own distance first: it often settles what the moved bound leaves open.
    open_ = np.flatnonzero(upper + SLACK >= lower)
    if before is not None and len(open_):
        own = ((points[open_] - centroids[cluster[open_]]) ** 2).sum(1)
        upper[open_] = np.sqrt(own.astype(np.float64))
        open_ = open_[upper[open_] + SLACK >= lower[open_]]
    if len(open_):
        found = squared(points[open_], centroids)
        nearest = found.argmin(axis=1)
        cluster[open_] = nearest
        upper[open_] = np.sqrt(found[np.arange(len(open_)), nearest].astype(np.float64))
        if len(centroids) > 1:
            found[np.arange(len(open_)), nearest] = np.iinfo(np.int64).max
            lower[open_] = np.sqrt(found.min(axis=1).astype(np.float64))
        else:
            lower[open_] = np.inf
    return cluster, upper, lower, len(open_)


def _pack(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of vectors: ``block``, ``ids`` and ``points`` (bytes of 64-bit and 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows, points in whole_rows(batch.column(1), scale, MOST):
                if points.shape[1] != size:
                    continue
                for at in range(0, len(rows), BLOCK):
                    ids = batch.column(0).take(pa.array(rows[at : at + BLOCK]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block], pa.int64()),
                            pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                            pa.array([points[at : at + BLOCK].astype("<i4").tobytes()], pa.binary()),
                        ],
                        names=["block", "ids", "points"],
                    )
                    block += 1

    show_library(vectors.sparkSession)
    return vectors.select("vec_id", "embedding").mapInArrow(
        run, "block long, ids array<long>, points binary"
    )


class _Tables:
    """Bucketed tables in the shared folder; their names go when the work is done."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = work_dir(self.spark, name)
        table = f"{name}_{uuid.uuid4().hex}"
        (
            frame.write.bucketBy(self.buckets, "block")
            .option("path", path)
            .format("parquet")
            .saveAsTable(table)
        )
        self.names.append(table)
        return self.spark.table(table)


def _starts(vectors: DataFrame, k: int, size: int, scale: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest digest of seed and id, as whole numbers."""
    whole = (F.size("embedding") == size) & F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)),
    )
    rows = (
        vectors.where("vec_id is not null and embedding is not null")
        .where(whole)
        .select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("digest"), "embedding")
        .orderBy("digest", "embedding")
        .limit(k)
        .collect()
    )
    if not rows:
        return np.zeros((0, size), np.int64)
    column = pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))
    return whole_rows(column, scale, MOST)[0][1]


def _round(
    blocks: DataFrame,
    state: DataFrame | None,
    centroids: np.ndarray,
    moved: tuple[np.ndarray, np.ndarray] | None,
) -> DataFrame:
    """The state after one assignment."""
    size = centroids.shape[1]
    names = ["block", "points"]
    joined = blocks.select(*names)
    if state is not None:
        names += ["cluster", "upper", "lower"]
        # Both are bucketed by block: a hash join without exchange or sort.
        joined = joined.join(state.select("block", *names[2:]).hint("shuffle_hash"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                block, data, *held = (c[i] for c in batch.columns)
                points = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, size).astype(np.int64)
                before = None
                if held:
                    before = tuple(np.frombuffer(h.as_buffer(), t) for h, t in zip(held, ("i1", "<f8", "<f8")))
                cluster, upper, lower, scanned = assign(points, centroids, before, moved)
                distance = ((points - centroids[cluster]) ** 2).sum(1)
                out.append(
                    {
                        "block": block.as_py(),
                        "n": len(points),
                        "scanned": scanned,
                        "cluster": cluster.tobytes(),
                        "upper": upper.tobytes(),
                        "lower": lower.tobytes(),
                        "distance": distance.tobytes(),
                        "sums": _sums(cluster, points, upper, distance),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    spark = blocks.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], STATE).schema)
    show_library(spark)
    return joined.select(*names).mapInArrow(run, STATE)


def _totals(state: DataFrame, size: int) -> list:
    """One row a cluster: ``n``, sums, radius and inertia, added up before they are shuffled."""
    each = state.select(F.explode("sums").alias("s")).select("s.*")
    return (
        each.groupBy("cluster")
        .agg(
            F.sum("n").alias("n"),
            F.array(*(F.sum(F.col("total")[i]) for i in range(size))).alias("total"),
            F.max("radius").alias("radius"),
            F.sum("inertia").alias("inertia"),
        )
        .collect()
    )


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    size: int = SIZE,
    scale: int = SCALE,
    seed: str = "3:",
    progress: list | None = None,
) -> DataFrame:
    """A row for each clustered vector: ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    ``progress``, if given, gets the vectors that were scanned in each round."""
    if not 1 <= k <= 127:
        raise ValueError("k: from 1 to 127")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    centroids = _starts(rows, k, size, scale, seed)
    schema = (
        "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    if not len(centroids):
        return spark.createDataFrame([], schema)
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BUCKET))
    tables = _Tables(spark, buckets)
    try:
        blocks = tables.write(_pack(rows, size, scale).repartition(buckets, "block"), "blocks")
        state, moved = None, None
        for turn in range(rounds + 1):
            state = tables.write(_round(blocks, state, centroids, moved), "bounds")
            if progress is not None:
                progress.append(state.agg(F.sum("scanned")).first()[0])
            totals = {r["cluster"]: r for r in _totals(state, size)}
            if turn == rounds:
                break
            new = centroids.copy()
            radii = np.zeros(len(centroids))
            for c, row in totals.items():
                new[c] = [x // row["n"] for x in row["total"]]
                radii[c] = row["radius"] + SLACK
            drift = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(1))
            loose = loosening(centroids, new, radii)
            # The own centroid is no part of the lower bound.
            np.fill_diagonal(loose, -np.inf)
            moved = drift, loose.max(axis=1) if len(centroids) > 1 else np.zeros(1)
            centroids = new
        made = blocks.join(state.select("block", "cluster", "distance").hint("shuffle_hash"), "block")
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
        sums = {c: r["inertia"] for c, r in totals.items()}
        every = sum(sums.values())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, cluster, distance = (c[i] for c in batch.columns)
                    number = np.frombuffer(cluster.as_buffer(), "i1").astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids.as_py(), pa.int64()),
                            pa.array(number),
                            pa.array(np.frombuffer(distance.as_buffer(), "<i8")),
                            pa.array([sums[c] for c in number.tolist()], pa.int64()),
                            pa.array([every] * len(number), pa.int64()),
                            pa.array([digests[c] for c in number.tolist()], pa.string()),
                        ],
                        names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                    )

        return made.select("ids", "cluster", "distance").mapInArrow(run, schema)
    finally:
        # The data stay in the shared folder, where the result reads them; only the names go.
        for name in tables.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
