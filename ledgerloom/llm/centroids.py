"""k-means over integer vectors with exact results, screened by block norms.

A vector of integers is cut into segments, and the norm of each segment is computed once and stored
beside it: a compressed vector of a few numbers.  By the Cauchy-Schwarz inequality in every segment
``|x - c|^2 >= sum_s (|x_s| - |c_s|)^2``, so the compressed vector and the compressed centroid give a
lower bound of the distance.  A vector first gets its exact distance to the centroid of the least
bound; every other centroid whose bound already exceeds the best distance is left out, and only
the rest receive exact integer distances.  Bounds are floating point and get a little slack, so
that no centroid is left out for rounding, ties included.

A round is one narrow pass over the stored vectors: each task adds up its vectors per centroid, and
only these sums (``k`` times the number of tasks) are shuffled.  The driver holds the centroids,
``k`` vectors, and nothing that grows with the rows.  Sums are exact decimals.

Defined results: vectors that are null, are not of the asked width, or hold null or non-finite
components take no part; rows that share an id are vectors of their own; a row with a null id is
assigned but starts no centroid; of equal hashes the lesser vector starts first; fewer vectors than
``k`` give as many centroids; equal distances go to the smaller number; a centroid that no vector
is nearest to stays; an empty table gives no rows; components of which distances would not fit in
63 bits raise :class:`OverflowError`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches
from .mtree import usable

SEGMENT = 8


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The norm of each segment of every row: the compressed vectors."""
    return np.sqrt(np.add.reduceat(x.astype(float) ** 2, np.arange(0, x.shape[1], segment), axis=1))


def lower_bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances, rows x centroids."""
    squares = (norms**2).sum(axis=1)[:, None] + (centroid_norms**2).sum(axis=1)[None]
    return squares - 2 * (norms @ centroid_norms.T) - 1e-9 * squares - 1e-6


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and its squared distance; ``count`` gathers the exact distances computed."""
    low = lower_bounds(norms, segment_norms(centroids, segment))
    best = low.argmin(axis=1)
    far = exact(x, centroids[best])
    first = best.copy()
    # Centroids in the order of how near they may be to the batch: early ones tighten the rest.
    for j in np.argsort(low.mean(axis=0), kind="stable") if len(x) else ():
        rows = np.flatnonzero((low[:, j] <= far) & (first != j))
        if not len(rows):
            continue
        d = exact(x[rows], centroids[j][None])
        if count is not None:
            count[0] += len(rows)
        better = (d < far[rows]) | ((d == far[rows]) & (j < best[rows]))
        best[rows[better]], far[rows[better]] = j, d[better]
    if count is not None:
        count[0] += len(x)
    return best, far


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def compress(vectors: DataFrame, width: int, scale: int, seed: int, segment: int, id_col: str, vector: str) -> DataFrame:
    """``id, h, v, norms``: integer vectors with their hash and their segment norms."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    own = vectors.where(usable(F.col(vector)) & (F.size(vector) == width)).select(
        F.col(id_col).cast("long").alias("id"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("h"), v.alias("v")
    )
    most = int(np.sqrt(2.0**62 / width)) // 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(2), width)
            if len(x) and (x.max() > most or x.min() < -most):
                raise OverflowError("squared distances exceed 63 bits")
            norms = segment_norms(x, segment)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * norms.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(norms.ravel()))], names=["id", "h", "v", "norms"])

    return own.mapInArrow(add, "id long, h string, v array<long>, norms array<double>")


def _means(rows: DataFrame, now: np.ndarray, segment: int) -> np.ndarray:
    """The centroids after one more round."""
    k, width = now.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), width)
                cluster, _ = nearest(x, _rows(batch.column(1), -(-width // segment)), now, segment)
                n += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                there, starts = np.unique(cluster[order], return_index=True)
                sums[there] += np.add.reduceat(x[order], starts, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = rows.select("v", "norms").mapInArrow(add, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    exactly = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = now.copy()
    for r in parts.groupBy("cluster", "at").agg(exactly("n"), exactly("s")).collect():  # k x width rows
        out[r.cluster, r.at] = int(r.s) // int(r.n)
    return out


def k_means(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, segment: int = SEGMENT, id_col: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """Assignments ``id, cluster, distance`` and clusters ``cluster, n, cluster_inertia, inertia, centroid``.

    Centroids start as the vectors of the least hashes of seed and id and are replaced ``rounds``
    times by the floors of the means of their vectors; then all vectors are assigned once more.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = cut(compress(vectors, width, scale, seed, segment, id_col, vector), "vectors")
    start = rows.where("id IS NOT NULL").orderBy("h", "v").limit(k).select("v").collect()
    now = np.array([r.v for r in start], dtype=np.int64).reshape(len(start), width)
    if not len(now):
        drop_cut(rows)
        return spark.createDataFrame([], "id long, cluster int, distance long"), spark.createDataFrame([], "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        now = _means(rows, now, segment)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, far = nearest(_rows(batch.column(1), width), _rows(batch.column(2), -(-width // segment)), now, segment)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    assigned = cut(rows.select("id", "v", "norms").mapInArrow(assign, "id long, cluster int, distance long"), "assigned")
    drop_cut(rows)
    inertia = F.sum(F.col("distance").cast("decimal(38,0)"))
    totals = {r.cluster: (r.n, int(r.s)) for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), inertia.alias("s")).collect()}  # k rows
    whole = sum(s for _, s in totals.values())
    own = [(c, *totals.get(c, (0, 0)), whole, now[c].tolist()) for c in range(len(now))]
    return assigned, spark.createDataFrame(own, "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>")


def digest(centroid: np.ndarray) -> str:
    """Lowercase hex SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()
