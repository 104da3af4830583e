"""Centroid clustering in whole numbers, with a PCA-rotated filter before distances are computed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetra.llm.common import give_back, require
from kinetra.operators.sequence import cut_lineage

#: Largest whole component: squared distances of 64 of them, either sign, fit a long.
LARGEST = 1 << 27
#: Share of the variance that the stored leading coordinates hold.
HELD = 0.75
#: Relative error that rounding may put into a bound.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, width: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, values: vectors with exactly `width` components, none null or non-finite, as whole numbers floor(scale * x).

    Values stop at +-2**27, so that any squared distance fits a long.
    """
    require(vectors, "vec_id", "embedding")
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))

    def number(v):
        return F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")

    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, number).alias("values"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def rotation(whole: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, principal axes (columns, widest first) and variances along them, of all vectors.

    Each task sends sums and products of its vectors; Spark adds them up and `width` rows reach the driver. Rounding may turn the
    axes by a hair from run to run, which changes what is filtered and never what is found.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 2))
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(float)
            total[:, :width] += x.T @ x
            total[:, width] += x.sum(axis=0)
            total[:, width + 1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], ["axis", "sums"])
        give_back()

    parts = whole.select("values").mapInArrow(moments, "axis int, sums array<double>")
    # What lies in one task's row is a row of a square table; those of one axis are as many as there are tasks.
    sums = parts.groupBy("axis").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 2)]).alias("sums")).orderBy("axis").collect()
    table = np.array([r.sums for r in sums]) if sums else np.zeros((width, width + 2))
    n = max(1.0, table[0, width + 1])
    mean = table[:, width] / n
    spread = table[:, :width] / n - np.outer(mean, mean)
    wide, axes = np.linalg.eigh((spread + spread.T) / 2)
    return mean, axes[:, ::-1], np.maximum(wide[::-1], 0.0)


def enough_axes(variances: np.ndarray, held: float) -> int:
    """How many leading axes hold that share of the variance: few where vectors lie near a plane, most where they fill the space."""
    upto = np.cumsum(variances)
    return int(np.searchsorted(upto, held * upto[-1])) + 1 if upto[-1] > 0 else 1


def rotated(values: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated coordinates and the norm of the others."""
    turned = (values - mean) @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(axis=1))


def nearest(values: np.ndarray, head: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_head: np.ndarray, c_rest: np.ndarray,
            size: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (ties: the smaller number), and how many were computed.

    The squared distance of the leading coordinates plus the squared difference of the residual norms is never more than
    the distance itself. The centroid with the least bound is measured first, in whole numbers; then all others
    whose bound, less what rounding may have added, doesn't exceed that distance.
    """
    n, k = len(values), len(centroids)
    bound = (rest[:, None] - c_rest[None, :]) ** 2
    for j in range(head.shape[1]):
        bound += (head[:, j, None] - c_head[None, :, j]) ** 2

    def measure(row: np.ndarray, number: np.ndarray) -> np.ndarray:
        gap = values[row] - centroids[number]
        return np.einsum("ij,ij->i", gap, gap)

    everyone = np.arange(n)
    guess = bound.argmin(axis=1)
    best = measure(everyone, guess)
    bound[everyone, guess] = np.inf
    row, number = np.nonzero(bound * (1 - SLACK) - SLACK * size <= best[:, None])
    distances = np.full((n, k), np.iinfo(np.int64).max)
    distances[everyone, guess] = best
    distances[row, number] = measure(row, number)
    found = distances.argmin(axis=1)
    return found, distances[everyone, found], n + len(row)


#: Vectors handled at a time.
_CHUNK = 2048


class _Assign:
    """A pass over the prepared vectors with given centroids."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.centroids = centroids
        self.head, self.rest = rotated(centroids, mean, axes, leading)
        self.leading = leading
        self.norm = float((self.head ** 2).sum(axis=1).max() + (self.rest ** 2).max())

    def chunks(self, batch: pa.RecordBatch):
        values = _matrix(batch.column("values"), self.centroids.shape[1]).astype(np.int64)
        head, rest = _matrix(batch.column("head"), self.leading), batch.column("rest").to_numpy()
        for at in range(0, len(values), _CHUNK):
            cut = slice(at, at + _CHUNK)
            v, h, r = values[cut], head[cut], rest[cut]
            size = self.norm + float((h ** 2).sum(axis=1).max() + (r ** 2).max())
            yield v, *nearest(v, h, r, self.centroids, self.head, self.rest, size)

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = self.centroids.shape
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for values, found, _, _ in self.chunks(batch):
                # A chunk's sums stay below 2**53, so this product is exact.
                total += (np.eye(k)[found].T @ values).astype(np.int64)
                count += np.bincount(found, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])
        give_back()

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(f, d) for _, f, d, _ in self.chunks(batch)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.concatenate([p[0] for p in parts]), pa.int32()),
                                                  pa.array(np.concatenate([p[1] for p in parts]), pa.int64())], ["vec_id", "cluster", "distance"])
        give_back()


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; of equal ids the smaller values first."""
    named = whole.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    return np.array([r["values"] for r in named.orderBy("hash", "values").limit(k).collect()], np.int64)  # k rows


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64, scale: int = 256,
                    held: float = HELD, leading: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each kept vector of `vectors` (vec_id, embedding); the final centroids).

    Vectors are made whole by `whole_vectors` and stored once with their leading coordinates on the principal axes and the
    norm of the rest; `leading` coordinates, or as many as hold the share `held` of the variance. Each round assigns all of them, in parallel and without a shuffle of vectors: a task sends one row of
    exact sums for each centroid. A centroid with vectors moves to floor(sum / count) in each component, an empty one stays.
    Where `vectors` has fewer than k good ones, there are as many centroids as vectors.

    Repeated vectors count each; a null vec_id hashes as an empty one. Other columns are ignored. No vectors in, no rows out.
    """
    whole = whole_vectors(vectors, width, scale)
    mean, axes, variances = rotation(whole, width)
    leading = min(width, enough_axes(variances, held) if leading is None else leading)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, rest = rotated(_matrix(batch.column("values"), width).astype(float), mean, axes, leading)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("values"), pa.array(list(head), pa.list_(pa.float64())), pa.array(rest)],
                                             ["vec_id", "values", "head", "rest"])

    prepared = cut_lineage(whole.mapInArrow(prepare, "vec_id long, values array<int>, head array<double>, rest double"))
    centroids = first_centroids(prepared.select("vec_id", "values"), k, seed)
    if not len(centroids):
        return prepared.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, width), np.int64)
    for _ in range(rounds):
        moved = prepared.mapInArrow(_Assign(centroids, mean, axes, leading).sums, "cluster int, n long, sums array<long>")
        # One row a centroid comes back.
        totals = moved.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()
        centroids = centroids.copy()
        for r in totals:
            centroids[r.cluster] = np.array(r.sums, np.int64) // r.n
    return prepared.mapInArrow(_Assign(centroids, mean, axes, leading).rows, "vec_id long, cluster int, distance long"), centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each kept vector; see `cluster_vectors`."""
    assigned, centroids = cluster_vectors(vectors, **options)
    assigned = cut_lineage(assigned)
    sums = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    facts = [(i, sums[i], sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
             for i, c in enumerate(centroids.tolist()) if i in sums]
    per_cluster = vectors.sparkSession.createDataFrame(facts, "f_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(per_cluster), F.col("cluster") == F.col("f_cluster"))
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
