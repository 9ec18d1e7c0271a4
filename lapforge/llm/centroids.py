"""Centroid clustering (k-means rounds on whole numbers) with Ptolemaic pivots.

Vectors are whole numbers floor(64 * entry), so distances, sums and updates are exact. Pivots are
a few of the first centroids, far apart from one another, and stay the same in every round; a
vector's distances to them are computed once and kept beside it. For a vector o, a centroid c and
a pair of pivots s, t, Ptolemy's inequality gives

    d(o, c) >= |d(o, s) * d(c, t) - d(o, t) * d(c, s)| / d(s, t)

without looking at the entries. The largest bound over the pairs, rounded down by more than its
floating-point error, excludes a centroid if it is over the vector's distance to the centroid of
least bound; the survivors' squared distances are computed exactly in 64-bit integers.

A round is one pass: each task assigns its vectors and adds them up by centroid, Spark sums the
tasks' rows, and k * dim sums come to the driver. A centroid of a third of all vectors is k rows a
task like any other.

Defined results: rows whose vector is null, has another length than dim, or holds a null or non-finite
entry are left out. Whole numbers count 2**27 in size at most, so that every squared distance fits a
long. With under k vectors there are as many centroids as vectors; an empty table has none and
gives no rows. Rows without an id come last as first centroids; equal ids go by their vector. Equal
distances take the smaller number. Repeated rows count each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage
from .vectors import is_whole, matrix, scaled

SCALE, LIMIT = 64.0, 2**27
#: Pivots, of which all pairs are used.
PIVOTS = 5
#: Rounding error of a bound, relative to the products that it subtracts: some 6 roundings of 2**-53 each.
_ERROR = 2.0**-48
#: Cells of (vectors x centroids) held at once.
_CELLS = 1 << 20


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, pair by pair."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _far_apart(points: np.ndarray, k: int) -> np.ndarray:
    """At most k distinct of the points: the first, then each time the one farthest from those taken."""
    if not len(points):
        return points
    taken, least = [0], _squared(points, points[:1])
    while len(taken) < k and least.max() > 0:
        taken.append(int(least.argmax()))
        least = np.minimum(least, _squared(points, points[taken[-1] :][:1]))
    return points[taken]


def distances_to(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.column_stack([_squared(points, p[None, :]) for p in pivots]).astype(float)) if len(pivots) else np.zeros((len(points), 0))


def lower_bounds(near: np.ndarray, centroids_near: np.ndarray, pivots_near: np.ndarray) -> np.ndarray:
    """(vectors x centroids) a number that their distance isn't under, by Ptolemy's inequality over all
    pairs of pivots. near: distances to the pivots, of vectors, centroids and pivots."""
    out = np.zeros((len(near), len(centroids_near)))
    for s in range(near.shape[1]):
        for t in range(s):
            a, b = np.outer(near[:, s], centroids_near[:, t]), np.outer(near[:, t], centroids_near[:, s])
            np.maximum(out, (np.abs(a - b) - _ERROR * (a + b)) / (pivots_near[s, t] * (1 + _ERROR)), out=out)
    return out


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, centroids_near: np.ndarray, pivots_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, squared distance, exact distances computed) of each vector."""
    parts = []
    step = max(1, _CELLS // max(1, len(centroids)))
    for at in range(0, len(x), step):
        own = x[at : at + step]
        bound = lower_bounds(near[at : at + step], centroids_near, pivots_near)
        guess = bound.argmin(1)
        rows = np.arange(len(own))
        upper = _squared(own, centroids[guess])
        alive = bound * bound * (1 - _ERROR) <= upper[:, None] * (1 + _ERROR)
        alive[rows, guess] = False
        exact = np.full(bound.shape, np.iinfo(np.int64).max)
        exact[rows, guess] = upper
        i, c = np.nonzero(alive)
        for k in range(0, len(i), step):
            exact[i[k : k + step], c[k : k + step]] = _squared(own[i[k : k + step]], centroids[c[k : k + step]])
        best = exact.argmin(1)  # the first of equal ones
        parts.append((best, exact[rows, best], alive.sum(1) + 1))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def kept_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64) -> DataFrame:
    """(id, x) of the rows that count."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.size("v") == dim)
    return rows.where(is_whole(F.col("v"))).select("id", scaled(F.col("v"), SCALE, LIMIT).alias("x"))


def _updated(vectors: DataFrame, centroids: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each centroid's vectors' floor(sum / count), by dimension; centroids without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                best, _, _ = nearest(x, matrix(batch.column("near")), centroids, *near)
                order = np.argsort(best, kind="stable")
                some, first = np.unique(best[order], return_index=True)
                sums[some] += np.add.reduceat(np.column_stack([x, np.ones(len(x), np.int64)])[order], first, axis=0)
        some = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["c", "sums"])

    parts = vectors.select("x", "near").mapInArrow(run, "c long, sums array<long>")
    total = parts.select("c", F.posexplode("sums").alias("at", "v")).groupBy("c", "at").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v"))
    cells: dict[int, dict[int, int]] = {}
    for r in total.toArrow().to_pylist():  # centroids x dimensions
        cells.setdefault(r["c"], {})[r["at"]] = int(r["v"])
    out = centroids.copy()
    for c, sums in cells.items():
        count = sums.pop(centroids.shape[1])
        out[c] = [sums[d] // count for d in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance: squared, checked: exact distances computed) of each (id, x) row, staged,
    and the final centroids."""
    named = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    seeds = vectors.select(named.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), len(seeds[0]["x"]) if seeds else 0)
    fixed = _far_apart(centroids, pivots)
    to_pivots = F.arrow_udf(lambda x: pa.array(list(distances_to(matrix(x), fixed)), pa.list_(pa.float64())), "array<double>")
    vectors = stage(vectors.select("id", "x", to_pivots("x").alias("near")), "near")
    for _ in range(rounds if len(centroids) else 0):
        centroids = _updated(vectors, centroids, (distances_to(centroids, fixed), distances_to(fixed, fixed)))
    near = distances_to(centroids, fixed), distances_to(fixed, fixed)

    def assign(x: pa.Array, own: pa.Array) -> pa.Array:
        best, distance, checked = nearest(matrix(x), matrix(own), centroids, *near)
        return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.array(checked, pa.int32())], names=["cluster", "distance", "checked"])

    told = F.arrow_udf(assign, "cluster int, distance long, checked int")("x", "near").alias("a")
    out = stage(vectors.select("id", told).select("id", "a.*"), "assigned")
    drop_stage(vectors)
    return out, centroids


def cluster_report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia (sums of the squared distances, as decimals) and
    centroid_sha256 (of the final centroid's whole numbers, joined by commas)."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("cluster_inertia"))
    told = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    names = assigned.sparkSession.createDataFrame(told, "cluster int, centroid_sha256 string")
    # a row a centroid on both sides: no more than k
    per = sums.join(sums.agg(F.sum("cluster_inertia").alias("inertia"))).join(F.broadcast(names), "cluster")
    return assigned.join(F.broadcast(per), "cluster")
