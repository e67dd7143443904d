"""Centroid clustering of integer vectors with Hamerly bounds.

Each vector keeps, beside its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to every other one. When
centroids move, the upper bound grows by its centroid's drift and the lower one falls by the largest drift of the others. While the upper bound is
below the lower one, or below half of the distance from its centroid to the nearest other one, the vector stays without being measured.
Otherwise the upper bound is set to the exact distance, and if that isn't enough the vector is compared with all centroids in integers. Bounds are rounded outward by
far more than floating point can err, so the result is that of comparing everything, exactly.

Vectors never move: each round reads the table of the round before and writes vectors and bounds anew, side by side. Only the sums of
clusters are shuffled, and the driver sees no more than the centroids.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, shared_folder

#: Components beyond this are out of range: squared distances and their sums must fit 64 bits.
LARGEST = 1 << 26
#: Outward rounding of bounds, as a share of them: floating point errs by less than 1e-15 an operation.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """_id and _v (integers floor(scale * x)) of the rows with exactly dims components, none null, non-finite or out of range."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(float(scale)) * F.when(F.abs(c.cast("double")) <= float(LARGEST // scale), c.cast("double"))).cast("int"))
    rows = vectors.where(F.size(vector_col) == dims).select(F.col(id_col).alias("_id"), x.alias("_v"))
    return rows.where(~F.exists("_v", lambda c: c.isNull()))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids, as seed:id, have the least sha256, in that order; ties by the vector. A null id counts as the empty text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    return np.array([r._v for r in rows.select(key.alias("_key"), "_v").orderBy("_key", "_v").limit(k).collect()], np.int64)


def _squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors and centroids."""
    return (v * v).sum(axis=1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]


def _up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper, lower and scanned (which vectors were compared with all centroids) after the centroids moved by moved (upper bounds of their
    drifts), from those before. None: nothing is known yet. Ties go to the smaller number."""
    k, rows = len(centroids), np.arange(len(v))
    if moved is None:
        todo = rows
        cluster, upper, lower = (np.zeros(len(v), t) for t in (np.int32, np.float64, np.float64))
    else:
        order = np.argsort(moved)
        most, second = moved[order[-1]], moved[order[-2]] if k > 1 else 0.0
        upper = upper + moved[cluster]
        lower = lower - np.where(cluster == order[-1], second, most)
        apart = _squared(centroids, centroids)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        safe = np.maximum(lower, _down(apart.min(axis=1))[cluster] / 2)
        near = np.flatnonzero(upper >= safe)
        exact = v[near] - centroids[cluster[near]]
        upper[near] = _up((exact * exact).sum(axis=1))
        todo = near[upper[near] >= safe[near]]
        cluster = cluster.copy()
    if len(todo):
        d = _squared(v[todo], centroids)
        best = d.argmin(axis=1).astype(np.int32)
        cluster[todo], upper[todo] = best, _up(d[np.arange(len(todo)), best])
        d[np.arange(len(todo)), best] = np.iinfo(np.int64).max
        lower[todo] = _down(d.min(axis=1))
    scanned = np.zeros(len(v), np.int32)
    scanned[todo] = 1
    return cluster, upper, lower, scanned


class _Rounds:
    """The table of each round in the shared folder. A round's table goes once the next one stands, so two lie there at most."""

    def __init__(self, spark):
        self.spark, self.folder, self.round = spark, posixpath.join(shared_folder(spark), f"clusters-{uuid.uuid4().hex}"), 0

    def _path(self, number: int) -> str:
        return posixpath.join(self.folder, str(number))

    def next(self, df: DataFrame) -> DataFrame:
        df.write.parquet(self._path(self.round))
        if self.round:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(self.round - 1))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.round += 1
        return self.spark.read.schema(df.schema).parquet(self._path(self.round - 1))


def _reassigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """state with its clusters and bounds brought up to the centroids."""
    names = ["_id", "_v", "_cluster", "_upper", "_lower", "_scans"]
    dims = centroids.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            cluster, upper, lower, scans = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
            cluster, upper, lower, scanned = assign(v, cluster, upper, lower, centroids, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(upper), pa.array(lower), pa.array(scans + scanned)], names)

    return batched(state.select(*names)).mapInArrow(apply, f"_id {dict(state.dtypes)['_id']}, _v array<int>, _cluster int, _upper double, _lower double, _scans int")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids, each that has vectors replaced by their componentwise floor(sum / count)."""
    sums = [F.sum(F.get("_v", i).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("_cluster").agg(F.count("*").alias("_n"), *sums).collect():
        out[row._cluster] = [x // row._n for x in row[2:]]
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids). Per kept vector: its id, cluster, distance (squared, to the final centroid) and n_scans, the rounds in which it was compared
    with all centroids. Components are taken as floor(scale * x). The first centroids are k vectors chosen by a hash of seed and id (fewer where there
    are fewer); each round assigns every vector to the nearest centroid (ties: the smaller number) and replaces each centroid that has vectors by their mean,
    rounded down; then vectors are assigned once more.

    Kept are vectors of exactly dims components, none of them null, NaN, infinite or beyond LARGEST / scale. Null ids are ids like any other,
    and count as the empty text in the choice of the first centroids; repeated rows are vectors of their own, and may give equal centroids, of which only the
    first gets vectors. Columns other than id and vector are ignored, whatever their names. An empty table gives no rows and no centroids.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, dims, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select(F.col("_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("n_scans")).limit(0), centroids.reshape(0, dims)
    zero = [F.lit(0).alias("_cluster"), F.lit(0.0).alias("_upper"), F.lit(0.0).alias("_lower"), F.lit(0).alias("_scans")]
    state, kept, moved = rows.select("*", *zero), _Rounds(spark), None
    for _ in range(rounds):
        state = kept.next(_reassigned(state, centroids, moved))
        now = _means(state, centroids)
        moved = _up(((now - centroids) ** 2).sum(axis=1))
        centroids = now
    state = kept.next(_reassigned(state, centroids, moved))
    table = F.element_at(_literal(centroids), F.col("_cluster") + 1)
    far = F.aggregate(F.zip_with("_v", table, lambda x, c: (x - c) * (x - c)), F.lit(0).cast("long"), lambda a, d: a + d)
    return state.select(F.col("_id").alias(id_col), F.col("_cluster").alias("cluster"), far.alias("distance"), F.col("_scans").alias("n_scans")), centroids


def _literal(centroids: np.ndarray) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"bigint('{x}')" for x in c) + ")" for c in centroids.tolist()) + ")")


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows of clusters with cluster_inertia and inertia (the sum of distances over the row's cluster and over all rows) and centroid_sha256 (of the
    components of its final centroid as decimal numbers, joined by commas). There are no more sums than centroids."""
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()
    if not sums:
        return rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    named = {r.cluster: hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest() for r in sums}
    table = rows.sparkSession.createDataFrame([(r.cluster, r.n, sum(x.n for x in sums), named[r.cluster]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(*rows.columns, "cluster_inertia", "inertia", "centroid_sha256")
