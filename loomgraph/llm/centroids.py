"""Clustering of integer vectors by nearest centroid, searched coarse to fine over Walsh-Hadamard coefficients.

A vector's components x become floor(256 * x). Vectors and centroids go through the same exact integer transform H of
order 64, rows ordered by their number of sign changes. As H has orthogonal rows of length 8, the squared differences of
all 64 coefficients add up to 64 times the squared distance, and those of the first few to no more than that. So tasks
add up differences block by block (BLOCKS); the centroid that leads after the first block gets all its coefficients at
once, and a centroid whose sum so far is over the least whole sum known can't be nearest any more and goes. What is left
after the last block has exact distances; of equal ones the smaller number wins. No float enters a distance.

Each round is one scan of the transformed vectors: a task sends a count and 64 sums for each centroid it saw. Centroids
are at most `k` rows of 64 numbers; only they pass through the driver.

Vectors are left out where they are null, have not 64 components, or have a null or non-finite one, or one of |x| >=
2**19 (their squared distances need not fit a long). Fewer than k vectors give as many centroids; of rows with one
vec_id the one of smaller components is drawn first, and a null vec_id counts as an empty one in the draw. Repeated rows
are vectors of their own. An empty table gives no rows. A sum of distances that does not fit a long is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize

DIM, SCALE, MOST = 64, 256, 1 << 19
#: Coefficients from coarse to fine; edges of the blocks in which differences are added up.
BLOCKS = (0, 4, 8, 16, 32, 64)
#: Components up to which 64-bit sums of squared coefficient differences can't overflow; beyond, Python's whole numbers.
SMALL = 1 << 23
#: Vectors that one step compares.
STEP = 2048


def _order() -> np.ndarray:
    """Rows of the fast transform by their number of sign changes."""
    signs = np.array([[(-1) ** (i & j).bit_count() for j in range(DIM)] for i in range(DIM)])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


ORDER = _order()


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of rows of 64 whole numbers, coarse to fine; six steps of sums and differences."""
    out, half = rows, 1
    while half < DIM:
        pairs = out.reshape(len(rows), -1, 2, half)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(len(rows), DIM)
        half *= 2
    return out[:, ORDER]


def restored(coefficients: np.ndarray) -> np.ndarray:
    """The rows whose coefficients these are: the transform is its own inverse but for a factor of 64."""
    back = np.empty_like(coefficients)
    back[:, ORDER] = coefficients
    return transform(back)[:, np.argsort(ORDER)] // DIM


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of coefficients the nearest centroid (coefficients too), its squared distance, and how many
    coefficient differences were taken in all."""
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) > SMALL * DIM:
        rows, centroids = rows.astype(object), centroids.astype(object)
    each = np.arange(len(rows))
    first = slice(*BLOCKS[:2])
    so_far = (np.square(rows[:, None, first] - centroids[None, :, first])).sum(2)
    lead = so_far.argmin(1)
    bound = np.square(rows - centroids[lead]).sum(1)
    taken = so_far.size * BLOCKS[1] + rows.size
    alive = so_far <= bound[:, None]
    for start, end in zip(BLOCKS[1:-1], BLOCKS[2:], strict=True):
        row, centroid = np.nonzero(alive)
        so_far[row, centroid] += np.square(rows[row, start:end] - centroids[centroid, start:end]).sum(1)
        taken += len(row) * (end - start)
        alive[row, centroid] = so_far[row, centroid] <= bound[row]
    whole = np.where(alive, so_far, so_far.max() + 1)
    best = whole.argmin(1)
    return best, so_far[each, best] // DIM, taken


def kept_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and components (64 whole numbers) of the vectors that count."""
    value = F.col(vector)
    good = (F.size(value) == DIM) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(good).select(F.col(vec_id).alias("vec_id"), whole.alias("components"))


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, DIM)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * DIM, pa.int32()), pa.array(rows.ravel().astype(np.int64)))


def _transformer(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(transform(_matrix(batch.column(1))))], names=["vec_id", "coefficients"])


def _steps(batches, column: int):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, _matrix(part.column(column))


def _summer(centroids: np.ndarray):
    def add_up(batches):
        sums, counts = np.zeros((len(centroids), DIM), object), np.zeros(len(centroids), np.int64)
        for _, rows in _steps(batches, 0):
            best, _, _ = nearest(rows, centroids)
            counts += np.bincount(best, minlength=len(centroids))
            order = np.argsort(best, kind="stable")
            seen, at = np.unique(best[order], return_index=True)
            sums[seen] += np.add.reduceat(rows[order], at, axis=0)
        used = np.flatnonzero(counts)
        if len(used):
            # A task's sums leave as sums of components, which are exact again and smaller.
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), _lists(restored(sums[used]))], names=["cluster", "n", "sums"])

    return add_up


def _assigner(centroids: np.ndarray):
    def assign(batches):
        for part, rows in _steps(batches, 1):
            best, distance, _ = nearest(rows, centroids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(distance.astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return assign


def drawn(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The components of the k vectors of least sha256 of salt:vec_id."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.orderBy(key, "components").limit(k).select("components").collect()
    return np.array([r["components"] for r in rows], np.int64).reshape(-1, DIM)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: centroids replaced by the floor of their vectors' mean; those without vectors stay."""
    found = rows.select("coefficients").mapInArrow(_summer(transform(centroids)), "cluster int, n long, sums array<long>")
    total: list[Column] = [F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM))]
    out = centroids.copy()
    for row in found.groupBy("cluster").agg(*total).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(DIM)]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every vector that counts, and the centroids after `rounds` rounds."""
    bound_batches(vectors.sparkSession)
    kept = kept_vectors(vectors, vec_id, vector)
    id_field = T.StructField("vec_id", kept.schema["vec_id"].dataType)
    centroids = drawn(kept, k, salt)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), centroids
    schema = T.StructType([id_field, T.StructField("coefficients", T.ArrayType(T.LongType()))])
    rows = materialize(kept.mapInArrow(_transformer, schema), "coefficients")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    schema = T.StructType([id_field, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return rows.mapInArrow(_assigner(transform(centroids)), schema), centroids


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """cluster, centroid and the sha256 of its components as decimal numbers, comma-joined: one row for each centroid."""
    listed = [(n, row, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for n, row in enumerate(centroids.tolist())]
    return spark.createDataFrame(listed, "cluster int, centroid array<long>, centroid_sha256 string")


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    assigned, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assigned = materialize(assigned, "assigned")
    by_cluster = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    # One row for each centroid, k at most, and one for all.
    told = by_cluster.join(centroid_table(spark, centroids).select("cluster", "centroid_sha256"), "cluster")
    whole = assigned.agg(F.try_sum("distance").alias("inertia"))
    return assigned.join(F.broadcast(told), "cluster").join(F.broadcast(whole)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
