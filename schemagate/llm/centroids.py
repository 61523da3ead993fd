"""Centroid clustering over an incremental distance matrix of exact integers.

Components become integers floor(256 * x). For every vector the dot products with all centroids are kept in a table;
when centroids move, a dot product changes by the vector's components times the change of the centroid's, and only
components whose change is not zero are read. Squared distances follow from the dot products and the two squared
lengths, so a round is one pass over the table: update, take the nearest, write the next table. The sums of the new
clusters are added up per task first; what meets in Spark are one row per task, cluster and component, and what the
driver sees is one row per cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagate.llm.common import keep, share, shared, slices

DIMENSION, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components beyond this have squared distances beyond 64 bits.
LARGEST = 2**26
#: Vectors of a batch in a task.
ROWS = 8192


def integer_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors that are kept."""
    component = lambda v: F.floor(v.cast("double") * scale)
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(LARGEST / scale)))
    return vectors.where((F.size("embedding") == dimension) & fit).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", component).alias("x"))


def start_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, dimension: int = DIMENSION) -> np.ndarray:
    """The vectors of smallest sha256 of `seed:vec_id`; as many rows as there are, at most `clusters`."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(mark.asc_nulls_last(), "x").select("x").limit(clusters).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, dimension)


def added_products(x: np.ndarray, change: np.ndarray, dots: np.ndarray) -> np.ndarray:
    """dots + x @ change.T, reading only components in which a centroid has changed."""
    dots = dots.copy()
    if not len(x):
        return dots
    # doubles hold these products exactly as long as no sum can pass 2^53
    exact = float(np.abs(x).max()) * float(np.abs(change).max(initial=0)) * x.shape[1] < 2**53
    values = x.astype(np.float64) if exact else x
    for c in np.flatnonzero(change.any(axis=1)):
        moved = np.flatnonzero(change[c])
        dots[:, c] += (values[:, moved] @ change[c, moved].astype(values.dtype)).astype(np.int64)
    return dots


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def reassigned(table: DataFrame, centroids: np.ndarray, change: np.ndarray) -> DataFrame:
    """The next table (vec_id, x, dots, cluster, distance) from one with dots of centroids - change, or none yet."""
    sent = share(table.sparkSession, (centroids, change))
    first = "dots" not in table.columns

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, moved = shared(sent)
        k, width = centres.shape
        lengths = (centres * centres).sum(axis=1)
        for batch in slices(batches, ROWS):
            x = _matrix(batch["x"], width)
            dots = added_products(x, moved, np.zeros((len(x), k), np.int64) if first else _matrix(batch["dots"], k))
            squared = (x * x).sum(axis=1)[:, None] - 2 * dots + lengths
            cluster = squared.argmin(axis=1)  # the first of equals
            distance = squared[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["x"], _lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "x", "dots", "cluster", "distance"])

    return table.mapInArrow(update, "vec_id bigint, x array<bigint>, dots array<bigint>, cluster int, distance bigint")


def cluster_sums(table: DataFrame, clusters: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of vectors and number of vectors per cluster."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dimension + 1), np.int64)
        for batch in slices(batches, ROWS):
            x = np.column_stack([_matrix(batch["x"], dimension), np.ones(batch.num_rows, np.int64)])
            np.add.at(total, batch["cluster"].to_numpy(), x)
        row, column = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), pa.array(total[row, column])], ["cluster", "place", "total"])

    parts = table.select("x", "cluster").mapInArrow(add, "cluster bigint, place bigint, total bigint")
    out = np.zeros((clusters, dimension + 1), np.int64)
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():  # clusters x (dimension + 1) rows at most
        out[r.cluster, r.place] = r.total
    return out[:, :-1], out[:, -1]


def moved_centroids(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Floor of each cluster's mean; empty clusters stay where they are."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)


def cluster_vectors(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept from (vec_id, embedding).

    Kept are vectors of `dimension` components, none null or non-finite; components of 2^26 / `scale` and more, whose
    squared distances leave 64 bits, are refused likewise; an inertia beyond 64 bits is null. Equal distances go to the smaller cluster number. Repeated
    rows are clustered each. A null vec_id is clustered but starts no centroid unless ids run out. Fewer vectors than
    clusters: as many clusters as vectors. No vectors: no rows. Other columns are not read.
    """
    kept = keep(integer_vectors(vectors.select("vec_id", "embedding"), dimension, scale), "centroid-vectors")
    centroids = start_centroids(kept, clusters, seed, dimension)
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    table, change = keep(reassigned(kept, centroids, centroids), "centroid-dots"), centroids
    for _ in range(rounds):
        after = moved_centroids(centroids, *cluster_sums(table, *centroids.shape))
        change, centroids = after - centroids, after
        if change.any():
            table = keep(reassigned(table, centroids, change), "centroid-dots")
    rows = table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of_cluster")).collect()  # one row a cluster
    inertia, long = {r.cluster: int(r.of_cluster) for r in rows}, lambda n: n if n < 2**63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return table.select(
        "vec_id", "cluster", "distance", by([long(inertia.get(c, 0)) for c in range(len(centroids))]).cast("bigint").alias("cluster_inertia"),
        F.lit(long(sum(inertia.values()))).cast("bigint").alias("inertia"), by(digests).alias("centroid_sha256"),
    )
