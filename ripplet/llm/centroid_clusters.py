"""Operator 12: clusters around centroids, by an incremental matrix of exact dot products.

Contract: vectors with exactly `dims` components, none of them null or non-finite, become integers
floor(scale * x). Centroids 0, 1, ... start as the `clusters` vectors with the smallest sha256 of
"<seed>:<id>", in that order. A round assigns every vector to its nearest centroid (squared Euclidean
distance, ties to the smaller number) and replaces each non-empty centroid by the exact floor of its
members' means. After the last round vectors are assigned once more.

The squared distance is |x|^2 - 2 x.c + |c|^2. For each vector the products x.c with all centroids are
kept in a table (exact 64-bit integers). A round's move of a centroid changes them by x.d, where d is
its change, and only the nonzero components of d are multiplied; then the smallest distance is taken
anew. Each round is one pass that reads the last table and writes the next, so a lost executor repeats
its tasks and nothing before. Sums of members are partial in each task, added by Spark, and reach the
driver as clusters x (dims + 1) numbers, as do the centroids: both are bounded by the parameters.

Rows: ids may be null or repeat: each row is a vector; a null id starts no centroid, of equal ids the
smaller vector comes first. A vector with a component beyond +-2^27 / scale takes no part, as its
squared distance may exceed 64 bits; so do null vectors and those of another length. With fewer vectors
than clusters there are fewer centroids. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.names import by_place, place
from ripplet.session import checkpoint_dir

LARGEST = 1 << 27
RESULTS = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
_TABLE = "id long, x array<int>, norm long, dots array<long>, cluster int, distance long"
_ARROW = pa.schema([
    ("id", pa.int64()), ("x", pa.list_(pa.int32())), ("norm", pa.int64()), ("dots", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()),
])


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, x) of the vectors that take part, as integers."""
    named, columns = by_place(vectors), vectors.columns
    rows = named.select(
        F.col(f"c{place(columns, id_col)}").cast("long").alias("id"), F.col(f"c{place(columns, vector_col)}").cast("array<double>").alias("v"),
    )
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale <= LARGEST))
    return rows.where((F.size("v") == dims) & usable).select("id", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _rows(batch: pa.RecordBatch, x: np.ndarray, norm: np.ndarray, dots: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    """Assign: |c|^2 - 2 x.c is smallest where the distance is; argmin takes the first of equal ones."""
    far = squares - 2 * dots
    cluster = far.argmin(1)
    lists = lambda m, kind: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel(), kind))
    return pa.RecordBatch.from_arrays([
        batch.column(0), lists(x, pa.int32()), pa.array(norm), lists(dots, pa.int64()),
        pa.array(cluster.astype(np.int32)), pa.array(norm + far[np.arange(len(far)), cluster]),
    ], schema=_ARROW)


def first_products(centroids: np.ndarray):
    """All products of every vector with every centroid, once."""
    squares = (centroids * centroids).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), centroids.shape[1])
                yield _rows(batch, x, (x * x).sum(1), x @ centroids.T, squares)

    return run


def changed_products(before: np.ndarray, after: np.ndarray):
    """Add to each product what the nonzero components of its centroid's change add."""
    squares = (after * after).sum(1)
    change = after - before
    moved = [(k, np.flatnonzero(change[k])) for k in range(len(change)) if change[k].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), after.shape[1])
                dots = _matrix(batch.column(3), len(after)).copy()
                for k, at in moved:
                    dots[:, k] += x[:, at] @ change[k, at]
                yield _rows(batch, x, batch.column(2).to_numpy(), dots, squares)

    return run


def member_sums(clusters: int, dims: int):
    """(cluster, place, total) of one task's members; place `dims` is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dims + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
                np.add.at(total[:, :dims], cluster, x)
                total[:, dims] += np.bincount(cluster, minlength=clusters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array((at // (dims + 1)).astype(np.int32)), pa.array((at % (dims + 1)).astype(np.int32)), pa.array(total.ravel()[at])], names=["cluster", "place", "total"],
        )

    return run


def moved_centroids(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floors of the members' means; a centroid without members stays."""
    k, dims = centroids.shape
    sums = table.select("cluster", "x").mapInArrow(member_sums(k, dims), "cluster int, place int, total long")
    total = np.zeros((k, dims + 1), np.int64)
    for row in sums.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():  # k x (dims + 1) rows at most
        total[row["cluster"], row["place"]] = row["total"]
    count = total[:, dims:]
    return np.where(count > 0, np.floor_divide(total[:, :dims], np.maximum(count, 1)), centroids)


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part."""
    spark = vectors.sparkSession
    folder = os.path.join(checkpoint_dir(spark), f"clusters-{uuid.uuid4().hex}")
    whole = whole_vectors(vectors, id_col, vector_col, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = whole.where("id IS NOT NULL").orderBy(order, "x").limit(clusters).select("x").collect()
    if not starts:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in starts], np.int64)
    step = whole.mapInArrow(first_products(centroids), _TABLE)
    for k in range(rounds + 1):
        path = os.path.join(folder, str(k))
        step.write.parquet(path)
        table = spark.read.schema(_TABLE).parquet(path)
        if k < rounds:
            after = moved_centroids(table, centroids)
            step = table.mapInArrow(changed_products(centroids, after), _TABLE)
            centroids = after

    inertia = [0] * len(centroids)
    for row in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect():  # a row a cluster
        inertia[row["cluster"]] = int(row["inertia"])
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return table.select(
        F.col("id").alias(id_col), "cluster", "distance", own(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), own(hashes).alias("centroid_sha256"),
    )
