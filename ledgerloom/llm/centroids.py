"""Centroid clustering in integers, with Hamerly's bounds.

Each vector carries its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to
every other one. When centroids move, the upper bound grows by its centroid's drift and the lower bound shrinks by the
largest drift of the others. While the upper bound stays under the lower one, or under half the distance from its
centroid to the nearest other, the vector cannot have moved and is not looked at. A vector for which that fails, even
with its upper bound made exact, is ambiguous: it is held against all centroids in integers, which decides ties too.

A round is one pass of narrow tasks, written in the folder that all executors share: vectors with their bounds, and the
changes to the sums of clusters, a row for each cluster and task. Those are summed by cluster on the executors; 40
centroids are all that comes to the driver and goes back. Sums are kept up by what changed, so vectors never shuffle.

Bounds are doubles, and comparisons leave SLACK of room for rounding, so no vector is skipped that an exact scan would
move. Everything that is returned is exact.

Defined results: vectors that are null, have another number of components, or one that is null or not finite, are left
out; so are those with a component beyond MOST / 256 in size, whose distances 64 bits might not hold. Repeated rows count
each. A null vec_id is clustered, but only starts a centroid after all others; rows of the same vec_id do so in the order
of their components. With fewer vectors than centroids there are as many centroids as vectors. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components are integers of x * SCALE, up to MOST in size: distances of 64 of them then fit 64 bits.
SCALE, MOST = 256, 1 << 27
#: Share and amount by which a bound must be under another to count as under it.
SLACK, LEAST = 1e-9, 1e-6
_STATE = "vec_id long, vector array<int>, cluster int, upper double, lower double, changes array<long>"
_NAMES = ["vec_id", "vector", "cluster", "upper", "lower", "changes"]


def integers(rows: DataFrame, dims: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the vectors that are kept."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST / SCALE))
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & fine)
    return kept.select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("vector"))


def seeds(vectors: DataFrame, k: int, seed: str = "2") -> np.ndarray:
    """The k vectors of smallest hash of seed and vec_id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(order.alias("order"), "vector").orderBy(F.col("order").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def scan(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The squared distances of each vector to each centroid, in integers."""
    return (vectors**2).sum(axis=1)[:, None] - 2 * (vectors @ centroids.T) + (centroids**2).sum(axis=1)[None]


def under(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return one * (1 + SLACK) + LEAST < other


def placed(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) by a full scan."""
    apart = scan(vectors, centroids)
    cluster = apart.argmin(axis=1)  # the first of equals
    every = np.arange(len(vectors))
    upper = np.sqrt(apart[every, cluster].astype(float))
    if len(centroids) == 1:
        return cluster, upper, np.full(len(vectors), np.inf)
    apart[every, cluster] = np.iinfo(np.int64).max
    return cluster, upper, np.sqrt(apart.min(axis=1).astype(float))


class Moved:
    """Centroids, how far each has moved, and half its distance to the nearest other."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        self.drift = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        self.others = np.zeros(k)  # the largest drift of the others
        self.half = np.full(k, np.inf)
        if k > 1:
            two = np.argsort(self.drift)[-2:]
            self.others[:] = self.drift[two[1]]
            self.others[two[1]] = self.drift[two[0]]
            apart = scan(centroids, centroids)
            np.fill_diagonal(apart, np.iinfo(np.int64).max)
            self.half = np.sqrt(apart.min(axis=1).astype(float)) / 2

    def step(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower) after the move, and how many vectors took a full scan."""
        upper, lower = upper + self.drift[cluster], np.maximum(lower - self.others[cluster], 0)
        bound = np.maximum(lower, self.half[cluster])
        doubt = np.flatnonzero(~under(upper, bound))
        near = vectors[doubt] - self.centroids[cluster[doubt]]
        upper[doubt] = np.sqrt((near**2).sum(axis=1).astype(float))
        doubt = doubt[~under(upper[doubt], bound[doubt])]
        cluster = cluster.copy()
        if len(doubt):
            cluster[doubt], upper[doubt], lower[doubt] = placed(vectors[doubt], self.centroids)
        return cluster, upper, lower, len(doubt)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch["vector"].flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)


def assigned(state: DataFrame, moved: Moved, first: bool) -> DataFrame:
    """The state after a round's assignment. Rows without a vector have a cluster's changes that a task saw: its number
    of vectors, then their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = moved.centroids.shape
        changes = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            if first:
                cluster, upper, lower = placed(x, moved.centroids)
                gained, lost = np.arange(len(x)), np.arange(0)
                before = cluster
            else:
                before, upper, lower = (batch[c].to_numpy() for c in ("cluster", "upper", "lower"))
                cluster, upper, lower, _ = moved.step(x, before, upper, lower)
                gained = lost = np.flatnonzero(cluster != before)
            np.add.at(changes[:, 1:], cluster[gained], x[gained])
            np.add.at(changes[:, 0], cluster[gained], 1)
            np.subtract.at(changes[:, 1:], before[lost], x[lost])
            np.subtract.at(changes[:, 0], before[lost], 1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vector"], pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.nulls(len(x), pa.list_(pa.int64()))], _NAMES)
        some = np.flatnonzero(changes.any(axis=1))
        if len(some):
            none = [pa.nulls(len(some), kind) for kind in (pa.int64(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), *[pa.nulls(len(some), pa.float64())] * 2, pa.array(changes[some].tolist(), pa.list_(pa.int64()))], _NAMES)

    return state.mapInArrow(run, _STATE)


def summed(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """The changes of all tasks: a row of count and sums for each cluster."""
    parts = state.where("changes is not null").select("cluster", F.posexplode("changes").alias("at", "n"))
    out = np.zeros((k, dims + 1), dtype=object)
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38)")).cast("string").alias("n")).collect():
        out[r["cluster"], r["at"]] = int(r["n"])
    return out


def clusters(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept."""
    vectors = stored(integers(rows, dims, vec_id, embedding))
    centroids = seeds(vectors, k)
    if not len(centroids):
        return vectors.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    state, moved, totals = vectors, Moved(centroids), 0
    for n in range(rounds + 1):
        state = stored(assigned(state if n == 0 else state.where("vector is not null"), moved, n == 0))
        if n < rounds:
            totals = totals + summed(state, *centroids.shape)
            after = np.array([[total // row[0] for total in row[1:]] if row[0] else old.tolist() for row, old in zip(totals, centroids, strict=True)], dtype=np.int64)
            moved, centroids = Moved(after, centroids), after
    final = [(i, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = rows.sparkSession.createDataFrame(final, "cluster int, centroid array<int>, centroid_sha256 string")
    told = state.where("vector is not null").join(F.broadcast(named), "cluster").withColumn("distance", _squared(F.col("vector"), F.col("centroid")))
    by_cluster = told.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    small = by_cluster.crossJoin(F.broadcast(inertia))  # one row for each centroid
    return told.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _squared(one: Column, other: Column) -> Column:
    apart = F.zip_with(one, other, lambda x, y: x.cast("long") - y.cast("long"))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda total, x: total + x * x)
