"""Centroid clustering of whole-number vectors by Exponion search.

Each vector keeps its centroid, a distance that it has at most to it (upper) and one that it has at least to all others (lower).
When centroids move, the bounds move with them. A vector whose upper bound is below its lower one, or below half the way from its
centroid to the nearest other one, stays without a look at any other centroid. The rest scan only the centroids in a ball around
their own: with the distance u to it and the distance e from it to its nearest neighbour, every centroid that is nearest or second
nearest lies within 2 u + e of it, the edge included, so that ties are seen. Each centroid has a list of the others by their distance,
and a vector scans a beginning of its centroid's list.

One pass over the vectors makes a round: a task writes its vectors with their new bounds and, behind them, the sums of its clusters, so
that a repeated task repeats both. The driver gets the sums of each cluster, whose number and size are parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import drop_written, written
from wardline.llm.tiles import whole_numbers

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64.0, 1
#: Components of this size or more would take squared distances out of a long.
MOST = 1 << 27
#: What float64 roots of whole numbers may be off by, relative and absolute.
SLACK = 1e-9
_STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, distance long, sums array<long>"
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers, each to each."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x.astype(np.int64) - c
    return (gap * gap).sum(axis=1)


def two_nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of some centroids (ties: the smallest number), the squared distance to it, and that to the second (or a negative number)."""
    among = np.sort(among)
    d = squared(x, centroids[among])
    at = d.argmin(axis=1)
    rows = np.arange(len(x))
    first = d[rows, at]
    if len(among) == 1:
        return among[at], first, np.full(len(x), -1)
    d[rows, at] = np.iinfo(np.int64).max
    return among[at], first, d.min(axis=1)


class Ball:
    """What a round's centroids say before any vector is seen: the others of each by distance, and half the way to the nearest."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        apart = np.sqrt(squared(centroids, centroids).astype(float))
        np.fill_diagonal(apart, -1.0)  # a centroid stands first in its own list
        self.order = apart.argsort(axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.apart[:, 0] = 0.0
        self.next = self.apart[:, 1] if k > 1 else np.full(k, np.inf)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """New (cluster, upper, lower, squared distance) of vectors with bounds that hold, and how many distances to other centroids were taken."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        exact = own_squared(x, self.centroids[cluster])
        safe = np.maximum(lower, self.next[cluster] / 2)
        open_ = np.flatnonzero(upper * (1 + SLACK) + SLACK >= safe * (1 - SLACK))
        upper[open_] = np.sqrt(exact[open_].astype(float))
        open_ = open_[upper[open_] * (1 + SLACK) + SLACK >= safe[open_] * (1 - SLACK)]
        radius = (2 * upper[open_] + self.next[cluster[open_]]) * (1 + SLACK) + SLACK
        taken = 0
        for c in np.unique(cluster[open_]):
            mine = cluster[open_] == c
            rows, reach = open_[mine], np.searchsorted(self.apart[c], radius[mine], side="right")
            # lists are scanned up to the next power of two, so that rows with balls of like size go together
            steps = np.ceil(np.log2(np.maximum(reach, 2))).astype(int)
            for s in np.unique(steps):
                these, among = rows[steps == s], self.order[c][: 1 << s]
                near, first, second = two_nearest(x[these], self.centroids, among)
                cluster[these], exact[these] = near, first
                upper[these] = np.sqrt(first.astype(float))
                lower[these] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(float)))
                taken += len(these) * len(among)
        return cluster, upper, lower, exact, taken


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid went, and for each the farthest that another one went."""
    far = np.sqrt(own_squared(new, old).astype(float))
    if len(far) == 1:
        return far, np.zeros(1)
    top = far.argsort()[::-1]
    others = np.full(len(far), far[top[0]])
    others[top[0]] = far[top[1]]
    return far, others


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly dim components without null or non-finite ones; each component x becomes floor(scale * x). The
    first centroids are the k vectors with the least sha256 of "seed:vec_id"; rows that repeat an id follow each other in the order of
    their components, and rows without an id come last. With fewer than k vectors there are as many clusters as vectors. Each round
    assigns every vector to the nearest centroid (ties: the smaller number; equal centroids leave all to the first) and moves every
    centroid that has vectors to the floor of their mean; one more assignment follows. Repeated rows count each. Components of 2^27 or
    more after scaling are an error: squared distances would not fit a long. Other columns play no part, whatever their names. An empty
    table, or one without kept vectors, gives no rows.
    """
    spark = vectors.sparkSession

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch.column(1), scale):
                if x.shape[1] == dim:
                    if np.abs(x).max() >= MOST:
                        raise ValueError(f"components of {MOST} or more after scaling")
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], names=["vec_id", "x"])

    source = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    state = written(source.mapInArrow(keep, "vec_id long, x array<int>"), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = state.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    if not start:
        drop_written(state)
        return spark.createDataFrame([], _RESULT)
    centroids = np.array([r["x"] for r in start], np.int64)
    k, before = len(centroids), None

    for left in range(rounds, -1, -1):
        new = written(state.mapInArrow(_round(centroids, before), _STATE), "clusters")
        drop_written(state)
        state = new
        sums = state.where("sums is not null").select("cluster", F.posexplode("sums").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("v"))
        total = np.zeros((k, dim + 2), np.int64)  # count, inertia, components
        for r in sums.collect():  # as many rows as clusters have numbers
            total[r["cluster"], r["i"]] = r["v"]
        if left:
            some = total[:, 0] > 0
            before, centroids = centroids, centroids.copy()
            centroids[some] = total[some, 2:] // total[some, :1]
    inertia = sum(map(int, total[:, 1]))
    facts = [(j, int(total[j, 1]), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    rows = state.where("sums is null").select("vec_id", "cluster", "distance")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(centroids: np.ndarray, before: np.ndarray | None):
    """A pass over the vectors: from nothing where before is None, else from the bounds that held for the centroids before."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball, sums = Ball(centroids), np.zeros((k, dim + 2), np.int64)
        for batch in batches:
            if before is not None:
                batch = batch.filter(batch.column(6).is_null())
            if not len(batch):
                continue
            x = _matrix(batch.column(1), dim)
            if before is None:
                near, d, second = two_nearest(x, centroids, np.arange(k))
                upper, lower = np.sqrt(d.astype(float)), np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(float)))
            else:
                near, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                far, others = moved(before, centroids)
                near, upper, lower, d, _ = ball.assign(x, near, upper + far[near], np.maximum(lower - others[near], 0.0))
            for c in np.unique(near):
                mine = near == c
                sums[c] += np.concatenate([[mine.sum(), d[mine].sum()], x[mine].sum(axis=0, dtype=np.int64)])
            arrays = [batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(upper), pa.array(lower), pa.array(d, pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "x", "cluster", "upper", "lower", "distance", "sums"])
        used = np.flatnonzero(sums[:, 0])
        if len(used):
            n = len(used)
            arrays = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(used, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "x", "cluster", "upper", "lower", "distance", "sums"])

    return run
