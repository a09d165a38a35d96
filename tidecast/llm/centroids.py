"""Centroid clustering in integers, with the threshold algorithm for the nearest centroid.

Every component has a list of the centroids in the order of their values there. A vector walks each list
outward from its own value and meets, step by step, the next nearest centroid of every component. A centroid
that is met for the first time is compared in full. The frontier of a component is the distance that its
walk has reached; a centroid that no walk has met lies at least that far away in every component. So the walk
ends when the squared frontiers add up to strictly more than the best distance found: not even a tie can be
missing then.

The centroids and their lists, a few thousand numbers, go to the executors each round. Vectors stay where
they are: a task returns the sums and counts of its clusters, and the vectors are read once a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.vectors import matrix
from tidecast.session import stage

CENTROIDS, ROUNDS, COMPONENTS, SCALE = 40, 5, 64, 256
#: Components beyond this, after scaling, have no squared distance that fits a long.
LARGEST = 1 << 27
#: Vectors that walk side by side.
WALKERS = 512


class Lists:
    """The centroids with a sorted list for every component."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        count, width = centroids.shape
        #: Numbers and values by component; the ends of the values stand for an exhausted side.
        self.number = np.argsort(centroids, axis=0, kind="stable").T
        self.value = np.take_along_axis(centroids.T, self.number, axis=1)
        self.component = np.arange(width)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every vector, the smaller number on a tie, and its squared distance."""
        found = [self._walk(vectors[i : i + WALKERS]) for i in range(0, len(vectors), WALKERS)]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *column]) for column in zip(*found)) if found else (none, none)

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = len(self.centroids)
        # right is the first centroid whose value is not below the vector's, left the one before it.
        right = np.stack([np.searchsorted(v, x) for v, x in zip(self.value, vectors.T)], axis=1)
        left = right - 1
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        number = np.full(len(vectors), count, dtype=np.int64)
        met = np.zeros((len(vectors), count), dtype=bool)
        open_ = np.arange(len(vectors))
        while open_.size:
            x, at_left, at_right = vectors[open_], left[open_], right[open_]
            below = np.where(at_left >= 0, x - self.value[self.component, np.maximum(at_left, 0)], LARGEST * 4)
            above = np.where(at_right < count, self.value[self.component, np.minimum(at_right, count - 1)] - x, LARGEST * 4)
            down = below <= above
            frontier = np.where(down, below, above)
            place = np.where(down, at_left, np.minimum(at_right, count - 1))
            left[open_] -= down
            right[open_] += ~down
            fresh = np.zeros((open_.size, count), dtype=bool)
            np.put_along_axis(fresh, self.number[self.component, place], True, axis=1)
            fresh &= ~met[open_]
            met[open_] |= fresh
            who, which = np.nonzero(fresh)
            apart = x[who] - self.centroids[which]
            distance = np.einsum("ij,ij->i", apart, apart)
            order = np.lexsort((which, distance, who))
            who, which, distance = who[order], which[order], distance[order]
            first = np.ones(who.size, dtype=bool)
            first[1:] = who[1:] != who[:-1]
            who, which, distance = open_[who[first]], which[first], distance[first]
            better = (distance < best[who]) | ((distance == best[who]) & (which < number[who]))
            best[who[better]], number[who[better]] = distance[better], which[better]
            # All centroids met, or no centroid that is still unmet can be as near as the best one.
            done = met[open_].all(axis=1) | (np.einsum("ij,ij->i", frontier, frontier) > best[open_])
            open_ = open_[~done]
        return number, best


def scaled_vectors(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: the components as integers ``floor(scale * x)`` of the vectors that take part."""
    x = F.col("vector")
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    large = LARGEST / scale
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= -large) & (v < large))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size(x) == components) & fits)
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v * float(scale))).alias("vector"))


def first_centroids(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors with the ``count`` smallest SHA-256 of ``<seed>:<vec_id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key, "vector").limit(count).toArrow()
    return matrix(rows.column("vector")).astype(np.int64)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors; empty ones stay."""
    sent = vectors.sparkSession.sparkContext.broadcast(Lists(centroids))
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centroids.shape, dtype=np.int64)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0)).astype(np.int64)
            number, _ = sent.value.nearest(x)
            order = np.argsort(number, kind="stable")
            begin = np.flatnonzero(np.diff(number[order], prepend=-1))
            if order.size:
                sums[number[order][begin]] += np.add.reduceat(x[order], begin, axis=0)
            counts += np.bincount(number, minlength=len(centroids))
        cluster = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(cluster, width)),
                pa.array(np.tile(np.arange(width), cluster.size)),
                pa.array(np.repeat(counts[cluster], width)),
                pa.array(sums[cluster].ravel()),
            ],
            names=["cluster", "component", "n", "total"],
        )

    parts = vectors.select("vector").mapInArrow(run, "cluster long, component long, n long, total long")
    # As many rows as there are centroids times components; sums as decimals, which do not overflow.
    whole = parts.groupBy("cluster", "component").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(19,0)")).alias("total")
    )
    moved = centroids.copy()
    for row in whole.collect():
        moved[row.cluster, row.component] = int(row.total) // row.n
    sent.unpersist()
    return moved


def cluster_vectors(
    table: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = 2,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``table(vec_id, embedding)``.

    Vectors become integers ``floor(scale * x)``. The first centroids are the vectors with the smallest hash
    of ``<seed>:<vec_id>``; fewer vectors than ``centroids`` are all centroids. Each round assigns all vectors
    to the nearest centroid by squared distance, the smaller number on a tie, and moves the centroids to the
    floor of their vectors' mean; an empty one stays. The last assignment follows the last move.

    A row takes no part if its id is null or its vector is null, of another length, or holds a null,
    not-a-number, infinite or very large component (from 2^27 after scaling, as squared distances must fit a
    long). Rows that repeat an id are vectors of their own; if they are among the first centroids, the smaller
    vector comes first. A sum of distances beyond a long is null. An empty table gives no row; other columns are
    ignored.
    """
    vectors = stage(scaled_vectors(table, components, scale))
    spark = table.sparkSession
    at = first_centroids(vectors, centroids, seed)
    if not len(at):
        at = np.zeros((1, components), dtype=np.int64)  # no vector will meet it
    for _ in range(rounds):
        at = _moved(vectors, at)
    sent = spark.sparkContext.broadcast(Lists(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = sent.value.nearest(matrix(batch.column(1)).astype(np.int64))
            columns = [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    found = stage(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in at.tolist()]
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    distance = F.col("distance").cast("decimal(38,0)")
    per_cluster = found.groupBy("cluster").agg(F.sum(distance).alias("part"))
    everything = F.sum("part").over(Window.partitionBy(F.lit(0)))  # one row per centroid
    sums = per_cluster.withColumn("whole", everything).join(named, "cluster").select(
        "cluster",
        F.expr("try_cast(part as long)").alias("cluster_inertia"),
        F.expr("try_cast(whole as long)").alias("inertia"),
        "centroid_sha256",
    )
    # As many rows as there are centroids.
    return found.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
