"""Exact top-k by inner product: vectors grouped by length, pruned by local cosine thresholds.

The index is ordered by vector length and read in buckets, longest first. With the k-th best score so far,
a query needs a certain cosine in a bucket, the threshold over its own length times the longest one of the
bucket. Above one the bucket is skipped. A low cosine leaves only the length to prune by; a high one bounds
the vector's largest coordinates of the query, and vectors outside these bounds are dropped. What is left
is multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.vectors import TopK, blobs, matrix, search, unblob, valid_vectors
from tidecast.session import stage

#: Vectors of a bucket.
BUCKET = 512
#: From this cosine on, coordinates prune; below it, only lengths.
COORDINATE_FROM = 0.3
#: Coordinates of a query that are compared with their bounds.
FOCUS = 3
#: Below this product of lengths a double holds every partial sum exactly.
EXACT = 2.0**52


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``vector``: every component times ``scale``, rounded down."""
    return valid_vectors(table).withColumn(
        "vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    )


def build_index(vectors: DataFrame) -> DataFrame:
    """Vectors with their lengths, spread over partitions by length, the longest first in each."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vector"))
            if rows.size:
                columns = [batch.column("vec_id"), pa.array(np.sqrt((rows * rows).sum(axis=1))), blobs(rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "length", "vector"])

    spread = vectors.mapInArrow(lengths, "vec_id long, length double, vector binary")
    spread = spread.repartitionByRange(F.desc("length"), F.xxhash64("vec_id"))
    return spread.sortWithinPartitions(F.desc("length"), "vec_id")


def _multiply(rows: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    if bound < EXACT:
        return (rows @ query).astype(np.int64)
    return rows.astype(np.int64) @ query.astype(np.int64)


def _inside(units: np.ndarray, query: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors can have at least this cosine with the query, by its largest coordinates."""
    kept = np.ones(units.shape[0], dtype=bool)
    for f in np.argsort(-np.abs(query), kind="stable")[:FOCUS]:
        spread = np.sqrt(max(0.0, 1 - query[f] ** 2) * max(0.0, 1 - cosine**2)) + 1e-9
        # The cosine may lie anywhere in [cosine, 1]: beyond the query's own coordinate the bound is free.
        lowest = query[f] * cosine - spread if query[f] > -cosine else -1.0
        highest = query[f] * cosine + spread if query[f] < cosine else 1.0
        kept &= (units[:, f] >= lowest) & (units[:, f] <= highest)
    return kept


def largest_products(queries: DataFrame, table: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` rows of ``table(vec_id, embedding)`` with the largest inner product, for every query row.

    Both sides are turned into integers by ``integer_vectors``. Gives ``query_id, rank, vec_id, score``;
    ties go to the smaller ``vec_id``, and a row with the query's id is none of its candidates. Rows that
    ``valid_vectors`` leaves out take no part; zero vectors do. Products beyond 64 bits are not supported.
    An empty table gives no row. Other columns are ignored.
    """
    index = stage(build_index(integer_vectors(table, scale)))

    def scan(ids, rows, best: TopK, batches) -> None:
        own = np.sqrt((rows * rows).sum(axis=1))
        directions = rows / np.maximum(own, 1e-300)[:, None]
        for batch in batches:
            for first in range(0, batch.num_rows, BUCKET):
                bucket = batch.slice(first, BUCKET)
                vec_ids = bucket.column("vec_id").to_numpy()
                length = bucket.column("length").to_numpy()
                stored = unblob(bucket.column("vector"), np.float64)
                units = stored / np.maximum(length, 1e-300)[:, None]
                longest = length.max()
                for q in range(ids.size):
                    floor, reach = best.threshold[q], own[q] * longest
                    other = vec_ids != ids[q]
                    if floor > 0 and reach > 0:
                        cosine = (floor - 0.5) / reach
                        if cosine > 1:
                            continue
                        if cosine >= COORDINATE_FROM:
                            other &= _inside(units, directions[q], cosine)
                        else:
                            other &= length * own[q] >= floor - 0.5
                    some = np.flatnonzero(other)
                    if some.size:
                        scores = _multiply(stored[some], rows[q], reach)
                        reached = scores >= floor
                        if reached.any():
                            best.add(q, scores[reached], vec_ids[some][reached])

    return search(integer_vectors(queries, scale), index, k, "long", scan)
