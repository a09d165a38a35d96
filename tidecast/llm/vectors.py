"""What the vector searches share: valid vectors, query blocks, and the ranking of what the blocks found."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.session import scratch_path

#: Queries that go to the executors at once; their vectors pass through the driver block by block.
QUERY_BLOCK = 1024
#: Vectors that a task scores against a block of queries at once.
VECTOR_BLOCK = 2048
FOUND = "query_id long, vec_id long, score {kind}"


def valid_vectors(table: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` as doubles, without rows that can take no part.

    These are rows with a null id, a null vector, null or non-finite components, no component, or another
    number of components than most rows have (the larger number on a tie).
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return rows.filter(F.size("vector") == (sizes["n"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blobs(rows: np.ndarray) -> pa.Array:
    """One binary value per row."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(rows)], pa.binary())


def unblob(column: pa.Array, kind: type) -> np.ndarray:
    return np.array([np.frombuffer(x, dtype=kind) for x in column.to_pylist()])


class TopK:
    """The best ``k`` of what a task has seen, for every query: larger score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        self.threshold = np.full(queries, -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[query].astype(scores.dtype), scores])
        ids = np.concatenate([self.ids[query], ids])
        best = np.lexsort((ids, -scores))
        _, distinct = np.unique(ids[best], return_index=True)
        best = best[np.sort(distinct)[: self.k]]
        self.scores[query], self.ids[query] = scores[best], ids[best]
        if best.size == self.k:
            self.threshold[query] = self.scores[query][-1]

    def batch(self, query_ids: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        sizes = [ids.size for ids in self.ids]
        columns = [
            pa.array(np.repeat(query_ids, sizes), pa.int64()),
            pa.array(np.concatenate(self.ids), pa.int64()),
            pa.array(np.concatenate(self.scores), kind),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def search(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    kind: str,
    scan: Callable[[np.ndarray, np.ndarray, TopK, Iterator[pa.RecordBatch]], None],
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` rows of ``index`` for every row of ``queries``.

    ``scan(query ids, query vectors, best, batches)`` reads the batches of one partition of the index into
    ``best``. Queries go out in blocks that are cut by a hash of their id, every block against the whole
    index, and what a block found is written before the next one starts. A task returns at most ``k`` rows
    for a query. Rows that share an id count as one candidate, the better one; a query repeated with
    different vectors takes each candidate's best score.
    """
    spark = queries.sparkSession
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    path = scratch_path(spark, "found")
    arrow = {"long": pa.int64(), "double": pa.float64()}[kind]
    schema = FOUND.format(kind=kind)
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(path)
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast(
            (rows.column("vec_id").to_numpy(), matrix(rows.column("vector")))
        )

        def run(batches, sent=sent):
            ids, vectors = sent.value
            best = TopK(ids.size, k)
            scan(ids, vectors, best, batches)
            yield best.batch(ids, arrow)

        index.mapInArrow(run, schema).write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


