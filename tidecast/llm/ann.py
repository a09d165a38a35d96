"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector, less a centre, is rotated at random and each component kept as its sign. With two numbers
per vector, its distance from the centre and the inner product of the direction with its own code, the
inner product with a query is estimated from the packed bits and a query of four bits per component. The
estimate comes with an error bound; vectors whose upper bound reaches the k-th best lower bound are scored
again on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.vectors import VECTOR_BLOCK, TopK, blobs, matrix, search, unblob, valid_vectors
from tidecast.session import stage

#: Rows that the centre is the mean of: those with the smallest hash of their id.
CENTRE_ROWS = 4096
#: Width of the error bound; wider means fewer misses and more vectors scored again.
BOUND = 2.5
#: Bits of a component of a query.
QUERY_BITS = 4
INDEX = "vec_id long, code binary, distance double, own double, centred double, vector binary"


def _rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    rows, size = bits.shape
    padded = np.zeros((rows, -(-size // 64) * 64), dtype=np.uint8)
    padded[:, :size] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def _units(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def nonzero_vectors(table: DataFrame) -> DataFrame:
    return valid_vectors(table).filter(F.exists("vector", lambda x: x != 0))


def centre(vectors: DataFrame) -> np.ndarray:
    """Mean of the unit vectors of at most ``CENTRE_ROWS`` rows."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_ROWS).select("vector").toArrow()
    rows = matrix(sample.column("vector"))
    return _units(rows).mean(axis=0) if rows.size else np.zeros(0)


def build_index(vectors: DataFrame, middle: np.ndarray) -> DataFrame:
    """One row per vector: its code and correction scalars, beside the vector itself."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = _rotation(middle.size)
        for batch in batches:
            rows = matrix(batch.column("vector"))
            if not rows.size:
                continue
            units = _units(rows)
            apart = units - middle
            distance = np.sqrt((apart * apart).sum(axis=1))
            turned = (apart / np.maximum(distance, 1e-300)[:, None]) @ rotation
            own = np.abs(turned).sum(axis=1) / np.sqrt(middle.size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    blobs(_packed(turned >= 0)),
                    pa.array(distance),
                    pa.array(np.maximum(own, 1e-9)),
                    pa.array(units @ middle),
                    blobs(rows),
                ],
                names=["vec_id", "code", "distance", "own", "centred", "vector"],
            )

    return vectors.mapInArrow(code, INDEX)


class _Queries:
    """A block of queries, rotated and quantised once per task."""

    def __init__(self, vectors: np.ndarray, middle: np.ndarray):
        self.units = _units(vectors)
        apart = self.units - middle
        self.distance = np.sqrt((apart * apart).sum(axis=1))
        turned = (apart / np.maximum(self.distance, 1e-300)[:, None]) @ _rotation(middle.size)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**QUERY_BITS - 1), 1e-12)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = levels.sum(axis=1, dtype=np.int64)
        self.planes = [_packed((levels >> bit) & 1) for bit in range(QUERY_BITS)]
        self.centred = self.units @ middle - middle @ middle

    def estimates(self, codes, distance, own, centred) -> tuple[np.ndarray, np.ndarray]:
        """Cosines (queries x vectors) and how far off they may be."""
        size = self.units.shape[1]
        both = np.zeros((self.total.size, codes.shape[0]), dtype=np.int64)
        for bit, plane in enumerate(self.planes):
            for word in range(codes.shape[1]):
                both += np.bitwise_count(plane[:, word, None] & codes[None, :, word]).astype(np.int64) << bit
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.int64)
        low, step = self.low[:, None], self.step[:, None]
        inner = (2 * both - self.total[:, None]) * step + (2 * ones[None, :] - size) * low
        scale = self.distance[:, None] * distance[None, :]
        cosine = scale * inner / (np.sqrt(size) * own[None, :])
        wide = np.sqrt(np.maximum(1 - own * own, 0.0)) / own / np.sqrt(max(size - 1, 1))
        wide = BOUND * wide[None, :] + step * np.sqrt(size) / (2 * np.sqrt(size) * own[None, :])
        return cosine + self.centred[:, None] + centred[None, :], scale * wide + 1e-9


def nearest(queries: DataFrame, table: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows of ``table(vec_id, embedding)`` of largest cosine with every row of ``queries``.

    Gives ``query_id, rank, vec_id, score``; ties go to the smaller ``vec_id``, and a row with the query's
    id is none of its candidates. Zero vectors and those that ``valid_vectors`` leaves out take no part; an
    empty table gives no row. Other columns are ignored.
    """
    vectors = nonzero_vectors(table)
    middle = centre(vectors)
    index = stage(build_index(vectors, middle))

    def scan(ids, rows, best: TopK, batches) -> None:
        asked = _Queries(rows, middle)
        own_norm = np.sqrt((rows * rows).sum(axis=1))
        for batch in batches:
            for first in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(first, VECTOR_BLOCK)
                vec_ids = part.column("vec_id").to_numpy()
                stored = unblob(part.column("vector"), np.float64)
                scalars = [part.column(c).to_numpy() for c in ("distance", "own", "centred")]
                cosine, wide = asked.estimates(unblob(part.column("code"), np.uint64), *scalars)
                other = ids[:, None] != vec_ids[None, :]
                floor = best.threshold
                if vec_ids.size > k:
                    low = np.where(other, cosine - wide, -np.inf)
                    floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
                kept = other & (cosine + wide >= floor[:, None])
                norms = np.sqrt((stored * stored).sum(axis=1))
                for query in np.flatnonzero(kept.any(axis=1)):
                    some = np.flatnonzero(kept[query])
                    exact = stored[some] @ rows[query] / (norms[some] * own_norm[query])
                    best.add(query, exact, vec_ids[some])

    return search(nonzero_vectors(queries), index, k, "double", scan)
