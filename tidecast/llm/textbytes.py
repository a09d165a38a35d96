"""Words, hashes and blocks of texts as numpy arrays over the UTF-8 bytes of an Arrow column.

Texts are taken whole, a few megabytes of them at a time, so memory follows the longest single text and
not the batch. A null text counts as empty. Hashes are 64-bit polynomials over random byte values with a
final mixing step; they are the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: For work that keeps dozens of numbers a byte.
SMALL_BLOCK = 1 << 19

_BYTES = np.arange(256)
#: Bytes that separate words: space and \x09 to \x0D (fixed values).
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: A-Z to a-z, everything else unchanged.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

_random = np.random.Generator(np.random.PCG64(20240501))
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUE = _VALUE[LOWER]
_BASE = int(_random.integers(1, 2**62)) * 4 + 3
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base**0 ... base**(n-1)`` modulo 2**64, grown by doubling and kept."""
    known = _powers.get(base)
    if known is None:
        known = np.ones(1, dtype=np.uint64)
    while known.size < n:
        step = np.uint64(pow(base, known.size, 2**64))
        known = np.concatenate([known, known * step])
    if known.size <= 4 * BLOCK_BYTES:
        _powers[base] = known
    return known[:n]


def _return_memory() -> None:
    """Hand what this process no longer uses back to the machine."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` over the batches of a task, after which the worker keeps no memory for the next one.

    Workers outlive their tasks, and several of them share an executor with tasks of other kinds.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _return_memory()

    return whole


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that all of its bits depend on all of its input (a multiply-xorshift step)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_blocks(
    column: pa.Array, limit: int = BLOCK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows with about ``limit`` bytes.

    Yields ``(first row, row after the last, bytes, offsets)``; text ``i`` of the run is
    ``bytes[offsets[i]:offsets[i + 1]]``. A longer single text is a run by itself.
    """
    if len(column) == 0:
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(ends, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, everything[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` takes the hash of any span."""
    total = np.zeros(data.size + 1, dtype=np.uint64)
    values = (_LOWER_VALUE if lower else _VALUE)[data]
    values *= _power(_BASE, data.size)
    np.cumsum(values, out=total[1:])
    return total


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``[start, end)``; equal bytes give equal hashes wherever they lie."""
    spans = (prefix[ends] - prefix[starts]) * _power(_BASE_INVERSE, prefix.size)[starts]
    return mix(spans + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes, which never cross texts, and every text's first run."""
    if inside.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(offsets.size, np.int64)
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[filled[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for every text the index of its first word (and the total).

    ``apart`` tells for each byte whether it separates words.
    """
    return runs(~apart[data], offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (A-Z only), and every text's first index among them."""
    starts, ends, first = words(data, offsets)
    return span_hashes(prefix_hashes(data, lower=True), starts, ends), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words of a text, or of all its words if it has fewer."""
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(np.arange(counts.size), sizes)
    at = first[:-1][rows] + np.arange(rows.size) - ends[:-1][rows]
    length = np.minimum(counts, k)[rows]
    total = length.astype(np.uint64) * _ORDER[63]
    padded = np.concatenate([hashes, np.zeros(k, dtype=np.uint64)])
    for i in range(k):
        part = padded[at + i] * _ORDER[i]
        if length.size and length.min() <= i:
            part[length <= i] = 0
        total += part
    return mix(total), ends


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of every run, one run after the other."""
    ends = np.cumsum(sizes)
    if ends.size == 0 or ends[-1] == 0:
        return np.zeros(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
