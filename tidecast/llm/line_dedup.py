"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``tau`` edits have, if the shorter one is cut into ``tau + 1`` segments, at least one
segment whole in the longer one, near its own place. Every distinct line indexes its segments under its
length and probes, for every length it may meet, the substrings that can align with a segment. Candidates
are verified with a banded bit-parallel edit distance. Edits are of UTF-8 bytes. Before that, the parities
of hashed byte pairs are compared: an edit changes at most four, so near lines differ in few bits, and
variants of one line with different words in many.

A line of a document goes if the same or a near line stands earlier, by document id and then by place.
That is judged on the input, whether or not the earlier line itself goes. Equal lines are one node of the
join. A node is first compared with the earliest line that it meets, and only if none of these is near with
all the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.meeting import INDEX, MEETING, PROBE, fresh_name, meeting_batch, met_rows, node_ids, split_by_keys, with_keys
from tidecast.llm.textbytes import SMALL_BLOCK, frugal, mix, prefix_hashes, span_hashes, text_blocks
from tidecast.session import stage

#: Most edits between near lines.
TAU = 2
#: Shorter lines, in bytes, are left alone: headings, list marks and the like repeat rightly.
MIN_BYTES = 24
#: Pairs that are verified side by side, and columns after which finished ones are put aside.
PAIRS, COLUMNS = 4096, 32


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines of a block of texts, and the text of each; no text has no line."""
    filled = np.flatnonzero(offsets[:-1] < offsets[1:])
    breaks = np.flatnonzero(data == 0x0A)
    ends = np.concatenate([breaks, offsets[1:][filled]])
    starts = np.concatenate([breaks + 1, offsets[:-1][filled]])
    # A break is the end of a line and the start of the next one of the same text.
    starts, ends = np.sort(starts), np.sort(ends)
    text = np.repeat(filled, np.diff(np.searchsorted(breaks, np.append(offsets[:-1][filled], data.size))) + 1)
    return starts, ends, text


def _parities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each line 64 parities of its hashed pairs of neighbouring bytes; lines have two bytes or more."""
    if not starts.size:
        return np.zeros(0, np.int64)
    pairs = data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]
    bits = np.uint64(1) << (mix(pairs + np.uint64(1)) & np.uint64(63))
    # Every second run is a line's pairs, the others are what lies between.
    edges = np.stack([starts, np.minimum(ends - 1, bits.size - 1)], axis=1).ravel()
    found = np.bitwise_xor.reduceat(bits, edges)[::2]
    whole = ends - 1 == bits.size  # the last pair of the block belongs to the last line
    return np.where(whole, found ^ bits[-1], found).view(np.int64)


def line_table(documents: DataFrame, min_bytes: int) -> DataFrame:
    """``doc_id, line_no, line, parity, n_bytes``: every line's place, hash, parities and length.

    Hash and parities are null for lines that are too short to take part.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_blocks(batch.column(1), SMALL_BLOCK):
                starts, ends, text = _lines(data, offsets)
                number = np.arange(text.size) - np.searchsorted(text, text)
                short = ends - starts < min_bytes
                hashes = node_ids(span_hashes(prefix_hashes(data), starts, ends))
                parity = np.zeros(short.size, dtype=np.int64)
                parity[~short] = _parities(data, starts[~short], ends[~short])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + text)),
                        pa.array(number, pa.int64()),
                        pa.array(hashes, mask=short),
                        pa.array(parity, mask=short),
                        pa.array(ends - starts),
                    ],
                    names=["doc_id", "line_no", "line", "parity", "n_bytes"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, line_no long, line long, parity long, n_bytes long")


def _signatures(data: np.ndarray, offsets: np.ndarray, tau: int, min_bytes: int) -> tuple:
    starts, ends, _ = _lines(data, offsets)
    long = ends - starts >= min_bytes
    starts, ends = starts[long], ends[long]
    prefix = prefix_hashes(data)
    node = node_ids(span_hashes(prefix, starts, ends))
    _, once = np.unique(node, return_index=True)
    starts, size, node = starts[once], (ends - starts)[once], node[once]
    found = []

    def add(which, length, segment, at, width, role):
        begin = starts[which] + at
        salt = mix(length.astype(np.uint64) * np.uint64(tau + 2) + np.uint64(segment + 1))
        found.append((mix(span_hashes(prefix, begin, begin + width) + salt), node[which], np.full(begin.size, role)))

    for shorter in range(tau + 1):
        length = size - shorter
        for segment in range(tau + 1):
            # Even segments, the longer ones last.
            base, extra = length // (tau + 1), length % (tau + 1)
            width = base + (segment >= tau + 1 - extra)
            place = segment * base + np.maximum(0, segment - (tau + 1 - extra))
            # The segment may have moved by the edits left of it, and what is right of it must still fit.
            for move in range(-tau, tau + 1):
                at = place + move
                allowed = (abs(move) <= segment) and abs(move - shorter) <= tau - segment
                which = np.flatnonzero((length >= max(1, min_bytes)) & (width > 0) & (at >= 0) & (at + width <= size))
                if not allowed or not which.size:
                    continue
                role = PROBE | (INDEX if shorter == 0 and move == 0 else 0)
                add(which, length[which], segment, at[which], width[which], role)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(column) for column in zip(*found))


def signatures(documents: DataFrame, tau: int, min_bytes: int) -> DataFrame:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0), SMALL_BLOCK):
                yield meeting_batch(*_signatures(data, offsets, tau, min_bytes))

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, MEETING)


def within(left: list[bytes], right: list[bytes], tau: int) -> np.ndarray:
    """Whether the pairs are within ``tau`` edits.

    Column ``j`` of a pair keeps a word per number of errors; its bit ``b`` says that the first
    ``j + b - tau`` bytes of the left line become the first ``j`` of the right one with so many errors.
    All pairs advance together; a pair whose words are empty is done.
    """
    width = 2 * tau + 1
    result = np.zeros(len(left), dtype=bool)
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right)], dtype=np.int64).reshape(-1, 2)
    near = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= tau)
    near = near[np.argsort(sizes[near, 1], kind="stable")]
    if not near.size:
        return result
    # All lines in one array, the left ones padded by tau bytes on either side that are never equal.
    pad = np.full(tau, 256, dtype=np.int16)
    flat, left_at, right_at, at = [], [], [], 0
    for i in near.tolist():
        a, b = (np.frombuffer(x, dtype=np.uint8).astype(np.int16) for x in (left[i], right[i]))
        flat += [pad, a, pad, b]
        left_at.append(at)
        right_at.append(at + a.size + 2 * tau)
        at += a.size + b.size + 2 * tau
    flat = np.concatenate([*flat, pad, pad, pad])
    left_at, right_at = np.array(left_at), np.array(right_at)
    m, n = sizes[near, 0], sizes[near, 1]
    full = (1 << width) - 1
    errors = [np.full(near.size, ((1 << (d + 1)) - 1) << tau, dtype=np.int32) for d in range(tau + 1)]
    open_ = np.arange(near.size)
    longest = int(n.max())
    for j in range(longest + 1):
        ended = n[open_] == j
        if j % COLUMNS == 0 or ended.any():
            last = open_[ended]
            if last.size:
                bit = m[last] - j + tau
                result[near[last]] = (errors[tau][ended] >> bit) & 1 == 1
            alive = ~ended & (errors[tau] != 0)
            open_, errors = open_[alive], [e[alive] for e in errors]
            if not open_.size:
                break
        byte = flat[right_at[open_] + j]
        equal = np.zeros(open_.size, dtype=np.int32)
        inside = np.zeros(open_.size, dtype=np.int32)
        for b in range(width):
            i = j + 1 + b - tau  # bytes of the left line that this bit has used
            equal |= (flat[left_at[open_] + j + b] == byte).astype(np.int32) << b
            inside |= ((i >= 0) & (i <= m[open_])).astype(np.int32) << b
        now = []
        for d in range(tau + 1):
            word = errors[d] & equal
            if d:
                word |= errors[d - 1] | (errors[d - 1] >> 1) | (now[d - 1] << 1)
            now.append(word & inside & full)
        errors = now
    return result


def _verified(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, PAIRS):
            part = batch.slice(first, PAIRS)
            near = within(part.column(2).to_pylist(), part.column(3).to_pylist(), tau)
            yield part.select([0]).filter(pa.array(near))


def _line_bytes(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, bytes`` of the wanted line hashes."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_blocks(batch.column(1), SMALL_BLOCK):
                starts, ends, text = _lines(data, offsets)
                number = np.arange(text.size) - np.searchsorted(text, text)
                asked = batch.column(2).take(pa.array(np.arange(first, first + offsets.size - 1)))
                lists = asked.to_pylist()
                pick = np.array(
                    [k for k, (t, i) in enumerate(zip(text.tolist(), number.tolist())) if i in lists[t]], dtype=np.int64
                )
                raw = data.tobytes()
                hashes = node_ids(span_hashes(prefix_hashes(data), starts[pick], ends[pick]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array([raw[a:b] for a, b in zip(starts[pick], ends[pick])], pa.binary())],
                    names=["line", "bytes"],
                )

    places = wanted.groupBy("doc_id").agg(F.collect_set("line_no").alias("numbers"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = with_keys(texts, "doc_id", places.select("doc_id")).join(places, "doc_id")
    found = some.select("doc_id", "text", "numbers").mapInArrow(run, "line long, bytes binary")
    return found.join(wanted.select("line"), "line", "left_semi").dropDuplicates(["line"])


def near_lines(documents: DataFrame, lines: DataFrame, tau: int, min_bytes: int) -> DataFrame:
    """``line, first, near`` of the lines of which an occurrence goes.

    ``first`` is the place of the first occurrence, which goes too if an earlier line is ``near``.
    """
    place = F.struct("doc_id", "line_no")
    firsts = lines.filter("line is not null and doc_id is not null").groupBy("line")
    firsts = firsts.agg(F.min(place).alias("first"), F.min("parity").alias("parity"), F.count("*").alias("n"))
    firsts = stage(firsts)
    met = met_rows(signatures(documents.filter("doc_id is not null"), tau, min_bytes))
    met = met.groupBy("sig", "node").agg(F.bit_or("role").alias("role"))
    met = stage(met.join(firsts, met["node"] == firsts["line"]).select("sig", "node", "role", "first", "parity"))
    few = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 4 * tau

    def verify(pairs: DataFrame) -> DataFrame:
        """Of the pairs ``a, b`` with ``b`` earlier, the lines ``a`` that are near."""
        pairs = stage(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
        wanted = stage(firsts.join(ends, "line").select("line", "first.doc_id", "first.line_no"))
        texts = stage(_line_bytes(documents, wanted))
        rows = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
        rows = rows.select("a", "b", "left", "right")
        return stage(rows.mapInArrow(frugal(lambda batches: _verified(batches, tau)), "a long").distinct())

    earliest = met.groupBy("sig").agg(F.min(F.struct("first", "node", "parity")).alias("head"))
    stars = met.join(earliest, "sig").filter((F.col("first") > F.col("head.first")) & few("parity", "head.parity"))
    stars = stars.groupBy(F.col("node").alias("a"), F.col("head.node").alias("b")).count()
    stars = stars.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    near = verify(stars)
    left = met.join(near, met["node"] == near["a"], "left_anti")
    right = met.select("sig", *(F.col(c).alias(f"r_{c}") for c in ("node", "role", "first", "parity")))
    rest = left.join(right, "sig").filter(
        (F.col("r_first") < F.col("first"))
        & (F.col("role").bitwiseOR(F.col("r_role")) == (INDEX | PROBE))
        & few("parity", "r_parity")
    )
    near = near.union(verify(rest.select(F.col("node").alias("a"), F.col("r_node").alias("b")).distinct()))
    marked = near.select(F.col("a").alias("line"), F.lit(True).alias("near"))
    known = firsts.join(marked, "line", "left").filter("n > 1 or near")
    return known.select("line", "first", F.coalesce("near", F.lit(False)).alias("near"))


def removed_lines(documents: DataFrame, tau: int = TAU, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``doc_id, n_lines, n_bytes, removed``: for each id its lines and the numbers of those that go.

    ``n_lines`` and ``n_bytes`` count all lines, without line feeds; ``removed`` is ordered. See
    ``dedup_lines`` for the rules.
    """
    lines = stage(line_table(documents, min_bytes))
    known = stage(near_lines(documents, lines, tau, min_bytes))
    placed = lines.filter("line is not null and doc_id is not null").select("doc_id", "line_no", "line")
    later = F.col("near") | (F.struct("doc_id", "line_no") > F.col("first"))
    some, _ = split_by_keys(placed, "line", known.select("line"))
    gone = some.join(known, "line").filter(later).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("line_no")).alias("removed")
    )
    whole = lines.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum("n_bytes").alias("n_bytes")
    )
    none = F.array().cast("array<bigint>")
    return whole.join(gone, "doc_id", "left").withColumn("removed", F.coalesce("removed", none))


def dedup_lines(documents: DataFrame, tau: int = TAU, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents without lines that are near an earlier one; ``n_chars`` follows if there is one.

    Lines are cut at line feeds. A line of at least ``min_bytes`` bytes goes if a line within ``tau`` edits
    stands in a smaller ``doc_id``, or before it in the same document. All documents stay, with the empty
    text if no line is left. A null or empty text and a document with a null id stay as they are; the
    latter's lines count for no other. Rows that repeat an id are treated alike: none of their lines is
    earlier than its twin. An empty table gives no row.
    """
    gone = stage(removed_lines(documents, tau, min_bytes).filter(F.size("removed") > 0))
    twin, listed = (fresh_name(name, documents) for name in ("line_dedup_id", "line_dedup_removed"))
    gone = gone.select(F.col("doc_id").alias(twin), F.col("removed").alias(listed))
    some, rest = split_by_keys(documents, "doc_id", gone.select(F.col(twin).cast("long")))
    changed = some.join(gone, some["doc_id"] == gone[twin], "left")
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(line.alias("l"), i.cast("long").alias("i")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(listed, x["i"]))
    untouched = F.col(listed).isNull()
    changed = changed.withColumn("text", F.when(untouched, F.col("text")).otherwise(F.concat_ws("\n", kept["l"])))
    if "n_chars" in documents.columns:
        n_chars = F.when(untouched, F.col("n_chars")).otherwise(F.length("text"))
        changed = changed.withColumn("n_chars", n_chars.cast(documents.schema["n_chars"].dataType))
    return changed.select(*documents.columns).unionByName(rest)
