"""Grouping of spelling variants: words one edit apart, found by walking a trie level by level.

The trie is a table of edges ``(node, first, label, child)``. A node is the hash of a prefix, and only
prefixes where words part, or end, are nodes; an edge bears the letters between two of them. The search
is a table of states ``(word, position, node, edits)``. A word's states without an edit are the nodes on its
own path. Where other edges leave such a node, an inserted, deleted or replaced letter carries the word over
to them; from there it can only follow its own letters, one join with the edges a level, until no state is
left. A state that ends with its word where another one ends has found a neighbour. Edges know which letters
follow their child, so most states end before they are shuffled.

The branches near the root are many. Therefore words are walked in both directions, and each direction edits
only the second half of its letters: the first half is then a given path. A pair whose first halves
are equal belongs to the forward walk, every other one to the backward walk. Depths above the half are never
indexed. Neighbours are verified on their letters, so equal hashes of different prefixes do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.textbytes import LOWER, frugal, mix, prefix_hashes, ragged, runs, span_hashes, text_blocks
from tidecast.session import stage

#: Words have at least so many letters and occurrences.
MIN_LETTERS, MIN_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: A run loses a letter if this divides its checksum.
THINNED = 31
#: Longer runs, in bytes, are hashed one by one.
LONG_RUN = 48
FORWARD, BACKWARD = 0, 1

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))
#: First byte of every letter from U+00C0 to U+00FF; such a letter has two bytes.
_LEAD = 0xC3
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    # Fixed value: the reversed polynomial of CRC-32.
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of the spans, continued from the checksums ``before``."""
    sizes = ends - starts
    state = before ^ np.uint32(0xFFFFFFFF)
    short = np.flatnonzero(sizes <= LONG_RUN)
    short = short[np.argsort(-sizes[short], kind="stable")]
    at, size, now = starts[short], sizes[short], state[short]
    for i in range(int(size[0]) if size.size else 0):
        live = int(np.searchsorted(-size, -i))  # spans longer than i come first
        now[:live] = _CRC[(now[:live] ^ data[at[:live] + i]) & np.uint32(255)] ^ (now[:live] >> np.uint32(8))
    state[short] = now
    found = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(sizes > LONG_RUN):
        found[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return found


def _block_words(doc_ids: list, data: np.ndarray, offsets: np.ndarray, letters: int) -> tuple[list, np.ndarray]:
    """Distinct words of a block of texts and how often each occurs there."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, first = runs(inside, offsets)
    text = np.repeat(np.arange(len(doc_ids)), np.diff(first))
    leads = np.concatenate([[0], np.cumsum(lead)])
    size = ends - starts - (leads[ends] - leads[starts])
    long = size >= letters
    starts, ends, text, size = starts[long], ends[long], text[long], size[long]
    hashes = span_hashes(prefix_hashes(data, lower=True), starts, ends)
    # The checksum hangs on the document and the run, not on the place.
    _, once, times = np.unique(
        mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True
    )
    starts, ends, text, size, hashes = starts[once], ends[once], text[once], size[once], hashes[once]
    low = LOWER[data]
    before = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in doc_ids], dtype=np.uint32)
    checks = _checksums(low, starts, ends, before[text])
    known = np.array([i is not None for i in doc_ids], dtype=bool)
    thinned = (checks % THINNED == 0) & known[text]
    raw = low.tobytes()
    _, example, of = np.unique(hashes[~thinned], return_index=True, return_inverse=True)
    counts = np.bincount(of, weights=times[~thinned], minlength=example.size).astype(np.int64)
    a, b = starts[~thinned][example].tolist(), ends[~thinned][example].tolist()
    found = [raw[i:j].decode() for i, j in zip(a, b)]
    less, more = [], []
    for k in np.flatnonzero(thinned & (size > letters)).tolist():
        run = raw[starts[k] : ends[k]].decode()
        gone = int(checks[k]) % len(run)
        less.append(run[:gone] + run[gone + 1 :])
        more.append(int(times[k]))
    return found + less, np.concatenate([counts, np.array(more, dtype=np.int64)])


def vocabulary(documents: DataFrame, letters: int = MIN_LETTERS, count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words of the texts; see ``spelling_forms`` for what a word is."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, data, offsets in text_blocks(batch.column(1)):
                found, n = _block_words(ids[first:last], data, offsets, letters)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n)], names=["word", "n"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _half(size: Column, way: Column) -> Column:
    """Letters that a walk takes before it may edit."""
    return F.when(way == FORWARD, F.floor(size / 2)).otherwise(size - F.floor(size / 2)).cast("int")


def _prefixes(words: DataFrame) -> DataFrame:
    """``way, walk, n, size, depth, node, next``: every prefix that an edit may start from or lead to.

    ``walk`` is the word in the order of its way, ``next`` the letter after the prefix, or 0 at the end. One
    letter above the half is added for the sake of words that are a letter shorter.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # All letters lie below U+0100: one byte each.
            encoded = [word.encode("latin-1") for word in batch.column(1).to_pylist()]
            data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
            size = np.array([len(word) for word in encoded], dtype=np.int64)
            start = np.cumsum(size) - size
            way = batch.column(0).to_numpy()
            lowest = np.where(way == FORWARD, (size - 1) // 2, size // 2)
            depth = ragged(lowest, size - lowest + 1)
            row = np.repeat(np.arange(size.size), size - lowest + 1)
            ends = start[row] + depth
            hashes = span_hashes(prefix_hashes(data), start[row], ends) ^ mix(way[row].astype(np.uint64) + np.uint64(1))
            following = np.where(depth < size[row], np.append(data, np.uint8(0))[ends], 0).astype(np.int32)
            columns = [c.take(pa.array(row)) for c in batch.columns]
            columns += [pa.array(x) for x in (size[row].astype(np.int32), depth.astype(np.int32), hashes.view(np.int64), following)]
            yield pa.RecordBatch.from_arrays(columns, names=["way", "walk", "n", "size", "depth", "node", "next"])

    ways = F.explode(
        F.array(
            F.struct(F.lit(FORWARD).alias("way"), F.col("word").alias("walk")),
            F.struct(F.lit(BACKWARD).alias("way"), F.reverse("word").alias("walk")),
        )
    )
    walks = words.select(ways.alias("walk"), "n").select("walk.way", "walk.walk", "n")
    return walks.mapInArrow(run, "way int, walk string, n long, size int, depth int, node long, next int")


def _bit(letter: Column) -> Column:
    """One of 63 bits for a letter, the last one for the end of a word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when(letter == 0, 63).otherwise(letter % 63).cast("int"))


def _letter_at(walk: Column, position: Column) -> Column:
    """Code of the letter after ``position`` letters, 0 at the end."""
    letter = F.substring(walk, position + 1, F.lit(1))
    return F.when(letter == "", 0).otherwise(F.ascii(letter))


def _paths(words: DataFrame) -> DataFrame:
    """Every word's nodes, in both ways: where other words leave it or end, and its own end.

    Each row has the label, child and following letters of the edge that goes on to the word's next node.
    """
    rows = _prefixes(words)
    parting = rows.groupBy("node").agg(
        F.min("next").alias("low"), F.max("next").alias("high"), F.bit_or(_bit(F.col("next"))).alias("letters")
    )
    parting = parting.filter("low < high").select("node", "letters")
    # One short row per node on the other side: looked up, so that the long rows need not be sorted.
    at_parting = rows.join(parting.hint("shuffle_hash"), "node")
    at_end = rows.filter("depth = size").join(parting, "node", "left_anti").withColumn("letters", _bit(F.lit(0)))
    path = Window.partitionBy("way", "walk").orderBy("depth")
    ahead = {c: F.lead(c).over(path) for c in ("depth", "node", "letters")}
    stops = at_parting.unionByName(at_end).select(
        "*", ahead["depth"].alias("to"), ahead["node"].alias("child"), ahead["letters"].alias("after")
    )
    return stops.withColumn("label", F.substring("walk", F.col("depth") + 1, F.col("to") - F.col("depth")))


def _edges(paths: DataFrame) -> DataFrame:
    """``node, next, label, child, after, end, second``: one row per edge; ``end`` is the word that ends at the child.

    ``after`` has the bits of the letters that follow the child, ``second`` those that follow the edge's first
    letter. A word that ends at a node has an edge without a label and without a child there.
    """
    end = F.struct("n", F.col("walk").alias("word"))
    ends_there = F.when(F.col("child").isNull() | (F.col("to") == F.col("size")), end)
    edges = paths.groupBy("node", "next").agg(
        F.first("label").alias("label"),
        F.first("child").alias("child"),
        F.first("after").alias("after"),
        F.max(ends_there).alias("end"),
    )
    second = F.when(F.length("label") > 1, _bit(_letter_at(F.col("label"), F.lit(1)))).otherwise(F.col("after"))
    return edges.withColumn("second", F.coalesce(second, _bit(F.lit(0))))


def _arrived(states: DataFrame) -> DataFrame:
    """States ``way, walk, position, child, after, end`` that found a word or may go on."""
    found = (F.col("position") == F.length("walk")) & F.col("end").isNotNull()
    letter = _letter_at(F.col("walk"), F.col("position"))
    goes_on = (letter > 0) & (F.col("after").bitwiseAND(_bit(letter)) != 0)
    return states.filter(found | F.coalesce(goes_on, F.lit(False)))


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: for each of ``words(word, n)`` all others that are one edit apart."""
    paths = stage(_paths(words))
    edges = stage(_edges(paths))
    walk, depth, size = F.col("walk"), F.col("depth"), F.col("size")
    label = F.coalesce("label", F.lit(""))
    length = F.length(label)

    def after_edit(begin: Column, text: Column) -> Column:
        """Position behind the label if the word has ``text`` from ``begin`` on."""
        return F.when(F.substring(walk, begin + 1, F.length(text)) == text, begin + F.length(text))

    rest = F.substring(label, F.lit(2), length)
    edits = F.array(
        F.when((length > 0) & (depth < size), after_edit(depth + 1, rest)),  # replaced
        F.when(length > 0, after_edit(depth, rest)),  # the other word has a letter more
        F.when(depth < size, after_edit(depth + 1, label)),  # the other word has a letter less
    )
    own = paths.filter(depth >= _half(size, F.col("way"))).select(
        "way",
        "walk",
        "depth",
        "size",
        "node",
        F.col("next").alias("own_next"),
        _letter_at(walk, depth + 1).alias("own_second"),
    )
    own = own.withColumn("wanted", _bit(F.col("own_next")).bitwiseOR(_bit(F.col("own_second"))))
    # Behind the edit, the next letters must agree; that is judged on bits before any text is compared.
    agrees = (F.col("second").bitwiseAND(F.col("wanted")) != 0) | (F.col("next") == F.col("own_second"))
    edited = own.join(edges, "node").filter((F.col("next") != F.col("own_next")) & agrees)
    edited = edited.withColumn("position", F.explode(edits)).filter("position is not null")
    columns = ["way", "walk", "position", "child", "after", "end"]
    states = stage(_arrived(edited).select(columns))
    levels = [states]
    steps = edges.filter("next > 0").withColumnRenamed("child", "below").select("node", "next", "label", "below", F.col("after").alias("beyond"), F.col("end").alias("reached"))
    while True:
        going = states.filter(F.col("position") < F.length("walk")).select(
            "way", "walk", "position", F.col("child").alias("node"), _letter_at(walk, F.col("position")).alias("next")
        )
        follows = F.substring(walk, F.col("position") + 1, F.length("label")) == F.col("label")
        moved = going.join(steps, ["node", "next"]).filter(follows).select(
            "way",
            "walk",
            (F.col("position") + F.length("label")).alias("position"),
            F.col("below").alias("child"),
            F.col("beyond").alias("after"),
            F.col("reached").alias("end"),
        )
        states = stage(_arrived(moved))
        if states.isEmpty():
            break
        levels.append(states)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    forward = F.col("way") == FORWARD
    pairs = every.filter((F.col("position") == F.length("walk")) & F.col("end").isNotNull()).select(
        forward.alias("forward"),
        F.when(forward, walk).otherwise(F.reverse("walk")).alias("word"),
        F.when(forward, F.col("end.word")).otherwise(F.reverse("end.word")).alias("near"),
        F.col("end.n").alias("near_n"),
    )
    half = F.floor(F.length("word") / 2).cast("int")
    same = F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half)
    return pairs.filter((F.col("forward") == same) & (F.levenshtein("word", "near", 1) == 1)).drop("forward")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form``: where following the forms ends. A form is more frequent than its word."""
    roots = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        higher = roots.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        joined = stage(roots.join(higher, "root", "left").select("word", "root", "higher"))
        roots = joined.select("word", F.coalesce("higher", "root").alias("root"))
        if joined.filter("higher is not null").isEmpty():
            return roots


def spelling_forms(
    documents: DataFrame, letters: int = MIN_LETTERS, count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``documents(doc_id, text)``.

    Words are runs of Latin letters (A-Z, a-z and U+00C0 to U+00FF) with A-Z lower-cased. A run whose crc32
    behind ``<doc_id>:`` is a multiple of 31 first loses the letter at that number modulo its length. Words of
    fewer than ``letters`` letters or ``count`` occurrences are left out. ``n_near`` counts the other words one
    inserted, deleted or replaced letter apart; ``form`` is the most frequent of them, the first in code-point
    order on a tie, if it is at least ``ratio`` times as frequent as the word, and null otherwise; ``root`` is
    where following forms ends, the word itself if it has none.

    A null or empty text has no word. A null id is no part of any checksum: runs of its text stay whole. Rows
    that repeat an id are texts of their own. An empty table gives no row; other columns are ignored.
    """
    words = stage(vocabulary(documents, letters, count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    high = F.col("best.near").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    known = stage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(high, F.col("best.near")).alias("form"),
            F.when(high, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
