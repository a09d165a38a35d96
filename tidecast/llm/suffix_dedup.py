"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``GRAM`` bytes picks triggers: the smallest hash of every stretch that one string of
``length`` bytes covers. So each such string holds a trigger, and equal strings hold the same one. All
strings with one trigger occurrence in common lie in one phrase, the bytes that they cover together;
phrases overlap, so that no string is lost between two.

The parse lists, for every document, its phrases by hash. A phrase that also stands in a document with a
smaller id goes whole. What is left is the dictionary, the first occurrence of each distinct phrase. Of it,
only phrases that share a trigger, and half of the bytes that a string has beyond it, with another phrase
can hold a repeated string. The suffixes of those are put in order by their first ``length`` bytes, and
suffixes that are equal there carry the smallest document id to each other.

Blocks of texts, and chunks of the dictionary, resolve what they repeat themselves, so a passage that very
many documents share reaches the exchange once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.meeting import split_by_keys
from tidecast.llm.textbytes import mix, prefix_hashes, ragged, span_hashes, text_blocks
from tidecast.session import stage

#: Bytes of a trigger.
GRAM = 16
#: Suffixes of the dictionary that are put in order at once.
SUFFIXES = 400_000
#: A mark packs 40 bits of a phrase's hash and its number in the text; a text has fewer phrases than this.
NUMBERS = 1 << 24


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple:
    """Text, start, length, trigger offset, trigger hash and phrase hash of all phrases of a block."""
    stretch = length - GRAM + 1
    sizes = np.diff(offsets)
    valid = np.maximum(sizes - length + 1, 0)
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = prefix_hashes(data)
    grams = np.arange(data.size - GRAM + 1)
    smallest = span_hashes(prefix, grams, grams + GRAM)
    hashes, at, done = smallest.copy(), grams.astype(np.int32), 1
    while done < stretch:
        step = min(done, stretch - done)
        lower = smallest[step:] < smallest[:-step]
        smallest[:-step] = np.where(lower, smallest[step:], smallest[:-step])
        at[:-step] = np.where(lower, at[step:], at[:-step])
        done += step
    # Every start of a string inside a text, and its trigger; a phrase is a run of starts with one trigger.
    starts = ragged(offsets[:-1], valid)
    text = np.repeat(np.arange(sizes.size), valid)
    trigger = at[starts]
    new = np.ones(starts.size, dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts.size) - 1
    begin, end, trigger, text = starts[first], starts[last] + length, trigger[first].astype(np.int64), text[first]
    whole = span_hashes(prefix, begin, end) ^ mix((trigger - begin).astype(np.uint64))
    return text, begin - offsets[text], end - begin, trigger - begin, hashes[trigger], whole


@dataclass
class _Phrases:
    """The phrases of a block of texts, and the first one of each text (and the total)."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    offset: np.ndarray
    gram: np.ndarray
    mark: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, length: int) -> "_Phrases":
        text, start, size, offset, gram, phrase = phrases(data, offsets, length)
        first = np.searchsorted(text, np.arange(offsets.size))
        number = np.arange(text.size) - first[text]
        if number.size and number.max() >= NUMBERS:
            raise ValueError("a text has more phrases than a mark can number")
        mark = (phrase & ~np.uint64(NUMBERS - 1)) | number.astype(np.uint64)
        return cls(text, start, size, offset, gram, mark, first)

    def find(self, text: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The phrase of each mark of a text, or -1 where the mark is of another text with the same id."""
        at = self.first[text] + (marks.view(np.uint64) & np.uint64(NUMBERS - 1)).astype(np.int64)
        inside = at < self.first[text + 1]
        at = np.where(inside, at, 0)
        if not self.mark.size:
            return np.full(marks.size, -1, dtype=np.int64)
        return np.where(inside & (self.mark[at] == marks.view(np.uint64)), at, -1)


def parse(documents: DataFrame, length: int) -> DataFrame:
    """``gram, mark, doc_id, known``: the phrases of all documents by their trigger.

    ``known`` tells those that stand in a smaller document of the same block of texts; they need not meet
    others, and their ``gram`` is replaced by a hash of their own, which spreads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in text_blocks(batch.column(1)):
                found = _Phrases.of(data, offsets, length)
                ids = batch.column(0).to_numpy()[begin + found.text]
                phrase = found.mark >> np.uint64(24)
                order = np.lexsort((ids, phrase, found.gram))
                gram, phrase, ids, mark = found.gram[order], phrase[order], ids[order], found.mark[order]
                new = np.ones(gram.size, dtype=bool)
                new[1:] = (gram[1:] != gram[:-1]) | (phrase[1:] != phrase[:-1])
                known = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
                gram = np.where(known, mix(mark + ids.view(np.uint64)), gram)
                columns = [pa.array(gram.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(ids), pa.array(known)]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "mark", "doc_id", "known"])

    return documents.mapInArrow(run, "gram long, mark long, doc_id long, known boolean")


def _listed(column: pa.Array, begin: int, end: int) -> tuple[np.ndarray, pa.Array]:
    """The text of every value in the lists of some rows, and the values."""
    lists = column.slice(begin, end - begin)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(end - begin), sizes), lists.flatten()


def dictionary(documents: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """``key, doc_id, mark, start, bytes``: the bytes of the phrases ``first(doc_id, mark)``, in two parts.

    A string whose trigger stands in its later half holds the trigger and half of the rest to its left, any
    other one the trigger and half of the rest to its right. The key is a hash of these bytes, and a part
    has the strings that hold them.
    """
    half = (length - GRAM + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                found = _Phrases.of(data, offsets, length)
                text, marks = _listed(batch.column(2), begin, end)
                at = found.find(text, marks.to_numpy())
                at = at[at >= 0]
                prefix, raw, ids = prefix_hashes(data), data.tobytes(), batch.column(0).to_numpy()[begin:end]
                base = offsets[found.text[at]]
                head = base + found.start[at]
                trigger, tail = head + found.offset[at], head + found.size[at] - length
                for left in (True, False):
                    low = head if left else np.maximum(head, trigger - half + 1)
                    high = np.minimum(tail, trigger - half) if left else tail
                    some = np.flatnonzero(low <= high)
                    key_from = trigger[some] - half if left else trigger[some]
                    key = mix(span_hashes(prefix, key_from, key_from + GRAM + half) + np.uint64(left))
                    low, stop = low[some], high[some] + length
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)),
                            pa.array(ids[found.text[at[some]]], pa.int64()),
                            pa.array(found.mark[at[some]].view(np.int64)),
                            pa.array(low - base[some]),
                            pa.array([raw[x:y] for x, y in zip(low.tolist(), stop.tolist())], pa.binary()),
                        ],
                        names=["key", "doc_id", "mark", "start", "bytes"],
                    )

    wanted = first.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    some, _ = split_by_keys(documents, "doc_id", first.select("doc_id"))
    rows = some.join(wanted, "doc_id").select("doc_id", "text", "marks")
    return rows.mapInArrow(run, "key long, doc_id long, mark long, start long, bytes binary")


def _equal_suffixes(part: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every string of the rows: its row, its place there, a hash, and whether a smaller document has it.

    The suffixes are ordered by their first ``length`` bytes and then by document.
    """
    ids, pieces = part.column("doc_id").to_numpy(), part.column("bytes").to_pylist()
    size = np.array([len(x) for x in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join([*pieces, bytes(8)]), dtype=np.uint8)
    ends = np.cumsum(size)
    count = size - length + 1
    row = np.repeat(np.arange(size.size), count)
    at = ragged(ends - size, count)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    keys = [words[at + k] for k in steps]
    order = np.lexsort((ids[row], *reversed(keys)))
    new = np.ones(order.size, dtype=bool)
    new[1:] = ~np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    owner = ids[row[order]]
    smallest = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    repeated = np.empty(order.size, dtype=bool)
    repeated[order] = owner > smallest
    return row, at - (ends - size)[row], span_hashes(prefix_hashes(data), at, at + length), repeated


def _resolve(part: pa.Table, cut_keys: set, length: int) -> pa.RecordBatch:
    """Runs of repeated strings of some rows, and by hash the other strings of keys that go on elsewhere."""
    ids, key = part.column("doc_id").to_numpy(), part.column("key").to_numpy()
    new = np.ones(key.size, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
    cut = np.array([k in cut_keys for k in key[first].tolist()])
    part = part.filter(pa.array((several | cut)[np.cumsum(new) - 1]))
    ids, mark, start = (part.column(c).to_numpy() for c in ("doc_id", "mark", "start"))
    row, place, name, repeated = _equal_suffixes(part, length)
    hit = np.flatnonzero(repeated)
    head = np.ones(hit.size, dtype=bool)
    head[1:] = (row[hit[1:]] != row[hit[:-1]]) | (place[hit[1:]] != place[hit[:-1]] + 1)
    run, last = hit[head], hit[np.append(np.flatnonzero(head)[1:], hit.size) - 1] if hit.size else hit
    open_rows = np.isin(part.column("key").to_numpy(), np.array(sorted(cut_keys), dtype=np.int64))
    rest = np.flatnonzero(~repeated & open_rows[row])
    chosen = np.concatenate([run, rest])
    ends = np.concatenate([place[last], place[rest]]) + length
    names = pa.array(name[chosen].view(np.int64), mask=np.arange(chosen.size) < run.size)
    columns = [names, pa.array(ids[row[chosen]]), pa.array(mark[row[chosen]])]
    columns += [pa.array(start[row[chosen]] + place[chosen]), pa.array(start[row[chosen]] + ends)]
    return pa.RecordBatch.from_arrays(columns, names=["suffix", "doc_id", "mark", "start", "end"])


def suffix_order(entries: DataFrame, length: int, suffixes: int) -> DataFrame:
    """``suffix, doc_id, mark, start, end``: runs of repeated strings, ``suffix`` being null.

    Entries come by key. A chunk holds whole keys, and what is equal there is settled; where a key has more
    entries than a chunk, its strings that no smaller document of the chunk has are returned by their hash,
    to be settled among the chunks.
    """
    limit = max(1, suffixes // (length // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = [], set()
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < limit:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            done = int(np.searchsorted(key, key[-1]))
            if done == 0:  # one key alone: it goes on in the next chunk
                cut, done = {int(key[-1])}, rows.num_rows
            for begin in range(0, done, limit):
                part = rows.slice(begin, min(limit, done - begin)).combine_chunks()
                edges = {int(key[x]) for x in (begin, begin + part.num_rows - 1)}
                yield _resolve(part, cut | edges, length)
            held = rows.slice(done).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        for begin in range(0, rows.num_rows if rows else 0, limit):
            part = rows.slice(begin, limit).combine_chunks()
            key = part.column("key").to_numpy()
            yield _resolve(part, cut | {int(key[0]), int(key[-1])}, length)

    placed = entries.repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "suffix long, doc_id long, mark long, start long, end long")


def repeated_spans(documents: DataFrame, length: int, suffixes: int = SUFFIXES) -> DataFrame:
    """``doc_id, spans``: for each id with repeated strings, arrays of ``mark, start, end``.

    A span without a start is the whole phrase of the mark. Spans may overlap.
    """
    rows = parse(documents, length).repartition("gram")
    number = F.shiftrightunsigned("mark", 24)
    rows = rows.withColumn("phrase", number).withColumn("first", F.min("doc_id").over(Window.partitionBy("gram", "phrase")))
    gram = Window.partitionBy("gram")
    rows = rows.withColumns(
        {
            "mixed": F.min("phrase").over(gram) != F.max("phrase").over(gram),
            "several": F.min("doc_id").over(gram) != F.max("doc_id").over(gram),
        }
    )
    whole = F.col("known") | (F.col("first") < F.col("doc_id"))
    parsed = rows.withColumn("whole", whole).filter("whole or (mixed and several)")
    parsed = stage(parsed.select("doc_id", "mark", "whole"))

    entries = dictionary(documents, parsed.filter("not whole").select("doc_id", "mark"), length)
    found = stage(suffix_order(entries, length, suffixes))
    named = found.filter("suffix is not null")
    named = named.withColumn("first", F.min("doc_id").over(Window.partitionBy("suffix"))).filter("first < doc_id")
    nothing = F.lit(None).cast("long")
    wholes = parsed.filter("whole").select("doc_id", "mark", nothing.alias("start"), nothing.alias("end"))
    strings = found.filter("suffix is null").unionByName(named.drop("first")).drop("suffix")
    spans = wholes.unionByName(strings).groupBy("doc_id")
    return spans.agg(F.collect_list(F.struct("mark", "start", "end")).alias("spans"))


def _spans_of(column: pa.Array, begin: int, end: int, found: _Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the spans of some rows; those of other texts with the same id are left out."""
    text, spans = _listed(column, begin, end)
    mark, start, stop = (spans.field(i) for i in range(3))
    at = found.find(text, mark.to_numpy(zero_copy_only=False))
    own = at >= 0
    whole = start.is_null().to_numpy(zero_copy_only=False)
    start, stop = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (start, stop))
    if found.start.size:
        start = np.where(whole, found.start[at], start)
        stop = np.where(whole, found.start[at] + found.size[at], stop)
    return text[own], start[own], stop[own]


def _cut(batch: pa.RecordBatch, length: int, marked: bool, texts: bool) -> pa.RecordBatch:
    """Statistics, and the kept text, of a batch ``doc_id, text`` with ``spans`` if it is ``marked``."""
    n_bytes, n_removed, n_spans, digest, kept_texts = [], [], [], [], []
    for begin, end, data, offsets in text_blocks(batch.column(1)):
        gone = np.zeros(data.size + 1, dtype=np.int64)
        if marked:
            text, start, stop = _spans_of(batch.column(2), begin, end, _Phrases.of(data, offsets, length))
            np.add.at(gone, offsets[text] + start, 1)
            np.add.at(gone, offsets[text] + stop, -1)
        removed = np.cumsum(gone)[:-1] > 0
        heads = removed.copy()
        heads[1:] &= ~removed[:-1]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        heads[filled] = removed[filled]
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            lost = int(removed[a:b].sum())
            rest = data[a:b][~removed[a:b]].tobytes() if lost else raw[a:b]
            n_bytes.append(b - a)
            n_removed.append(lost)
            n_spans.append(int(heads[a:b].sum()))
            digest.append(hashlib.sha256(rest).hexdigest())
            if texts:
                kept_texts.append(rest)
    columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))]
    columns.append(pa.array(digest, pa.string()))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if texts:
        columns.append(pa.array(kept_texts, pa.binary()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(
    documents: DataFrame, length: int = 50, texts: bool = False, suffixes: int = SUFFIXES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``documents(doc_id, text)``.

    A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id;
    this is judged on the input, and no string crosses documents. ``n_spans`` counts the longest removed
    runs, ``kept_sha256`` is of what is left, which ``texts`` adds as ``kept`` (bytes: a cut may fall inside
    a character). A null text is empty. Rows that repeat an id are each cut, and none is smaller than the
    other. A row with a null id loses nothing and counts for no other. Other columns are ignored; an empty
    table gives no row. ``length`` is at least 24 and at most 128; ``suffixes`` are ordered at once.
    """
    if not 24 <= length <= 128:
        raise ValueError("strings of 24 to 128 bytes are supported")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = stage(repeated_spans(rows.filter("doc_id is not null"), length, suffixes))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def run(marked: bool):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _cut(batch, length, marked, texts)

        return cut

    some, rest = split_by_keys(rows, "doc_id", spans.select("doc_id"), (run(False), schema))
    joined = some.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return rest.unionByName(joined.mapInArrow(run(True), schema))
