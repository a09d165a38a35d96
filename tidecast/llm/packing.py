"""Token packing: documents cut into pieces that fill sequences of a fixed length.

Vector bin packing by dot products. An item asks for tokens, one segment and loss-bearing tokens; a
sequence has a limit on each. The open sequence takes the item whose demand has the largest dot product
with what is left of the limits. Where cutting is allowed and no whole item fits, the largest item is cut
to the free space, so a sequence ends full unless its segments run out. What is left at the end of a
partition goes into sequences of lengths that are powers of two, which need no padding.

Every partition packs its own rows and carries unplaced items from batch to batch: no shuffle, no group
that grows with the data, and a lost executor repeats only its own partitions.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.textbytes import SMALL_BLOCK, SPACE, frugal, prefix_hashes, ragged, span_hashes, text_blocks

#: The id that ends every document (fixed by the query's contract).
END_ID = 0
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long"
)
#: Unplaced items that a partition keeps to choose from.
POOL = 1024
#: Distinct pieces of text whose ids a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 1 << 19
#: The same where ids come from the faster library, which makes them again at little cost.
REMEMBERED_FAST = 1 << 17

_CODES = [chr(i) for i in range(128)] + [" "] * 128
_ALNUM = np.array([c.isalnum() for c in _CODES])
_PUNCTUATION = np.array([c.isprintable() and not c.isalnum() and c != " " for c in _CODES])

_encoders: dict[tuple, "_Encoder"] = {}
_special_tokens: dict[str, list[bytes]] = {}


def tokenizer_path(name: str) -> str:
    """A path as it is, or a file name among the public tokenizers installed on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder:
    """Ids of texts, encoding each distinct run of white space and word only once.

    The tokenizer's own split never joins characters across the places that ``_may_cut`` finds, so the
    ids of a text are those of the runs between them, one after the other. Runs are told apart by a
    64-bit hash. ``ranks`` names the same vocabulary for the faster library; without it, or where a text
    holds the name of a special token, the tokenizer itself encodes; with ``ranks`` it is read from its
    file only then.
    """

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self._tokenizer = path, None
        if path not in _special_tokens:
            added = self.tokenizer.get_added_tokens_decoder().values()
            _special_tokens[path] = [t.content.encode() for t in added]
        self.special = _special_tokens[path]
        self.fast = _ranked(ranks) if ranks else None
        if self.fast:
            self._tokenizer = None
        self.remembered = REMEMBERED_FAST if self.fast else REMEMBERED
        self.forget()

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.entry = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if self.fast:
            ids = [self.fast.encode_ordinary(piece) for piece in pieces]
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        starts = self.pool.size + np.cumsum(sizes) - sizes
        flat = np.fromiter((i for one in ids for i in one), dtype=np.uint32, count=int(sizes.sum()))
        at = np.searchsorted(self.keys, keys)
        self.entry = np.insert(self.entry, at, np.arange(keys.size) + self.starts.size)
        self.keys = np.insert(self.keys, at, keys)
        self.pool = np.concatenate([self.pool, flat])
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a block and the end of each text among them."""
        raw = data.tobytes()
        if any(token in raw for token in self.special):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
            ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            flat = np.array([i for one in ids for i in one], dtype=np.uint32)
            return flat, np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        if data.size == 0:
            return np.zeros(0, np.uint32), np.zeros(offsets.size, np.int64)
        starts = np.flatnonzero(_may_cut(data, offsets))
        ends = np.append(starts[1:], data.size)
        hashes = span_hashes(prefix_hashes(data), starts, ends)
        order = np.argsort(hashes)
        change = np.ones(hashes.size, dtype=bool)
        change[1:] = hashes[order[1:]] != hashes[order[:-1]]
        keys, example = hashes[order[change]], order[change]
        if self.keys.size + keys.size > self.remembered:
            self.forget()
        if self.keys.size:
            at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
            missing = np.flatnonzero(self.keys[at] != keys)
        else:
            missing = np.arange(keys.size)
        if missing.size:
            spans = example[missing]
            pieces = [raw[a:b].decode() for a, b in zip(starts[spans].tolist(), ends[spans].tolist())]
            self._learn(keys[missing], pieces)
        entry = np.empty(hashes.size, dtype=np.int64)
        entry[order] = self.entry[np.searchsorted(self.keys, keys)][np.cumsum(change) - 1]
        sizes = self.sizes[entry]
        ids = self.pool[ragged(self.starts[entry], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]


def _ranked(name: str):
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _may_cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a run starts: at a text's start, at ASCII white space after what is surely no white space, and
    at ASCII punctuation after an ASCII letter or digit.

    White space outside ASCII ends in a byte of its own kind after C2, E1, E2 or E3 in its first byte;
    all such characters are taken as white space, which only makes a run longer.
    """
    space = SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[2:] &= ~((data[1:-1] >= 0x80) & (data[:-2] == 0xC2))
    cut[3:] &= ~((data[2:-1] >= 0x80) & (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
    cut[1:] |= _ALNUM[data[:-1]] & _PUNCTUATION[data[1:]]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return cut


def encoder(name: str, ranks: str | None = None) -> _Encoder:
    """This worker's encoder for a tokenizer file."""
    if (name, ranks) not in _encoders:
        _encoders[name, ranks] = _Encoder(tokenizer_path(name), ranks)
    return _encoders[name, ranks]


def drop_encoder(name: str, ranks: str | None = None) -> None:
    """Let go of this worker's encoder for a tokenizer file, as its worker will serve tasks of other kinds."""
    _encoders.pop((name, ranks), None)


class Packer:
    """Places items into sequences; ``limits`` are tokens, segments and loss-bearing tokens."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, first_sequence: int = 0):
        self.limits = np.array(limits, dtype=np.float64)
        self.cut = cut
        self.sequence = first_sequence
        self.items: list[list] = []  # [key, start, tokens, loss tokens]
        self.placed: list[tuple] = []  # (key, start, tokens, loss tokens, sequence, offset)

    def add(self, key, tokens: int, loss: int | None = None) -> None:
        """Add an item; where items may be cut, every token bears loss and ``loss`` is left out.

        An item beyond a limit that may not be cut gets a sequence of its own, longer than the limit.
        """
        loss = tokens if loss is None else loss
        whole = int(min(self.limits[0], self.limits[2]))
        start = 0
        if self.cut:
            while tokens - start >= whole:
                self._close([(key, start, whole, whole)])
                start += whole
        elif tokens > self.limits[0] or loss > self.limits[2]:
            self._close([(key, 0, tokens, loss)])
            return
        if tokens > start:
            self.items.append([key, start, tokens - start, loss - start if self.cut else loss])

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, tokens, loss in pieces:
            self.placed.append((key, start, tokens, loss, self.sequence, offset))
            offset += tokens
        self.sequence += 1

    def pack(self, keep: int = 0) -> None:
        """Fill sequences until no more than ``keep`` items are left."""
        if len(self.items) <= keep:
            return
        items = self.items
        demand = np.array([[i[2], 1, i[3]] for i in items], dtype=np.float64)
        left = np.ones(len(items), dtype=bool)
        remaining = demand[:, 0].sum()
        while (count := int(left.sum())) > keep:
            if self.cut and remaining < self.limits[0] and keep == 0:
                break
            free, pieces = self.limits.copy(), []
            while free[0] > 0:
                fits = left & (demand <= free).all(axis=1)
                if fits.any():
                    score = (demand / self.limits) @ (free / self.limits)
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    left[k] = False
                    pieces.append(tuple(items[k]))
                    free -= demand[k]
                    remaining -= demand[k, 0]
                    continue
                space = int(min(free[0], free[2]))
                if not self.cut or free[1] < 1 or space < 1 or not left.any():
                    break
                k = int(np.argmax(np.where(left, demand[:, 0], -1.0)))
                key, start, tokens, loss = items[k]
                pieces.append((key, start, space, space))
                items[k] = [key, start + space, tokens - space, loss - space]
                demand[k] -= (space, 0, space)
                free -= (space, 1, space)
                remaining -= space
            self._close(pieces)
            if int(left.sum()) == count and not self.cut:
                raise AssertionError("an item fits into no empty sequence")
        self.items = [i for i, there in zip(items, left) if there]
        if self.cut and keep == 0:
            self._powers()

    def _powers(self) -> None:
        """Put what is left, less than one sequence, into lengths that are powers of two."""
        while total := sum(i[2] for i in self.items):
            room = min(1 << (int(total).bit_length() - 1), int(min(self.limits[0], self.limits[2])))
            pieces = []
            while room and len(pieces) < self.limits[1]:
                key, start, tokens, loss = self.items[-1]
                take = min(room, tokens)
                pieces.append((key, start, take, take))
                room -= take
                if take == tokens:
                    self.items.pop()
                else:
                    self.items[-1] = [key, start + take, tokens - take, loss - take]
            self._close(pieces)

    def take(self) -> list[tuple]:
        placed, self.placed = self.placed, []
        return placed


def _first_sequence() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def pack_documents(
    documents: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    tokens: int = 1024,
    segments: int = 64,
    loss_tokens: int | None = None,
) -> DataFrame:
    """Pack ``documents(doc_id, text)`` into sequences; one row per piece (``PIECES``).

    A document is its ids and ``END_ID``; a null or empty text is ``END_ID`` alone. Every id bears loss.
    Repeated rows and repeated or null ``doc_id`` are documents of their own. No row gives no piece.
    ``sequence_id`` is unique and holds the partition in its upper bits; other columns are ignored.
    """
    limits = (tokens, segments, tokens if loss_tokens is None else loss_tokens)
    schema = pa.schema([(n.split()[0], pa.int64()) for n in PIECES.split(", ")])

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ids_of, serial = Packer(limits, True, _first_sequence()), {}, 0

        def rows() -> pa.RecordBatch:
            out = []
            for key, start, size, loss, sequence, offset in packer.take():
                doc_id, ids = ids_of[key]
                crc = zlib.crc32(ids[start : start + size].astype("<u4").tobytes())
                out.append((doc_id, start, size, crc, ids.size, sequence, offset, loss))
            waiting = {item[0] for item in packer.items}
            for key in [key for key in ids_of if key not in waiting]:
                del ids_of[key]
            columns = zip(*out) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        try:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for first, last, data, offsets in text_blocks(batch.column(1), SMALL_BLOCK):
                    flat, ends = encoder(tokenizer, ranks).encode(data, offsets)
                    for i in range(last - first):
                        ids = np.append(flat[ends[i] : ends[i + 1]], np.uint32(END_ID))
                        ids_of[serial] = (doc_ids[first + i], ids)
                        packer.add(serial, ids.size)
                        serial += 1
                    if len(packer.items) > 2 * POOL:
                        packer.pack(POOL)
                    yield rows()
            packer.pack()
            yield rows()
        finally:
            drop_encoder(tokenizer, ranks)

    return documents.select("doc_id", "text").mapInArrow(pack, PIECES)


def pack_examples(
    examples: DataFrame, tokens: int = 1024, segments: int = 16, loss_tokens: int = 512
) -> DataFrame:
    """Pack whole instruction examples ``(example_id, tokens, loss_tokens)`` without cutting them.

    Gives ``example_id, tokens, loss_tokens, sequence_id, offset``. An example beyond a limit has a
    sequence of its own; null counts are taken as 0, and an example without tokens is left out.
    """
    names = ["example_id", "tokens", "loss_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    limits = (tokens, segments, loss_tokens)

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, False, _first_sequence())

        def rows() -> pa.RecordBatch:
            out = [(k, t, lost, s, o) for k, _, t, lost, s, o in packer.take()]
            columns = zip(*out) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            for key, size, loss in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(key, size, loss)
                if len(packer.items) > 2 * POOL:
                    packer.pack(POOL)
            yield rows()
        packer.pack()
        yield rows()

    asked = examples.select(
        F.col("example_id").cast("long"),
        F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.col("loss_tokens"), F.lit(0)).cast("long").alias("loss_tokens"),
    ).filter("tokens > 0")
    return asked.mapInArrow(pack, ", ".join(f"{n} long" for n in names))
