"""Packing against the tokenizer, and its sequences against best fit one document after the other."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tidecast.llm import best_fit
from tidecast.llm.packing import tokenizer_path

SCHEMA = "doc_id long, text string, piece int, item long"


def one_by_one(sizes, limit):
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, size)
        if k < len(gaps):
            gap = gaps.pop(k) - size
        else:
            opened, gap = opened + 1, limit - size
        if gap:
            bisect.insort(gaps, gap)
    return opened


@pytest.fixture
def many_partitions(spark):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ("false", "5")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


CASES = {
    "mixed": lambda rng: [rng.randint(1, 200) for _ in range(300)] + [rng.randint(1, 1024) for _ in range(100)],
    "one size": lambda rng: [170] * 500,
    "halves": lambda rng: [512] * 40 + [513] * 40 + [511] * 7,
    "tiny": lambda rng: [rng.randint(1, 3) for _ in range(700)],
    "full": lambda rng: [1024] * 30 + [1] * 5,
}


@pytest.mark.parametrize("name", CASES)
def test_few_sequences(spark, many_partitions, name):
    sizes = CASES[name](random.Random(4))
    items = best_fit.stage(spark.createDataFrame(list(enumerate(sizes)), "item long, size int").repartition(4))
    placed = best_fit.best_fit(items, 1024).collect()
    assert sorted((r.item, r["size"]) for r in placed) == list(enumerate(sizes))
    held = defaultdict(int)
    for r in placed:
        held[r.gap] += r["size"]
    assert max(held.values()) <= 1024
    assert len(held) <= 1.02 * one_by_one(sizes, 1024) + 1


def test_pieces_are_those_of_the_tokenizer(spark, many_partitions):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [None, "", "   ", "It's  a<|endoftext|>Test", "don't!!!stop 12345 Ünïcodé  x", "Ⅻ ǅ ﬁ àb", "word " * 9000]
    texts += [" ".join(rng.choice(["alpha", "Beta's", "x1y2", "--", "ñandú"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i if i % 9 else None, text, 0, 0) for i, text in enumerate(texts)] + [(1, "again", 0, 0), (1, "again", 0, 0)]
    found = best_fit.pack_whole(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    encode = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode
    expected, sizes = [], []
    for i, text, *_ in rows:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, start in enumerate(range(0, ids.size, 4096)):
            part = ids[start : start + 4096]
            expected.append((-1 if i is None else i, k, start, part.size, zlib.crc32(part.tobytes())))
            sizes.append(part.size)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:5]) for r in found) == sorted(expected)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= one_by_one(sizes, 4096) + 1
    assert best_fit.pack_whole(spark.createDataFrame([], SCHEMA)).collect() == []


def test_waiting_items_meet_the_nearest_free_slots():
    # (partition, waiting, free): the third takes from the second first, then from the first.
    plan = best_fit._plan([(0, 2, 5), (1, 1, 2), (2, 4, 0), (3, 9, 1)])
    waiting = [(p[1], p[2], p[3]) for p in plan if p[0] == best_fit.ITEM]
    assert waiting == [(1, 0, 1), (2, 0, 2), (2, 2, 4), (3, 0, 2)]
    slots = [(p[1], p[2], p[3]) for p in plan if p[0] == best_fit.GAP]
    assert slots == [(0, 0, 1), (1, 0, 2), (0, 1, 3), (0, 3, 5)]
