"""Pieces hold every id once, sequences are full, and the ids are the tokenizer's own."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tidecast.llm import packing, textbytes

SCHEMA = "doc_id long, text string, length int, start string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("ranks", [None, "byte_bpe_50k.tiktoken"])
def test_ids_are_those_of_the_tokenizer(tokenizer, ranks):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "a", "É", "'s", "1", "!!", "ç", "x​", "語", "don't", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", None, "a<|endoftext|> b", "word " * 500]
    encode = packing.encoder("byte_bpe_50k.json", ranks).encode
    for first, last, data, offsets in textbytes.text_blocks(pa.array(texts, pa.string()), 2000):
        ids, ends = encode(data, offsets)
        expected = tokenizer.encode_batch([t or "" for t in texts[first:last]], add_special_tokens=False)
        for i, e in enumerate(expected):
            assert ids[ends[i] : ends[i + 1]].tolist() == e.ids


def test_workers_keep_no_encoder_after_their_task(spark):
    rows = [(i, f"text number {i}", 0, "x") for i in range(400)]
    assert packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(16)).count() >= 400

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._encoders)], pa.int64())], names=["n"])

    assert {r.n for r in spark.range(64).repartition(16).mapInArrow(kept, "n long").collect()} == {0}


def test_pieces_cover_every_document_once(spark, tokenizer):
    rng = random.Random(2)
    texts = [None, "", "one", "two words"]
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 900))) for _ in range(60)]
    texts.append("long " * 30000)
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(2, "one", 0, "x"), (None, "no id", 0, "x")]
    pieces = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    found, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4")
        assert p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    for i, own in found.items():
        times = sum(r[0] == i for r in rows)
        covered = sorted(x for p in own for x in range(p.start, p.start + p.length))
        assert covered == sorted(list(range(len(ids[i]))) * times)
    assert set(found) == set(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and len(own) <= 64
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_no_document_gives_no_piece(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_examples_keep_to_all_limits(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 400), rng.randint(0, 200), "x") for i in range(400)]
    rows += [(900, 3000, 10, "x"), (901, None, None, "x"), (902, 10, None, "x")]
    examples = spark.createDataFrame(rows, "example_id long, tokens int, loss_tokens int, offset string")
    placed = packing.pack_examples(examples.repartition(2), tokens=1024, segments=6, loss_tokens=256).collect()
    assert sorted(p.example_id for p in placed) == sorted(r[0] for r in rows if r[1])
    sequences = defaultdict(list)
    for p in placed:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        if own[0].example_id == 900:
            assert len(own) == 1
            continue
        assert sum(p.tokens for p in own) <= 1024 and len(own) <= 6 and sum(p.loss_tokens for p in own) <= 256
    loss = sum(r[2] or 0 for r in rows if r[1])
    assert len(sequences) <= 1.15 * max(loss / 256, 400 / 6) + 3


def test_the_packer_fills_what_a_dot_product_prefers():
    packer = packing.Packer((10, 3, 10), cut=False)
    for key, tokens, loss in (("a", 6, 1), ("b", 4, 1), ("c", 4, 9), ("d", 6, 1)):
        packer.add(key, tokens, loss)
    packer.pack()
    sequences = defaultdict(set)
    for key, _, _, _, sequence, _ in packer.take():
        sequences[sequence].add(key)
    assert len(sequences) == 2 and all(len(keys) == 2 for keys in sequences.values())
