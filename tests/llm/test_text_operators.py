"""Joins and removals over texts, against brute force on small tables with every awkward case."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidecast.llm import jaccard_join, line_dedup, meeting, mixing, suffix_dedup, textbytes

EXTRA = "doc_id long, text string, source string, sig long, label string, n_chars long"


def plain_words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def plain_set(text, k=5):
    words = plain_words(text)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def messy_texts():
    """Texts with copies, edited copies, shared passages, blank and odd ones, and a long one."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "日本", "The", "a b"]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = " ".join(words(30))
    base = words(80)
    texts = [None, "", "   \n\t ", "one two", "ONE  two", "\n\n", "x\u0000y z", " ".join(words(3000))]
    for _ in range(40):
        edited = list(base)
        for _ in range(rng.randint(0, 6)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        texts.append(" ".join(edited))
    for _ in range(12):
        lines = [" ".join(words(rng.randint(1, 12))) for _ in range(rng.randint(1, 5))]
        lines.insert(rng.randrange(len(lines) + 1), passage)
        texts.append(rng.choice(["\n", " "]).join(lines))
    texts += [texts[-1], texts[8], "b" * 49, "b" * 50, "b" * 120, "ab" * 60]
    line = "a line that is long enough to take part in it"
    texts += [line, line.replace("long", "lung"), line.replace("long", "l0ngs"), line + "!!", line + "\n" + line]
    return texts


@pytest.fixture(scope="module")
def messy(spark):
    texts = messy_texts()
    rows = [(3 * i % 97, t, "s", i, "l", i) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[9], None, 0, None, None)]
    return spark.createDataFrame(rows, EXTRA).repartition(5).cache()


def test_words_and_shingles_are_those_of_the_whole_texts():
    texts = messy_texts()
    seen = {}
    for limit in (100, 1 << 20):
        at = 0
        for first, last, data, offsets in textbytes.text_blocks(pa.array(texts, pa.string()), limit):
            assert first == at
            at = last
            hashes, starts = textbytes.word_hashes(data, offsets)
            grams, ends = textbytes.shingle_hashes(hashes, starts, 5)
            for i in range(last - first):
                words = plain_words(texts[first + i])
                assert starts[i + 1] - starts[i] == len(words)
                for word, value in zip(words, hashes[starts[i] : starts[i + 1]].tolist()):
                    assert seen.setdefault(word, value) == value
                assert len(set(grams[ends[i] : ends[i + 1]].tolist())) == len(plain_set(texts[first + i]))
        assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


def components(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_jaccard_components(messy):
    found = jaccard_join.jaccard_components(messy).collect()
    rows = [(r.doc_id, plain_set(r.text)) for r in messy.collect()]
    assert len(found) == len(rows)
    known = [(i, s) for i, s in rows if i is not None]
    links = [
        (a, b) for a, s in known for b, t in known if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)
    ]
    label = components(links, [i for i, _ in known])
    expected = sorted((i, len(s), label[i]) for i, s in known)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == expected
    (null,) = [r for r in found if r.doc_id is None]
    assert null.component_id is None and null.n_links == 0
    kept = jaccard_join.keep_one(messy)
    assert kept.columns == messy.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, low in label.items() if i == low}


def test_bands_leave_no_pair_out():
    """Every pair of sizes that may link meets in a band that has segments enough for its differences."""
    bands = jaccard_join.Bands(80, 2000)
    for low in range(1, 400):
        for high in range(low, low * 100 // 80 + 1):
            (band,) = bands.of(np.array([low]))
            assert bands.of(np.array([high]))[0] == band or high <= bands.guest[band]
            assert bands.differences(low, high) < bands.segments[band]


@pytest.mark.parametrize("suffixes", [100, suffix_dedup.SUFFIXES])
def test_removed_repeats(messy, suffixes):
    found = suffix_dedup.remove_repeats(messy, 50, texts=True, suffixes=suffixes).collect()
    rows = [(r.doc_id, (r.text or "").encode()) for r in messy.collect()]
    first = {}
    for i, raw in rows:
        for p in range(len(raw) - 49 if i is not None else 0):
            first[raw[p : p + 50]] = min(i, first.get(raw[p : p + 50], i))
    expected = []
    for i, raw in rows:
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 49 if i is not None else 0):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected.append((i or -1, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    result = [
        (r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found
    ]
    assert sorted(result) == sorted(expected)
    with pytest.raises(ValueError, match="24 to 128"):
        suffix_dedup.remove_repeats(messy, 10)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def edited(rng, raw, edits, letters=b"abcde"):
    out = bytearray(raw)
    for _ in range(edits):
        place, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4:
            out.insert(place, rng.choice(letters))
        elif place < len(out):
            if kind < 0.7:
                del out[place]
            else:
                out[place] = rng.choice(letters)
    return bytes(out)


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(3)
    left = [bytes(rng.choice(b"abc\x00") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    right = [edited(rng, a, rng.randint(0, 4)) for a in left]
    for tau in range(4):
        expected = [plain_distance(a, b) <= tau for a, b in zip(left, right)]
        assert line_dedup.within(left, right, tau).tolist() == expected


def test_near_lines_share_a_signature():
    rng = random.Random(4)
    for _ in range(300):
        tau = rng.choice([1, 2, 3])
        a = bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(6, 30)))
        b = edited(rng, a, tau)
        if a == b or min(len(a), len(b)) < tau + 2:
            continue
        column = pa.array([a.decode(), b.decode()])
        (_, _, data, offsets), *_ = textbytes.text_blocks(column)
        roles = {}
        for sig, node, role in zip(*(x.tolist() for x in line_dedup._signatures(data, offsets, tau, tau + 2))):
            own = roles.setdefault(sig, {})
            own[node] = own.get(node, 0) | role
        met = [set(own.values()) for own in roles.values() if len(own) == 2]
        assert any(np.bitwise_or.reduce(list(m)) == meeting.ROLES for m in met)


def test_removed_lines(messy):
    found = {r.doc_id: r for r in line_dedup.removed_lines(messy).collect()}
    rows = [(r.doc_id, r.text or "") for r in messy.collect() if r.doc_id is not None]
    lines = {(i, k): line.encode() for i, text in rows if text for k, line in enumerate(text.split("\n"))}
    gone = {}
    for place, line in lines.items():
        earlier = (other for at, other in lines.items() if at < place and abs(len(other) - len(line)) <= 2)
        if len(line) >= 24 and any(line_dedup.within([line], [other], 2)[0] for other in earlier):
            gone.setdefault(place[0], []).append(place[1])
    assert {i: r.removed for i, r in found.items() if r.removed} == {i: sorted(k) for i, k in gone.items()}
    kept = line_dedup.dedup_lines(messy)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    for r in kept.collect():
        if r.doc_id in gone:
            text = dict(rows)[r.doc_id].split("\n")
            left = [line for k, line in enumerate(text) if k not in gone[r.doc_id]]
            assert r.text == "\n".join(left) and r.n_chars == len(r.text)


def test_a_hot_signature_stays_small_and_whole(spark):
    """Thousands of variants of one text are compared with a hub, not with each other."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(1200):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    sets = [plain_set(t) for t in texts]
    links = [
        (a, b)
        for a in range(1200)
        for b in range(a + 1, 1200)
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    ]
    assert found == components(links, range(1200))


def test_hot_signatures_of_one_block_keep_all_their_nodes(spark):
    """Variants that differ at one place and lie in one block link with one another, none is left out."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join([*words[:40], f"n{i}", *words[40:]]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {0}
    letters = [chr(c) for c in (*range(65, 91), *range(97, 111))]
    lines = [f"a line with one letter {c} that differs and a long rest after it" for c in letters]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1)
    removed = {r.doc_id: r.removed for r in line_dedup.removed_lines(docs).collect()}
    gone = [i for i, a in enumerate(lines) if any(line_dedup.within([a.encode()], [b.encode()], 2)[0] for b in lines[:i])]
    assert gone == list(range(1, 40))
    assert removed == {i: [0] if i in gone else [] for i in range(40)}


@pytest.mark.parametrize("empty", ["", "   "])
def test_tables_without_texts(spark, empty):
    nothing = spark.createDataFrame([], EXTRA)
    blank = spark.createDataFrame([(1, empty, "s", 0, "", 0), (2, None, None, 0, "", 0)], EXTRA)
    if not empty:
        assert jaccard_join.jaccard_components(nothing).count() == 0
        assert suffix_dedup.remove_repeats(nothing).count() == 0
        assert line_dedup.dedup_lines(nothing).count() == 0
        assert mixing.mix(nothing).count() == mixing.mixed_documents(nothing).count() == 0
        return
    assert {tuple(r) for r in jaccard_join.jaccard_components(blank).collect()} == {(1, 0, 1, 0), (2, 0, 2, 0)}
    assert {r.n_removed for r in suffix_dedup.remove_repeats(blank).collect()} == {0}
    assert line_dedup.dedup_lines(blank).collect() == blank.collect()
    assert mixing.mix(blank).count() == mixing.mixed_documents(blank).count() == 2


def test_clusters_that_meet_a_common_hub_are_not_paired_member_by_member(spark, monkeypatch):
    """Two clusters of variants that share four fifths of their words: every variant meets the larger one's hub."""
    rng = random.Random(1)
    stem = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    mine, other = ([*stem[:320], *(f"{c}{rng.randrange(10**9)}" for _ in range(80))] for c in "ab")
    n, rows = 60, []
    for base, count in ((mine, n), (other, 2 * n)):
        for _ in range(count):
            words = list(base)
            words[rng.randrange(400)] = f"v{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    asked = []
    before = jaccard_join.compare
    monkeypatch.setattr(jaccard_join, "compare", lambda d, m, pairs, c: (asked.append(pairs.count()), before(d, m, pairs, c))[1])
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(asked) <= 12 * len(rows)

    def shingles(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = {i: shingles(text) for i, text in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, low = max(label[a], label[b]), min(label[a], label[b])
                label = {i: low if x == old else x for i, x in label.items()}
    assert {r.doc_id: r.component_id for r in found} == label


def test_only_shared_differences_from_a_hub_are_kept(spark, monkeypatch):
    """What one member alone has beyond the hub goes through one shuffle and no further."""
    rows = [
        (1, 2, False, 100, 40, [7, 8, 100]),
        (1, 3, False, 100, 40, [9, 8, 101]),
        (1, 4, True, 100, 10, [102, 103]),
        (1, 5, True, 100, 10, [103, 104]),
        (6, 7, False, 100, 40, [7, 105]),
    ]
    schema = "hub long, node long, linked boolean, size long, apart long, prefix array<long>"
    links = spark.createDataFrame([(1, 4), (1, 5)], "a long, b long")
    staged, before = [], jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df: (staged.append(before(df)), staged[-1])[1])
    pairs = jaccard_join._beside_hub(spark.createDataFrame(rows, schema), links, 80).collect()
    assert [tuple(r) for r in pairs] == [(2, 3)]
    kept = [r for df in staged if "element" in df.columns for r in df.select("hub", "node", "element").collect()]
    assert sorted(map(tuple, kept)) == [(1, 2, 8), (1, 3, 8)]


def test_meeting_rows_hold_two_numbers(spark):
    """Signatures that meet by the hundred in one block are spread, and one node goes for all."""
    sig = np.repeat(np.array([5 << 40, 6 << 40, 7 << 40], np.uint64), [100, 2, 1])
    node = np.arange(1, 104, dtype=np.int64) << 10
    batch = meeting.meeting_batch(sig, node, np.full(103, meeting.INDEX | meeting.PROBE))
    assert [f.type for f in batch.schema] == [pa.int64(), pa.int64()]
    assert meeting.MEETING == ", ".join(f"{name} long" for name in batch.schema.names)
    places = batch.column(0).to_pylist()
    assert max(map(places.count, places)) < 50
    met = meeting.met_rows(spark.createDataFrame(batch.to_pylist(), meeting.MEETING)).collect()
    assert {(r.sig, r.node) for r in met} == set(zip(sig[:102].tolist(), node[:102].tolist()))


def test_variants_of_a_text_that_none_of_them_is_are_not_paired_for_what_their_hub_lacks(spark, monkeypatch):
    """All variants share what the hub, a variant itself, has lost; only copies of a variant are near each other."""
    rng = random.Random(5)
    stem = [f"w{i}" for i in range(200)]

    def variant(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**9)}"
        return words

    bases = [variant(stem, 14) for _ in range(300)]
    texts = [" ".join(words) for words in [*bases, *(variant(words, 1) for words in bases[::10])]]
    asked = []
    before = jaccard_join.compare
    monkeypatch.setattr(jaccard_join, "compare", lambda d, m, pairs, c: (asked.append(pairs.count()), before(d, m, pairs, c))[1])
    # All variants meet one of them, and too few of many documents have a word of theirs for it to be frequent.
    monkeypatch.setattr(jaccard_join, "FREQUENT_KEPT", 0)
    node = (F.col("node") - F.col("node").bitwiseAND(meeting.ROLES)).alias("node")
    monkeypatch.setattr(jaccard_join, "met_rows", lambda rows: rows.select(F.lit(1).alias("sig"), node).distinct())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    sets = [plain_set(t) for t in texts]
    n = range(len(texts))
    links = [(a, b) for a in n for b in n if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert len(links) >= 30 and found == components(links, n)
    assert len(asked) == 2 and asked[1] <= 2 * len(texts)
