"""The toxicity chain and the language model: exact parts against brute force, the rest on held-out texts."""

import math
import random
from collections import Counter
from dataclasses import replace
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidecast.llm import lm, textbytes, toxicity

SCHEMA = "doc_id long, text string, toxic string, toxic_score string, row long"


def test_marginals_are_sums_over_all_paths():
    rng = np.random.default_rng(1)
    transitions, start = np.array([[0.8, 0.2], [0.4, 0.6]]), np.array([0.7, 0.3])
    ratio = rng.uniform(0.1, 5, 11)
    new = np.zeros(11, dtype=bool)
    new[[0, 4, 5]] = True
    found, pairs = toxicity.forward_backward(ratio, new, transitions, start, pairs=True)
    expected, moves = np.zeros(11), np.zeros((2, 2))
    for a, b in ((0, 4), (4, 5), (5, 11)):
        total, toxic, own = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in product((0, 1), repeat=b - a):
            weight, steps = start[path[0]] * ratio[a] ** path[0], np.zeros((2, 2))
            for k in range(1, b - a):
                weight *= transitions[path[k - 1], path[k]] * ratio[a + k] ** path[k]
                steps[path[k - 1], path[k]] += 1
            total, toxic, own = total + weight, toxic + weight * np.array(path), own + weight * steps
        expected[a:b], moves = toxic / total, moves + own / total
    assert np.allclose(found, expected) and np.allclose(pairs, moves)
    assert toxicity.forward_backward(ratio[:0], new[:0], transitions, start)[0].size == 0


def labelled(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(2, 5) * toxic):
            insult = rng.choice(["idiot", "Scum!", "zzvex" + rng.choice("abcdefgh") * 2])
            text.insert(rng.randrange(len(text)), insult)
        rows.append((i, " ".join(text), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = labelled(1, 500)
    return toxicity.fit([t for _, t, _ in rows], [y for *_, y in rows])


def test_held_out_documents_are_told_apart(spark, model):
    rows = labelled(2, 300)
    docs = spark.createDataFrame([(i, t, "x", "own", 0) for i, t, _ in rows], SCHEMA).repartition(3)
    found = {r.doc_id: r for r in toxicity.score(docs, model, "score").collect()}
    predicted = {i: found[i].score >= 0.7 for i, *_ in rows}
    assert sum(predicted[i] == bool(y) for i, _, y in rows) >= 0.98 * len(rows)
    assert {r.toxic_score for r in found.values()} == {"own"}
    hits = total = 0
    for i, text, _ in rows:
        spans = {text[s.start : s.end].lower() for s in found[i].toxic_spans}
        wanted = {w.strip("!").lower() for w in text.split() if not w.startswith("w")}
        total += len(wanted)
        hits += len({w for w in wanted if any(w in s for s in spans)})
        assert all(0 <= s.start < s.end <= len(text) and 0.5 <= s.probability <= 1 for s in found[i].toxic_spans)
    assert hits >= 0.9 * total
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, bad in predicted.items() if not bad}


def test_offsets_are_characters_and_odd_texts_score(spark, model):
    texts = [None, "", "  \n", "é日本 idiot ü", "IDIOT!!", "idiot " * 20000, "!" * 50000]
    docs = spark.createDataFrame([(i, t, "x", "own", 0) for i, t in enumerate(texts)] + [(None, "ok", "", "", 0)] * 2, SCHEMA)
    rows = toxicity.score(docs, model, "s", "spans").collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and all(0 <= r.s <= 1 for r in rows)
    assert [(s.start, s.end) for s in found[3].spans] == [(4, 9)]
    assert found[0].s == found[1].s == found[2].s == found[6].s and found[0].s < 0.5 and not found[0].spans
    assert found[4].spans and found[5].s >= 0.7
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_training_needs_both_classes_and_consistent_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (None, 1), (9, 1), (1, None)], "doc_id long, toxic int")
    assert [r.text for r in toxicity.sample(docs, labels).collect()] == ["a"]
    low = toxicity.train(docs, labels)
    assert all(r.toxic_score < 0.5 for r in toxicity.score(docs, low).collect())


@pytest.mark.parametrize("long_class", [0, 1])
def test_a_long_text_does_not_end_the_sample(spark, long_class):
    rows = labelled(3, 400)
    order = [r.id for r in spark.range(1000).orderBy(F.xxhash64("id"), "id").limit(401).collect()]
    long_text = "".join(f"w{k % 500} " + "idiot " * (long_class and k % 50 == 0) for k in range(640_000))
    assert len(long_text) > 3_000_000
    table = [(order[0], long_text, long_class)] + [(i, t, y) for i, (_, t, y) in zip(order[1:], rows)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in table], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in table], "doc_id long, toxic int")
    taken = [(r.text, r.toxic) for r in toxicity.sample(docs, labels).collect()]
    assert set(taken) >= {(t, y) for _, t, y in table[1:]} and len(taken) == len(table)
    (windows,) = [t for t, _ in taken if len(t) > 10_000]
    assert len(windows) <= toxicity.LONG_BYTES + toxicity.WINDOWS
    assert windows.startswith(long_text[:1000]) and windows.endswith(long_text[-1000:])
    model = toxicity.train(docs, labels)
    kept = {r.doc_id for r in toxicity.reject(docs, model).collect()}
    assert sum((i in kept) != bool(y) for i, _, y in table) >= 0.98 * len(table)


def language(seed, n, words, length):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"{'xyz'[i % 3]}{k}" for k in range(words)]
        rows.append((i, " ".join(own[min(int(rng.expovariate(0.05)), words - 1)] for _ in range(rng.randint(0, length)))))
    return rows


def test_scores_of_a_language_model(spark):
    rows = language(1, 240, 300, 120)
    rows += [(900, None), (901, ""), (902, "never-seen words here"), (903, "X1\n\tx1 " * 3000), (None, "x1 y2"), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "x", "own", 0) for i, t in rows], SCHEMA).repartition(4)
    learnt = lm.learnt_from(F.col("doc_id"))
    train = {r.doc_id for r in docs.filter(learnt).collect()}
    model, counts = lm.train(docs, learnt)
    found = [tuple(r) for r in lm.score(docs, model, counts).collect()]
    assert len(found) == len(rows)

    def tokens(text):
        return [*(text or "").lower().split(), None]

    seen = Counter()
    for i, text in rows:
        if i in train:
            seen.update(tokens(text))
    total, types = sum(seen.values()), len(seen)
    assert (model.tokens, model.types) == (total, types)
    expected = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (types + 1))) for t in own)
        expected.append((i or -1, len(own), sum(seen[t] > 0 for t in own), round(base, 6)))
    assert sorted((i or -1, n, k, round(b, 6)) for i, n, k, b, _ in found) == sorted(expected)
    held_out = [(b, s) for i, _, _, b, s in found if i is not None and i < 900 and i not in train]
    assert sum(s for _, s in held_out) > 0.9 * sum(b for b, _ in held_out)  # log probabilities are negative

    # A score by its definition, token by token, over all words that there are.
    text, tables = rows[4][1], model.tables
    hashes, ending, first = lm._block_words(*list(textbytes.text_blocks(pa.array([text])))[0][2:])
    units = [lm.END] * 3 + model.lexicon.unit(hashes, ending).tolist() + [lm.END]
    score = 0.0
    for at, token in enumerate(tokens(text), start=3):
        before = [tables.classes[units[at - k]] for k in (1, 2, 3)]
        label, outcome = tables.classes[units[at]], tables.outcomes[units[at]]
        by_class = tables.log_class[(before[0] * lm.CLASSES + before[1]) * lm.CLASSES + before[2]].astype(float)
        inner = tables.log_inner[label].astype(float)
        for feature in lm._word_features(np.array(units), np.array([at])):
            by_class = by_class + tables.class_words[lm._rows(feature, len(tables.class_words))[0]]
            row = lm._rows(feature + np.uint64(label + 1), len(tables.inner_words))[0]
            inner = inner + tables.inner_words[row]
        score += by_class[label] - np.logaddexp.reduce(by_class) + inner[outcome] - np.logaddexp.reduce(inner)
        if outcome == lm.OUTCOMES - 1:
            score += math.log(seen[token] + 0.5) - model.log_rest[label] * math.log(10)
    assert next(s for i, *_, s in found if i == 4) == pytest.approx(score / math.log(10), rel=1e-4)
    # The shares of a class sum to one: its own outcomes, and a rest of known words and one unknown.
    assert np.allclose(np.exp(tables.log_inner.astype(float)).sum(axis=1), 1, atol=1e-4)
    for label in range(1, lm.CLASSES):
        mine = [
            seen[t] + 0.5
            for t in seen
            if t is not None
            for h, e, _ in [lm._block_words(*list(textbytes.text_blocks(pa.array([t])))[0][2:])]
            for u in model.lexicon.unit(h, e)
            if tables.classes[u] == label and tables.outcomes[u] == lm.OUTCOMES - 1
        ]
        assert sum(mine) + 0.5 == pytest.approx(10 ** model.log_rest[label])


def test_word_order_tells_texts_apart(spark):
    """Words that go in pairs: a text in order scores better than its words shuffled, unlike by classes alone."""
    rng = random.Random(3)
    pairs = [(f"a{k}", f"b{k}") for k in range(40)]
    rows = [(i, " ".join(w for _ in range(60) for w in rng.choice(pairs))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learnt = lm.learnt_from(F.col("doc_id"))
    model, counts = lm.train(docs, learnt)
    held_out = [r.doc_id for r in docs.filter(~learnt).collect()]
    texts = dict(rows)
    firsts = {i: texts[i].split()[::2] for i in held_out}
    seconds = {i: texts[i].split()[1::2] for i in held_out}
    mixed = {i: rng.sample(seconds[i], len(seconds[i])) for i in held_out}
    other = [(i, " ".join(w for pair in zip(firsts[i], mixed[i]) for w in pair)) for i in held_out]
    asked = spark.createDataFrame([(i, texts[i]) for i in held_out], "doc_id long, text string")
    shuffled = spark.createDataFrame(other, "doc_id long, text string")
    blank = replace(model.tables, class_words=0 * model.tables.class_words, inner_words=0 * model.tables.inner_words)

    def total(docs, model):
        got = lm.score(docs, model, counts).collect()
        return sum(r.score for r in got), sum(r.base_score for r in got)

    ordered, base = total(asked, model)
    assert ordered > 0.8 * base and ordered > 0.9 * total(asked, replace(model, tables=blank))[0]
    assert ordered > 0.9 * total(shuffled, model)[0]


def test_a_language_model_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model, counts = lm.train(docs, lm.learnt_from(F.col("doc_id")))
    assert lm.score(docs, model, counts).count() == 0
    other = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm.score(other, model, counts).collect()
    assert {(r.n_tokens, r.n_known) for r in rows} == {(3, 0), (1, 0)} and all(np.isfinite(r.score) for r in rows)


def test_words_are_found_by_their_leading_bits():
    rng = np.random.default_rng(3)
    asked = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    asked[:4] = 0, 1, 2**64 - 2, 2**64 - 1
    for known in (asked[:0], asked[:1], asked[3:4], asked[:2500], asked[1000:1004] | np.uint64(2**63)):
        known = np.unique(known)
        lexicon = lm.Lexicon(known, np.ones(known.size, np.int64), np.arange(known.size))
        places = {h: i for i, h in enumerate(known.tolist())}
        assert lexicon.find(asked).tolist() == [places.get(h, -1) for h in asked.tolist()]
        # Words that begin alike are told apart, too.
        assert not known.size or lexicon.heads.size == 1 << lm.LEADING
    crowd = np.arange(300, dtype=np.uint64) * np.uint64(2)
    lexicon = lm.Lexicon(crowd, np.ones(300, np.int64), np.arange(300))
    assert lexicon.find(np.arange(601, dtype=np.uint64)).tolist() == [k // 2 if k % 2 == 0 and k < 600 else -1 for k in range(601)]


def test_classes_are_chosen_from_the_units_alone(spark, monkeypatch):
    """Neighbours are counted in the table of units: texts are not read and hashed once more for them."""
    tables = []
    monkeypatch.setattr(lm, "_cluster", lambda table, k: (tables.append(table), np.zeros(len(table), np.int64))[1])
    sequences = [[], [5, 40, 3], [7], [3, 3, 4100, 31, 32]]
    rows = spark.createDataFrame([(s,) for s in sequences], "units array<short>")
    assert (lm._classes(rows) == 1).all()
    wanted = np.zeros_like(tables[0])
    for units in sequences:
        for a, b in zip(units, units[1:]):
            if a < lm.NEIGHBOURS:
                wanted[b, a] += 1
            if b < lm.NEIGHBOURS:
                wanted[a, lm.NEIGHBOURS + b] += 1
    assert (tables[0] == wanted).all()
