"""Words one edit apart, against comparing every word with every other."""

import random
import re
import zlib
from collections import Counter

import pytest
from tidecast.llm import spelling

SCHEMA = "doc_id long, text string, n long, word string"


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def expected_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def expected(rows):
    n = expected_counts(rows)
    near = {a: [b for b in n if one_apart(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 10 * n[a] else None
    found = set()
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        found.add((a, form[a], root, n[a], len(near[a]), n[form[a]] if form[a] else None))
    return found


def found(spark, rows, parts=3):
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(parts)
    return {tuple(r) for r in spelling.spelling_forms(table).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 10))) for _ in range(25)]
    words = []
    for stem in stems:
        words += [stem] * rng.choice([2, 30, 400])
        for _ in range(6):
            k, letter = rng.randrange(len(stem) + 1), rng.choice("abÿéZ")
            edited = rng.choice([stem[:k] + stem[k + 1 :], stem[:k] + letter + stem[k:], stem[:k] + letter + stem[k + 1 :]])
            words += [edited] * rng.choice([1, 2, 25])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "\n", "ß1ßĀ"]).join(words[k : k + 40])) for i, k in enumerate(range(0, len(words), 40))]
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (3, "short words only"), (None, "nullable nullable NULLABLE nullables nullables")]
    rows += [(4, f"{long} {long[:-1]}c"), (5, f"{long} {long[:-1]}c"), (5, "Repeated repeated"), (6, "ÀÉÎÕÜÝÿ ÀÉÎÕÜÝÿ àéîõüýÿ")]
    rows += [(7, "x×÷x×÷x " * 2), (8, "aaaaaaaa " * 30 + "aaaaaaa " * 2 + "aaaaaaaaa " * 2)]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == set()


def test_a_hot_half_is_shared_by_many_words(spark):
    rng = random.Random(5)
    tails = {"".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)}
    rows = [(i, f"common{tail} {tail}nommoc") for i, tail in enumerate(sorted(tails))] * 2
    assert found(spark, rows) == expected(rows)
