"""The mix against its definition, computed plainly."""

import math
from collections import defaultdict

from pyspark.sql import functions as F
from tidecast.llm import mixing

SCHEMA = "doc_id long, text string, source string, block int, use string"


def documents(spark):
    rows, i = [], 0
    for source, count in (("big", 300), ("mid", 60), ("small", 12), (None, 3)):
        for _ in range(count):
            rows.append((i, " ".join(["w"] * (i % 17)), source, i, "u"))
            i += 1
    return spark.createDataFrame(rows + [rows[5]], SCHEMA).repartition(4)


def even(tokens, a):
    total = sum(tokens)
    powers = [(t / total) ** a for t in tokens]
    shares = [p / sum(powers) for p in powers]
    return -sum(s * math.log(s) for s in shares) / math.log(len(tokens))


def test_the_exponent_meets_the_targets(spark):
    tokens = [1000, 100, 40, 40]
    totals = spark.createDataFrame([(str(i), t) for i, t in enumerate(tokens)], "source string, tokens long")
    a = mixing.exponent(totals, mixing.Target(entropy=0.9, repetition=1e9))
    assert even(tokens, a) >= 0.9 - 1e-4 and even(tokens, a + 2e-4) < 0.9
    a = mixing.exponent(totals, mixing.Target(entropy=1.0, repetition=2.0))
    assert (1000 / 40) ** (1 - a) <= 2.0 + 1e-3 and (1000 / 40) ** (1 - a + 2e-4) > 2.0
    assert mixing.exponent(totals, mixing.Target(entropy=0.1, repetition=1e9)) == 1.0
    assert mixing.exponent(totals.filter("tokens < 0"), mixing.Target()) == 1.0


def test_budgets_become_runs_without_gaps(spark):
    docs = documents(spark)
    target = mixing.Target(entropy=0.95, repetition=3.0, block_tokens=200)
    rows = mixing.mix(docs, target).collect()
    budget = {r.source: r for r in mixing.budgets(mixing.counted(docs), target).collect()}
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
    for source, uses in sources.items():
        at, blocks = 0, []
        for r in sorted(uses, key=lambda r: (r.start, r.n_tokens)):
            assert r.start == at
            at += r.n_tokens
            if r.n_tokens and (not blocks or blocks[-1] != (r.epoch, r.block)):
                blocks.append((r.epoch, r.block))
        assert len(blocks) == len(set(blocks))  # a block is visited once an epoch
        assert 0 <= at - budget[source].budget < 17
        # Epochs before the last one use every document.
        assert sum(r.epoch == 0 for r in uses) == docs.filter(F.coalesce("source", F.lit("")) == source).count()
    orders = {e: [r.doc_id for r in sorted(sources["small"], key=lambda r: r.start) if r.epoch == e] for e in (0, 1)}
    assert orders[0] != orders[1]


def test_mixed_documents_are_the_uses(spark):
    docs = documents(spark)
    target = mixing.Target(entropy=0.95, repetition=3.0, block_tokens=200)
    mixed = mixing.mixed_documents(docs, target)
    assert mixed.columns == docs.columns
    uses, given = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs, target).collect():
        uses[r.doc_id] += 1
    for r in mixed.collect():
        given[r.doc_id] += 1
    assert {i: n for i, n in uses.items() if i != 5} == {i: n for i, n in given.items() if i != 5}
    assert given[5] in (uses[5], uses[5] + 1)  # a repeated id may lie on the border
    assert set(given) == {r.doc_id for r in docs.collect()}


def test_a_smaller_budget_is_kept(spark):
    docs = documents(spark)
    rows = mixing.mix(docs, mixing.Target(budget=500, block_tokens=200)).collect()
    assert 500 <= sum(r.n_tokens for r in rows) <= 500 + 4 * 17
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
