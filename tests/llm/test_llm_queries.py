"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

from pathlib import Path

import corpus_pipeline
import pyarrow as pa
import pytest
from oracle_check import connect, spark_rows, sql_rows
from tidecast.llm import line_dedup, mixing, toxicity
from tidecast.llm.oracle import ORACLES
from tidecast.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(connect(SF_DIR), ORACLES[name])


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.stage(step(spark, kept[-1], SF_DIR)))
        assert kept[-1].columns == columns, name
    raw, clean, lines, single, mixed = kept
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scores = toxicity.score(raw, toxicity.train(raw, labels))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.collect() if r.toxic_score < 0.7}

    # Lines: every earlier line within two edits, compared one with another.
    text = {r.doc_id: r.text for r in clean.collect()}
    seen, expected = [], {}
    for i in sorted(text):
        left = []
        for line in text[i].split("\n"):
            row = line.encode()
            near = [s for s in seen if abs(len(s) - len(row)) <= line_dedup.TAU]
            long = len(row) >= line_dedup.MIN_BYTES
            if not long or not line_dedup.within([row] * len(near), near, line_dedup.TAU).any():
                left.append(line)
            if long:
                seen.append(row)
        expected[i] = "\n".join(left)
    assert {r.doc_id: r.text for r in lines.collect()} == expected

    def shingles(t):
        words = t.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in expected.items()}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, low = max(label[a], label[b]), min(label[a], label[b])
                label = {i: low if x == old else x for i, x in label.items()}
    assert {r.doc_id for r in single.collect()} == {i for i in sets if label[i] == i}
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}
    assert mixed.count() == mixing.mix(single).count()

    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in mixed.collect()}
    assert sum(p.length for p in pieces if p.start == 0) > 0
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


def test_nothing_else_imports_the_package():
    root = Path(__file__).resolve().parent.parent.parent
    files = [f for f in (root / "tidecast").rglob("*.py") if "llm" not in f.parts]
    assert files and not any("tidecast.llm" in f.read_text() for f in files)


def test_stages_get_their_texts_in_small_batches(spark):
    """Long texts do not come ten thousand at a time; a limit that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(200).selectExpr("id doc_id", "repeat(uuid(), 2800) text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        corpus_pipeline.pack_sequences(spark, docs, SF_DIR)
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 200 * 100_000 and max(found) < 5 << 20
        spark.conf.set(name, "64m")
        corpus_pipeline.pack_sequences(spark, docs, SF_DIR)
        assert spark.conf.get(name) == "64m"
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)
