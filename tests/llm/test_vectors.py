"""Vector searches against brute force."""

import numpy as np
import pytest
from tidecast.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(700, 24)) * rng.uniform(0.1, 4, size=(700, 1))
    rows[:60] = rows[60] + rng.normal(size=(60, 24)) * 0.01
    rows[100:140] = rows[100]
    listed = [(i, [float(x) for x in np.float32(v)], 0, "s", 1) for i, v in enumerate(rows)]
    listed += [
        (700, None, 0, "s", 1),
        (750, [], 0, "s", 1),
        (800, [0.0] * 24, 0, "s", 1),
        (850, [float("nan")] + [1.0] * 23, 0, "s", 1),
        (900, [float("inf")] + [1.0] * 23, 0, "s", 1),
        (950, [None] + [1.0] * 23, 0, "s", 1),
        (1000, [1.0, 2.0], 0, "s", 1),
        (None, [1.0] * 24, 0, "s", 1),
        listed[3],
        listed[50],
    ]
    return spark.createDataFrame(listed, SCHEMA).repartition(4).cache()


def stored(table):
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in vectors_of(table)}
    return np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])


def vectors_of(table):
    for r in table.collect():
        v = r.embedding
        if r.vec_id is not None and v and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v):
            yield r


def ranks(found):
    result = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        result.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(result[r.query_id])
    return result


def test_nearest_by_cosine(table):
    found = ranks(ann.nearest(table.filter("vec_id % 50 = 0"), table, 5).collect())
    ids, rows = stored(table)
    ids, rows = ids[np.abs(rows).sum(axis=1) > 0], rows[np.abs(rows).sum(axis=1) > 0]
    norms = np.sqrt((rows * rows).sum(axis=1))
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for query, own in found.items():
        at = int(np.flatnonzero(ids == query)[0])
        cosine = rows @ rows[at] / (norms * norms[at])
        cosine[at] = -2
        best = [ids[k] for k in np.lexsort((ids, -np.round(cosine, 12)))[:5]]
        hits += len(set(best) & {i for i, _ in own})
        for i, score in own:
            assert score == pytest.approx(cosine[ids == i][0], abs=1e-12)
    assert hits >= 0.9 * 5 * len(found)


def test_largest_products(table):
    found = ranks(topk.largest_products(table.filter("vec_id % 100 = 0"), table, 10).collect())
    ids, rows = stored(table)
    whole = np.floor(rows * 1024).astype(np.int64)
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    for query, own in found.items():
        others = ids != query
        scores = whole[others] @ whole[ids == query][0]
        best = np.lexsort((ids[others], -scores))[:10]
        assert own == list(zip(ids[others][best].tolist(), scores[best].tolist()))


def test_fewer_candidates_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 0), (7, [1.0, 1.0], 0, "", 0)], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in ann.nearest(two.filter("vec_id = 0"), two).collect()] == [(0, 7)]
    assert [r.score for r in topk.largest_products(two.filter("vec_id = 0"), two).collect()] == [1024 * 1024]
    nothing = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(nothing, nothing).count() == 0
    assert topk.largest_products(nothing, nothing).count() == 0


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(2)
    rows, queries = rng.normal(size=(400, 70)), rng.normal(size=(50, 70))
    middle = ann._units(rows).mean(axis=0)
    apart = ann._units(rows) - middle
    distance = np.sqrt((apart * apart).sum(axis=1))
    turned = apart / distance[:, None] @ ann._rotation(70)
    own = np.abs(turned).sum(axis=1) / np.sqrt(70)
    asked = ann._Queries(queries, middle)
    cosine, wide = asked.estimates(ann._packed(turned >= 0), distance, own, ann._units(rows) @ middle)
    exact = ann._units(queries) @ ann._units(rows).T
    assert (np.abs(cosine - exact) <= wide).mean() > 0.98
    assert np.abs(cosine - exact).mean() < 0.15


def test_top_keeps_ties_by_id():
    best = vectors.TopK(1, 3)
    best.add(0, np.array([1.0, 1.0, 2.0]), np.array([9, 4, 7]))
    best.add(0, np.array([1.0, 2.0]), np.array([2, 7]))
    assert best.ids[0].tolist() == [7, 2, 4] and best.threshold[0] == 1.0
