"""Clusters against plain integer arithmetic over all centroids."""

import hashlib

import numpy as np
from tidecast.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance long"


def expected(rows, count=40, rounds=5, width=64, scale=256):
    kept = [
        (i, [int(np.floor(scale * x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in kept[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(at)):
            own = [v for (_, v), c in zip(kept, of) if c == k]
            if own:
                at[k] = [sum(column) // len(own) for column in zip(*own)]
    last = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in last)
    return sorted(
        (
            i,
            k,
            d,
            sum(e for e, c in last if c == k),
            total,
            hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest(),
        )
        for (i, _), (d, k) in zip(kept, last)
    )


def found(spark, rows):
    table = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in centroids.cluster_vectors(table).collect())


def test_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(64) * 0.2).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(40)]  # ties and repeated vectors
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    ok = [0.25] * 64
    odd = [(None, ok), (1, None), (2, ok[:63]), (3, [*ok[:63], None]), (4, [*ok[:63], float("nan")]), (5, [*ok[:63], float("inf")])]
    assert found(spark, odd) == found(spark, []) == []
    few = [(6, ok), (6, [-0.001] * 64), (7, ok), (8, [1000.0] * 64)]
    assert found(spark, odd + few) == expected(few)
    assert found(spark, [(9, [1e6] * 64)]) == []  # its squared distance would not fit


def test_the_walk_stops_only_beyond_ties():
    rng = np.random.default_rng(3)
    at = rng.integers(-4, 5, (12, 6))
    at[7] = at[3]
    vectors = rng.integers(-5, 6, (3000, 6))
    squared = ((vectors[:, None] - at[None]) ** 2).sum(2)
    number, distance = centroids.Lists(at).nearest(vectors)
    assert (number == squared.argmin(1)).all() and (distance == squared.min(1)).all()
