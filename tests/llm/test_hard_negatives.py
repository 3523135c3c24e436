import math

import numpy as np
from pyspark.sql import functions as F

from cavitas.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, x string, block string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "b", "r") for i, v, k in rows], SCHEMA)


def brute_force(rows, every):
    kept = sorted({(i, k, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, k in rows if None not in (i, v, k) and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, k, q in kept:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j, other) for j, other, v in kept if len(v) == len(q)]
        positives = sorted((s, j) for s, j, other in scored if other == k and j != i)[:5]
        for s, j in positives:
            fits = sorted((t, m) for t, m, other in scored if other != k and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(fits, 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    for dims, spread in ((3, 1.0), (16, 0.3), (70, 0.1)):
        middle = rng.normal(size=(4, dims))
        rows = [(k, (middle[k % 4] + rng.normal(size=dims) * spread).tolist(), int(rng.integers(0, 3))) for k in range(220)]
        rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(0, 60, 5)]  # ties
        rows += [(5, rows[5][1], rows[5][2]), (5, rows[5][1], 2), (10, rows[11][1], rows[10][2])]  # repeats, ids of two rows
        rows += [(500, None, 1), (505, rows[1][1], None), (510, [float("nan")] * dims, 1), (515, [float("inf"), *rows[1][1][1:]], 1), (520, [None, *rows[1][1][1:]], 1), (None, rows[2][1], 1)]
        rows += [(600, [0.0] * dims, 1), (605, [0.5] * (dims + 1), 1), (610, [0.25] * (dims + 1), 1), (611, [0.24] * (dims + 1), 2), (615, [], 1), (616, [], 1), (617, [], 2), (620, [1.0] * 5, 9)]
        want = brute_force(rows, 5)
        assert len(want) > 100
        for block in (hn.BLOCK, 40):
            assert sorted(map(tuple, hn.hard_negatives(vectors(spark, rows), F.col("vec_id") % 5 == 0, block=block).collect())) == want


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(1)
    for dims in (1, 2, 64, 100):
        x = rng.integers(-300, 300, (400, dims))
        for centres in (np.zeros((1, dims)), x[:5] + 0.5):
            at, bits, along, left = hn.encode(x.astype(float), centres)
            side = hn.Side(np.arange(400), np.zeros(400, np.int64), x, at, np.ascontiguousarray(bits).view(np.uint64), along, left, centres)
            for q in (*x[:5], np.zeros(dims, np.int64)):
                low, high = side.bounds(q.astype(float), np.arange(400))
                assert (low <= x @ q).all() and (x @ q <= high).all()
                if dims > 2 and q.any():
                    assert np.median(high - low) < 2 * np.sqrt(q @ q) * np.median(np.sqrt((x * x).sum(axis=1)))


def test_intervals_leave_few_of_clustered_rows():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(8, 64))
    x = np.floor(256 * (middle[np.arange(4000) % 8] + rng.normal(size=(4000, 64)) * 0.05)).astype(np.int64)
    centres = np.floor(256 * middle)
    at, bits, along, left = hn.encode(x.astype(float), centres)
    side = hn.Side(np.arange(4000), np.zeros(4000, np.int64), x, at, bits.view(np.uint64), along, left, centres)
    low, high = side.bounds(x[0].astype(float), np.arange(4000))
    assert (high >= np.partition(low, -5)[-5]).sum() < 600


def test_empty(spark):
    for rows in ([], [(50, None, 1)], [(50, [1.0, 2.0], 1)]):
        out = hn.hard_negatives(vectors(spark, rows), F.col("vec_id") % 50 == 0)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0
