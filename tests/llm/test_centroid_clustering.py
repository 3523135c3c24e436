import hashlib
import math

import numpy as np

from cavitas.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<float>, label int, full string, cells string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "f", "c") for i, v in rows], SCHEMA)


def brute_force(rows, dims, k, rounds):
    """(vec_id, cluster, distance) of each vector that takes part, by comparing all, and the centroids."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            members = [v for (_, v), at in zip(kept, own, strict=True) if at == n]
            if members:
                centres[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), centres


def odd_rows(rng, n, dims, spread):
    rows = [(k, (rng.normal(size=dims) * spread).tolist()) for k in range(n)]
    rows += [(n + 1, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [0.0] * dims), (n + 2, [0.5] * dims), (None, rows[1][1])]  # ties, repeats, no id
    rows += [(n + 3, None), (n + 4, []), (n + 5, rows[0][1][:-1]), (n + 6, [float("nan")] + rows[0][1][1:]), (n + 7, [float("-inf")] + rows[0][1][1:]), (n + 8, [None] + rows[0][1][1:])]
    return rows + [(n + 9, [900.0] + rows[2][1][1:])]  # far beyond the cells of the sample


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(cc, "SAMPLE", 40)
    for n, dims, k, spread, bits in ((150, 5, 7, 0.3, 2), (60, 3, 16, 0.05, 6), (4, 4, 16, 1.0, 3)):
        rows = odd_rows(rng, n, dims, spread)
        found, centres = cc.clusters(vectors(spark, rows), dims=dims, k=k, bits=bits)
        want, expected = brute_force(rows, dims, k, 3)
        assert sorted(map(tuple, found.collect()), key=str) == want
        assert centres.tolist() == expected


def test_cells_hold_their_numbers():
    rng = np.random.default_rng(1)
    full = (rng.normal(size=(500, 6)) * [1, 5, 20, 100, 0, 3]).round().astype(np.int64)
    for bits in (1, 3, 6):
        cells = cc.Cells(full[:50], full.min(axis=0), full.max(axis=0), bits)
        cell = cells.unpack(cells.pack(full))
        dims = np.arange(6)
        assert (cells.low[dims, cell] <= full).all() and (full <= cells.high[dims, cell]).all()
        assert len(cells.pack(full)[0]) == -(-6 * bits // 8)
        centroids = full[:9]
        d = ((full[:, None] - centroids[None]) ** 2).sum(axis=2)
        near = cc.candidates(cell, cells.tables(centroids))
        assert all(d[r].argmin() in c for r, c in enumerate(near))


def test_full_vectors_are_fetched_only_where_needed(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(4, 16))
    rows = [(k, (middle[k % 4] + rng.normal(size=16) * 0.02).tolist()) for k in range(400)]
    whole = cc.whole_vectors(vectors(spark, rows), 16)
    packed, cells = cc.compressed(whole)
    now = np.floor(middle * 64).astype(np.int64)
    near = cc.near_centroids(packed, cells, now, now + 1)
    assert near.where("full IS NULL").count() > 350


def test_empty(spark):
    for rows in ([], [(1, None)]):
        found, centres = cc.clusters(vectors(spark, rows))
        assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == 0 and len(centres) == 0
