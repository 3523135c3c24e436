import collections
import itertools
import random
import time
import tracemalloc

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from cavitas.functions import metrics
from cavitas.operators import cluster, delaunay, geometry, joins, linkage
from cavitas.operators.graph import bfs_depth, connected_components

SIX = [(-1, 2, 0), (0, 2, 1), (1, -2, 1), (0, 1, 1), (0, 0, 0), (-1, -1, 0)]
KEYS = ("system_id", "structure_index")


def frame(spark, xyz, system="a"):
    return spark.createDataFrame([(system, 0, i, *map(float, p)) for i, p in enumerate(xyz)], "system_id string, structure_index int, point_index long, x double, y double, z double")


def brute_spheres(x):
    found = {}
    for q in itertools.combinations(range(len(x)), 4):
        c, r2, det = geometry.circumspheres(x[list(q)][None])
        if abs(det[0]) < 1e-10:
            continue
        d = np.linalg.norm(x - c[0], axis=1)
        r = np.sqrt(r2[0])
        if (d >= r - 1e-7 * max(r, 1)).all():
            found[tuple(np.flatnonzero(d <= r + 1e-7 * max(r, 1)).tolist())] = (c[0], r)
    return found


def test_six_points(spark):
    got = geometry.alpha_spheres(frame(spark, SIX))
    want = {(1, 2, 3, 4): (6.5, 1.5, -0.5, 6.68954408), (2, 3, 4, 5): (-0.25, -0.75, 1.75, 1.92028644), (0, 1, 3, 4): (0.5, 1.5, -0.5, 1.6583124), (0, 3, 4, 5): (-1.5, 0.5, 0.5, 1.6583124)}
    rows = {tuple(r.contacts): (r.cx, r.cy, r.cz, r.radius) for r in got.collect()}
    assert rows.keys() == want.keys() and all(np.allclose(rows[k], want[k]) for k in want)
    small = geometry.radius_band(got, None, "5.0 angstroms")
    assert small.count() == 3 and [round(r.radius, 6) for r in geometry.radius_band(small, 1.66).collect()] == [1.920286]
    two = got.where(F.array_contains("contacts", 5))
    assert geometry.contacts_union(two).first().contacts == [0, 2, 3, 4, 5]
    kept = geometry.without_spheres(got, two)
    assert kept.count() == 2 and geometry.surrounded(got, frame(spark, SIX).where("point_index <> 2")).count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_spheres_against_all_quadruples(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((18, 3)) if seed < 4 else np.array(list(itertools.product(range(3), range(2), range(2 + seed % 2))), float)
    got = {tuple(c): (m, r) for m, r, c in geometry.empty_spheres(x)}
    want = brute_spheres(x)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k][0], want[k][0], atol=1e-6) and np.isclose(got[k][1], want[k][1]) for k in got)


def test_large_structure_is_empty_inside():
    rng = np.random.default_rng(3)
    x = rng.random((1200, 3)) * 30
    found = geometry.empty_spheres(x)
    assert len(found) > 5000
    for centre, radius, contacts in found[::97]:
        d = np.linalg.norm(x - centre, axis=1)
        assert (d >= radius * (1 - 1e-7)).all() and np.allclose(d[contacts], radius)


def test_grids_and_spheres_of_many_points():
    grid = np.array(list(itertools.product(range(6), repeat=3)), float)
    found = geometry.empty_spheres(grid)
    assert len(found) == 125 and all(len(c) == 8 and np.isclose(r, 0.75**0.5) for _, r, c in found)
    for seed in range(6):
        x = np.random.default_rng(seed).integers(0, 4, (20, 3)).astype(float)
        assert {tuple(c) for *_, c in geometry.empty_spheres(x)} == set(brute_spheres(x))
    ring = np.array([[np.cos(t), np.sin(t), z] for t in np.linspace(0, 6, 12) for z in (-0.5, 0.5)] + [[0, 0, 0.1]])
    assert {tuple(c) for *_, c in geometry.empty_spheres(ring)} == set(brute_spheres(ring))


def test_time_follows_the_number_of_points():
    took = []
    for n in (2000, 8000):
        x = np.random.default_rng(0).random((n, 3)) * 50
        begin = time.perf_counter()
        assert len(geometry.empty_spheres(x)) > 6 * n
        took.append(time.perf_counter() - begin)
    assert took[1] < 7 * took[0] and took[1] < 40, took


def test_neighbours_of_the_mesh_and_empty_tetrahedra():
    x = np.random.default_rng(4).random((300, 3))
    cells, near = delaunay.tetrahedra(x)
    for t in range(0, len(cells), 7):
        for k, u in enumerate(near[t].tolist()):
            if u >= 0:
                assert set(np.delete(cells[t], k).tolist()) <= set(cells[u].tolist()) and t in near[u]
    centre, r2, _ = geometry.circumspheres(x[cells])
    assert (((x[None] - centre[:, None]) ** 2).sum(axis=2).min(axis=1) > r2 * (1 - 1e-6)).all()


def test_blocks_equal_the_whole(spark):
    """A structure in many blocks gives the spheres of the whole up to the radius: ragged density, a grid with centres on borders, two structures."""
    rng = np.random.default_rng(5)
    dense = np.concatenate([rng.random((500, 3)) * 20, rng.random((200, 3)) * 3, rng.random((60, 3)) * 20 + 40])
    grid = np.array(list(itertools.product(range(8), range(6), range(5))), float)
    points = frame(spark, dense).unionByName(frame(spark, grid, "b")).unionByName(frame(spark, [(0, 0, 0), (None, 1, 1)][:1], "c"))
    whole = {(r.system_id, tuple(r.contacts)): (r.cx, r.cy, r.cz, r.radius) for r in geometry.radius_band(geometry.alpha_spheres(points), None, 1.6).collect()}
    parts = geometry.alpha_spheres(points, max_radius=1.6, block_points=60)
    got = {(r.system_id, tuple(r.contacts)): (r.cx, r.cy, r.cz, r.radius) for r in parts.collect()}
    assert len(got) == parts.count() > 1000 and got.keys() == whole.keys()
    assert all(np.allclose(got[k], whole[k]) for k in got)
    for system in "ab":
        ids = [(r.contacts, r.sphere_id) for r in parts.where(F.col("system_id") == system).collect()]
        assert [k for _, k in sorted(ids)] == list(range(len(ids)))


def test_few_repeated_flat_and_null_points(spark):
    assert geometry.alpha_spheres(frame(spark, SIX[:3])).count() == 0
    assert geometry.alpha_spheres(frame(spark, [])).count() == 0
    assert geometry.empty_spheres(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0], [2, 3, 0]], float)) == []
    assert geometry.alpha_spheres(frame(spark, SIX).withColumn("x", F.when(F.col("point_index") != 2, F.col("x")))).count() == len(brute_spheres(np.array(SIX, float)[[0, 1, 3, 4, 5]]))
    again = np.array([*SIX, SIX[0]], float)
    assert {tuple(c) for *_, c in geometry.empty_spheres(again)} == set(brute_spheres(again))


def test_neighbours_are_symmetric(spark):
    spheres = geometry.alpha_spheres(frame(spark, np.random.default_rng(1).random((12, 3))))
    own = {r.sphere_id: set(r.contacts) for r in spheres.collect()}
    for criterion, least in joins.CRITERIA.items():
        got = {(r.i, r.j, r.n_shared) for r in joins.sphere_neighbors(spheres, criterion, mirrored=True).collect()}
        assert got == {(i, j, n) for i in own for j in own if i != j and (n := len(own[i] & own[j])) >= least}
    with pytest.raises(ValueError):
        joins.sphere_neighbors(spheres, "corner")


def test_distance_joins(spark):
    x = np.random.default_rng(2).random((60, 3)) * 2 - 1
    table = frame(spark, x)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert {(r.i, r.j) for r in joins.distance_pairs(table, 0.4).collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 0.4}
    c = x - x.mean(axis=1, keepdims=True)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    got = {(r.i, r.j) for r in joins.distance_pairs(frame(spark, [*x, (2, 2, 2)]), 0.1, metric="c").collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if 1 - c[i] @ c[j] <= 0.1}
    touching = frame(spark, [(0, 0, 0), (1, 0, 0), (3, 0, 0)])
    assert joins.distance_pairs(touching, 1.0).count() == 1
    plan = joins.distance_pairs(table, 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("metric", ["e", "b", "c"])
def test_crowded_cells_meet_in_blocks(spark, monkeypatch, metric):
    """A cell of 150 points, 100 of them in one place: no key of the join has over 20 rows of the side that a task holds."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile([0.31, 0.12, 0.57], (100, 1)), rng.random((50, 3)) * 0.1 + 0.3, rng.random((80, 3)) * 2 - 1])
    sets, block = {"e": 0.3, "b": 0.3, "c": 0.05}, joins.BLOCK
    monkeypatch.setattr(joins, "BLOCK", 20)
    pairs = joins.distance_pairs(frame(spark, x), sets[metric], metric=metric)
    assert "__block" in pairs._jdf.queryExecution().optimizedPlan().toString()
    centred = x - x.mean(axis=1, keepdims=True)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    apart = {"e": np.linalg.norm(x[:, None] - x[None], axis=2), "b": np.abs(x[:, None] - x[None]).sum(axis=2), "c": 1 - centred @ centred.T}[metric]
    got = [(r.i, r.j) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if apart[i, j] <= sets[metric]}
    monkeypatch.setattr(joins, "BLOCK", block)
    assert len(got) == joins.distance_pairs(frame(spark, x), sets[metric], metric=metric).count()


def test_crowded_city_blocks_look_into_fewer_cells(spark, monkeypatch):
    """Points on a lattice of halves of the radius, where pairs just at the radius lie in far cells: 41 of the 63 cells do."""
    monkeypatch.setattr(joins, "BLOCK", 2)
    x = np.array(list(itertools.product(range(5), repeat=3))) * 0.125
    pairs = joins.distance_pairs(frame(spark, x), 0.25, metric="b")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Generate explode([")[1].split("])")[0].count("[") == 41
    apart = np.abs(x[:, None] - x[None]).sum(axis=2)
    assert {(r.i, r.j) for r in pairs.collect()} == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if apart[i, j] <= 0.25}


def test_ids_that_repeat_or_are_missing_pair_as_in_sql(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 0.5), (None, 0.9)], "point_index long, x double")
    rows = rows.select(F.lit(0).alias("system_id"), F.lit(0).alias("structure_index"), "*", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert sorted((r.i, r.j, r.distance) for r in joins.distance_pairs(rows, 1.0).collect()) == [(1, 2, 0.5), (1, 2, 0.5)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 1), (9, 8), (8, 10), (10, 11), (11, 12)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b", nodes=spark.createDataFrame([(6,), (1,)], "node long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in connected_components(chain, "a", "b").collect()} == {0}
    assert connected_components(edges.where("a > 99"), "a", "b").count() == 0
    assert {(r.node, r.depth) for r in bfs_depth(edges, 9, "a", "b").collect()} == {(9, 0), (8, 1), (10, 2), (11, 3), (12, 4)}


def naive_clusters(x, cut, method, metric):
    clusters = [[i] for i in range(len(x))]
    base = plain.distances(x, metric)
    height = {i: 0.0 for i in range(len(x))}
    trees = [(0.0, [i], ()) for i in range(len(x))]

    def gap(a, b):
        pairs = [base[i, j] for i in a for j in b]
        if method == "centroid":
            return np.linalg.norm(x[a].mean(axis=0) - x[b].mean(axis=0))
        return {"complete": max, "average": np.mean, "single": min}[method](pairs)

    while len(trees) > 1:
        h, i, j = min((gap(trees[i][1], trees[j][1]), i, j) for i in range(len(trees)) for j in range(i + 1, len(trees)))
        a, b = trees[i], trees[j]
        trees = [t for k, t in enumerate(trees) if k not in (i, j)] + [(max(h, a[0], b[0]), a[1] + b[1], (a, b))]
    del clusters, height

    def split(t):
        return [sorted(t[1])] if t[0] <= cut else [c for s in t[2] for c in split(s)]

    return sorted(split(trees[0]))


@pytest.mark.parametrize(("method", "metric"), [("m", "e"), ("a", "e"), ("c", "e"), ("a", "b"), ("s", "e"), ("s", "b"), ("m", "c")])
def test_hierarchical(spark, method, metric):
    x = np.random.default_rng(5).random((25, 3))
    got = cluster.hierarchical(frame(spark, x), 0.35, "point_index", "xyz", KEYS, method, metric)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.component, []).append(r.node)
    assert sorted(map(sorted, groups.values())) == naive_clusters(x, 0.35, cluster.LINKAGES[method], metric)
    assert all(min(v) == k for k, v in groups.items())


def linked(x, cut, method, metric="e"):
    return linkage.by_centroids(x, cut) if method == "centroid" else linkage.by_links(x, cut, method, metric)


def test_linkage_equals_the_matrix_form():
    """Random points, a grid with many ties, centroids that come nearer by merging, rows without numbers."""
    rng = np.random.default_rng(8)
    grid = np.array(list(itertools.product(range(4), range(3), range(2))), float)
    for x, cuts in ((grid, (0.9, 1.0, 1.2, 1.9)), (rng.random((120, 3)), (0.1, 0.2, 0.4)), (rng.integers(0, 5, (60, 3)).astype(float), (1.0, 1.5)), (np.array([[0, 0, 0], [1, 0, 0], [0.5, 0.9, 0], [9, 9, 9]], float), (1.0,))):
        for cut in cuts:
            for method in ("complete", "average", "centroid"):
                assert linked(x, cut, method).tolist() == plain.merged(x, cut, method, "e").tolist(), (cut, method)
            if x is not grid:
                assert linked(x, cut, "average", "b").tolist() == plain.merged(x, cut, "average", "b").tolist()
    turned = rng.normal(size=(80, 3))
    for method in ("complete", "average"):
        assert linked(turned, 0.05, method, "c").tolist() == plain.merged(turned, 0.05, method, "c").tolist()
    odd = np.array([[0, 0, 0], [np.nan, 0, 0], [0, 0, 0.1]], float)
    for method in ("complete", "average", "centroid"):
        assert linked(odd, 1.0, method).tolist() == [0, 1, 0] and linked(odd[:0], 1.0, method).tolist() == []


def test_linkage_of_many_points():
    """20,000 points in clusters, where a matrix would take 3 GB."""
    spots = np.array(list(itertools.product(range(8), range(8), range(7))), float)[:400] * 20
    many = np.concatenate([s + np.random.default_rng(k).random((50, 3)) for k, s in enumerate(spots)])
    for method in ("complete", "average", "centroid"):
        if method == "complete":
            tracemalloc.start()
        assert linked(many, 2.5, method).tolist() == [k // 50 * 50 for k in range(len(many))]
        assert tracemalloc.get_traced_memory()[1] < 1e9
        tracemalloc.stop()


def test_rows_without_spread_stay_alone():
    x = np.array([[1, 2, 3], [2, 4, 6.1], [5, 5, 5], [1, 2, 3.1]], float)
    assert linked(x, 0.1, "average", "c").tolist() == [0, 0, 2, 0]


def test_sides_as_columns(spark):
    rng = np.random.default_rng(9)
    c, r = rng.random((300, 3, 3)) * 6, rng.random((300, 3)) + 0.4
    d = np.linalg.norm(c[:, [0, 0, 1]] - c[:, [1, 2, 2]], axis=2)
    order = ((0, 1, 2, 0, 1, 2), (1, 0, 2, 0, 2, 1), (2, 0, 1, 1, 2, 0))
    rows = [(k, *[float(d[k, n]) for n in o[:3]], *[float(r[k, n]) + 0.5 for n in o[3:]]) for k in range(300) for o in order]
    sides = spark.createDataFrame(rows, "k long, d double, e double, g double, ri double, rj double, rk double")
    got = [x.ok for x in metrics.with_side_open(sides).groupBy("k").agg(F.max("open").alias("ok")).orderBy("k").collect()]
    want = metrics.passes_three(*c.transpose(1, 0, 2), *r.T, 0.5)
    assert got == want.tolist() and 10 < sum(got) < 290


def test_unknown_linkage_warns(spark):
    with pytest.warns(UserWarning):
        assert cluster.hierarchical(frame(spark, SIX), 9.0, "point_index", "xyz", KEYS, "q", "z").count() == 6


def test_three_discs():
    rng = np.random.default_rng(8)
    c = rng.random((3, 400, 3)) * 6
    r = rng.random((3, 400)) + 0.4
    got = metrics.passes_three(*c, *r, 0.5)
    assert 20 < got.sum() < 380
    for p in itertools.permutations(range(3)):
        assert (metrics.passes_three(*c[list(p)], *r[list(p)], 0.5) == got).all()
    for k in range(0, 400, 8):
        if metrics.passes_sampled(*c[:, k], *r[:, k], 0.5):
            assert got[k]
    assert metrics.passes_four(list(c[[0, 1, 2, 2]]), list(r[[0, 1, 2, 2]]), 0.5)[got].all()
    one = metrics.passes_centroid([np.array([[0.0, 0, 0]]), np.array([[4.0, 0, 0]]), np.array([[0.0, 4, 0]])], [np.ones(1)] * 3, 0.5)
    assert one.tolist() == [True]


def test_components_of_stars_and_depth_of_a_path(spark):
    n = 100_000
    leaves = spark.range(1, n + 1)
    star = leaves.selectExpr("id AS src", "0L AS dst")  # the hub is the least node
    tail = leaves.selectExpr(f"id + {n} AS src", f"{3 * n}L AS dst")  # the hub is the greatest node
    for chunk in (10**6, 50_000):
        got = connected_components(star.unionByName(tail), chunk=chunk).groupBy("component").count().collect()
        assert sorted((r[0], r[1]) for r in got) == [(0, n + 1), (n + 1, n + 1)]
    rng = random.Random(4)
    edges = [(rng.choice("ab"), f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)]
    graph = spark.createDataFrame(edges, "g string, s string, t string")
    once, often = ({tuple(r) for r in connected_components(graph, "s", "t", ("g",), chunk=c).collect()} for c in (10**6, 7))
    assert once == often and {(g, x) for g, s, t in edges for x in (s, t)} == {(g, x) for g, x, _ in once}
    label = {(g, x): c for g, x, c in once}
    assert all(label[g, s] == label[g, t] <= min(s, t) for g, s, t in edges)
    path = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21)], "src long, dst long")
    assert {r.node: r.depth for r in bfs_depth(path, 2).collect()} == {k: abs(k - 2) for k in range(10)}
    assert {r.node for r in bfs_depth(path, 2, max_depth=1).collect()} == {1, 2, 3}
    assert [r.node for r in bfs_depth(path, 77).collect()] == [77]


@pytest.mark.parametrize("block", [3, 4_000])
def test_shared_keys_by_rarest_and_in_blocks(spark, monkeypatch, block):
    """Items of 1 to 30 keys, a key that all have, repeated rows and nulls, against all pairs."""
    monkeypatch.setattr(joins, "BLOCK", block)
    rng = random.Random(5)
    held = {}
    for g in "ab":
        for i in range(60):
            held[g, i] = {0, *(rng.randrange(1, 40) for _ in range(rng.choice([0, 1, 2, 3, 4, 30])))}
    rows = [(g, i, k) for (g, i), keys in held.items() for k in keys]
    items = spark.createDataFrame(rows + rows[:50] + [("a", None, 1), ("a", 3, None), (None, 1, 1)], "g string, item long, key long")
    for least in (1, 2, 3):
        got = joins.shared_key_pairs(items, "item", "key", least, ("g",)).collect()
        want = {(g, i, j, len(held[g, i] & held[g, j])) for g in "ab" for i in range(60) for j in range(i + 1, 60) if len(held[g, i] & held[g, j]) >= least}
        assert len(got) == len(want) and {(r.g, r.i, r.j, r.n_shared) for r in got} == want


def test_items_that_share_only_common_keys_hardly_meet(spark):
    """Three keys that all 300 items have: by the rarest of four keys, items meet at most at one of them."""
    rows = [(i, k) for i in range(300) for k in (0, 1, 2, 1000 + i // 3)]
    items = spark.createDataFrame(rows, "item long, key long")
    got = joins.shared_key_pairs(items, "item", "key", 4).collect()
    assert {(r.i, r.j) for r in got} == {(i, j) for i in range(300) for j in range(i + 1, 300) if i // 3 == j // 3}


def test_overlaps_of_balls_of_many_sizes(spark):
    rng = random.Random(6)
    balls = [(rng.uniform(-4, 4), rng.uniform(-4, 4), rng.uniform(-4, 4), rng.choice([0.0, 0.01, 0.1, 0.25, 0.5, 1.0, 2.0, 1e-9])) for _ in range(250)]
    balls += [(0.0, 0.0, 0.0, 1.0), (2.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)]  # touching balls and points don't overlap
    discs = spark.createDataFrame([("a", 0, n, *b) for n, b in enumerate(balls)], "system_id string, structure_index int, point_index long, x double, y double, z double, radius double")
    got = joins.overlap_pairs(discs, 2.0).collect()
    far = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    want = {(i, j) for i in range(len(balls)) for j in range(i + 1, len(balls)) if far(balls[i], balls[j]) < (balls[i][3] + balls[j][3]) ** 2}
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want


@pytest.mark.parametrize("pairs", [4, 400, 1_000_000])
def test_group_contacts_of_crowded_cells(spark, monkeypatch, pairs):
    """Clouds, points of one place at exactly the radius, and a lattice with many ties, against all pairs."""
    monkeypatch.setattr(joins, "PAIRS", pairs)
    rng = random.Random(7)
    at = [tuple(rng.gauss(0, 0.3) for _ in range(3)) for _ in range(120)]
    at += [(3.0, 0.0, 0.0)] * 9 + [(4.0, 0.0, 0.0)] * 9 + [(n % 4 / 2 - 8, n // 4 % 4 / 2, n // 16 / 2) for n in range(64)]
    label = [rng.randrange(4) for _ in at]
    rows = [("a", 0, n, *p, g) for n, (p, g) in enumerate(zip(at, label, strict=True))]
    points = spark.createDataFrame(rows, "system_id string, structure_index int, point_index long, x double, y double, z double, g int")
    want = collections.Counter()
    for i, j in itertools.combinations(range(len(at)), 2):
        if label[i] != label[j] and sum((p - q) ** 2 for p, q in zip(at[i], at[j], strict=True)) <= 1.0:
            want[min(label[i], label[j]), max(label[i], label[j])] += 1
    got = joins.group_contacts(points, 1.0, "g").collect()
    assert {(r.a, r.b): r.n_pairs for r in got} == dict(want)


def test_group_contacts_of_a_million_points_in_a_cell(spark):
    """Two groups of half a million within the radius of each other: counted, not paired."""
    n = F.col("id")
    points = spark.range(1_000_000).select(F.lit("a").alias("system_id"), F.lit(0).alias("structure_index"), n.alias("point_index"), *[(F.pmod(n * m, F.lit(1009)) / 1e4).alias(x) for m, x in zip((7, 31, 101), "xyz", strict=True)], (n % 2).alias("g"))
    assert [(r.a, r.b, r.n_pairs) for r in joins.group_contacts(points, 1.0, "g").collect()] == [(0, 1, 250_000_000_000)]


def test_depth_of_a_long_path_and_in_parts(spark):
    path = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    got = bfs_depth(path, 3_000).collect()
    assert {r.node: r.depth for r in got} == {n: abs(n - 3_000) for n in range(10_001)}
    assert len(tracker.getJobIdsForGroup(None)) - before < 100
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(0, n) for n in range(60, 90)] + [(5, 5)]
    depth, front = {0: 0}, [0]
    while front:
        beside = {b for x in front for e in edges for a, b in (e, e[::-1]) if a == x and b not in depth}
        depth.update(dict.fromkeys(beside, depth[front[0]] + 1))
        front = sorted(beside)
    for most in (None, 0, 2):
        want = {n: d for n, d in depth.items() if most is None or d <= most}
        numbers = spark.createDataFrame(edges, "src long, dst long")
        assert {r.node: r.depth for r in bfs_depth(numbers, 0, max_depth=most, chunk=12).collect()} == want
        assert {r.node: r.depth for r in bfs_depth(numbers, 0, max_depth=most).collect()} == want
