import numpy as np
import pandas as pd
import pytest

from cavitas.operators import geometry, network, reach
from cavitas.plans import pockets as P

KEYS = ["system_id", "structure_index"]


def spheres_frame(spark, n=60, seed=0, systems=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = [(s, 0, i, *p) for s in systems for i, p in enumerate((rng.random((n, 3)) * 10).tolist())]
    points = spark.createDataFrame(rows, "system_id string, structure_index int, point_index long, x double, y double, z double")
    return points, geometry.alpha_spheres(points).cache()


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for n in nodes:
        groups.setdefault(root(n), []).append(n)
    return [sorted(g) for g in groups.values()]


def brute_contacts(rows, lo, hi, near, cluster, pair, contacts, least, keep):
    rows = [r for r in rows if lo <= r.radius <= hi]
    centre = {r.sphere_id: np.array([r.cx, r.cy, r.cz]) for r in rows}
    touch = {r.sphere_id: set(r.contacts) for r in rows}
    ids = sorted(centre)
    gap = lambda i, j: np.linalg.norm(centre[i] - centre[j])
    one = [(i, j) for i in ids for j in ids if i < j and len(touch[i] & touch[j]) >= 2 and gap(i, j) <= near]
    first = components({x for e in one for x in e}, one)
    middle = [np.mean([centre[i] for i in g], axis=0) for g in first]
    two = [(a, b) for a in range(len(first)) for b in range(a) if np.linalg.norm(middle[a] - middle[b]) <= cluster]
    groups = components(range(len(first)) if keep else {x for e in two for x in e}, two)
    second = [sorted(i for a in g for i in first[a]) for g in groups]
    three = [(a, b) for a in range(len(second)) for b in range(a) if min(len(second[a]), len(second[b])) >= contacts and sum(gap(i, j) <= pair for i in second[a] for j in second[b]) >= contacts]
    if three or keep:
        groups = components(range(len(second)) if keep else {x for e in three for x in e}, three)
        second = [sorted(i for a in g for i in second[a]) for g in groups]
    return sorted(g for g in second if len(g) >= least)


@pytest.mark.parametrize("keep", [False, True])
def test_contacts_pipeline(spark, keep):
    _, spheres = spheres_frame(spark)
    got = {}
    for r in P.pockets_by_contacts(spheres, 1.0, 3.0, 0.8, 2.0, 1.0, 2, 4, keep).collect():
        got.setdefault((r.system_id, r.pocket_id), []).append(r.sphere_id)
    for system in ("a", "b"):
        rows = spheres.where(f"system_id = '{system}'").collect()
        assert sorted(sorted(v) for (s, _), v in got.items() if s == system) == brute_contacts(rows, 1.0, 3.0, 0.8, 2.0, 1.0, 2, 4, keep)


def test_pipelines_of_nothing(spark):
    _, spheres = spheres_frame(spark, 12, 3)
    assert P.pockets_by_contacts(spheres, 50, 60).count() == 0
    assert P.pockets_by_linkage(spheres, 50, 60).count() == 0
    one = spheres.limit(1)
    assert P.pockets_by_linkage(one, 0, 1e9, min_spheres=1).count() == 1


def test_apolar_ratio(spark):
    _, spheres = spheres_frame(spark, 30, 4)
    with pytest.warns(UserWarning):
        whole = P.pockets_by_linkage(spheres, 0, 9, 0.5, min_spheres=1, apolar_min_ratio=0.5)
    marked = spheres.selectExpr("*", "sphere_id % 2 = 0 AS is_apolar")
    kept = P.pockets_by_linkage(marked, 0, 9, 0.5, min_spheres=1, apolar_min_ratio=0.5)
    groups = {}
    for r in whole.collect():
        groups.setdefault((r.system_id, r.pocket_id), []).append(r.sphere_id)
    want = {(s, p, i) for (s, p), v in groups.items() if sum(i % 2 == 0 for i in v) / len(v) >= 0.5 for i in v}
    assert {(r.system_id, r.pocket_id, r.sphere_id) for r in kept.collect()} == want


def test_permeable_edges(spark):
    points, spheres = spheres_frame(spark, 25, 6, ("a",))
    atoms = points.selectExpr("*", "CAST(0.3 AS DOUBLE) AS radius")
    x = {r.point_index: np.array([r.x, r.y, r.z]) for r in points.collect()}
    own = {r.sphere_id: set(r.contacts) for r in spheres.collect()}
    from cavitas.functions.metrics import passes_three

    want = set()
    for i in own:
        for j in own:
            face = sorted(own[i] & own[j])
            if i < j and len(face) == 2 and np.linalg.norm(x[face[0]] - x[face[1]]) >= 0.6 + 2 * 0.8:
                want.add((i, j))
            elif i < j and len(face) == 3 and passes_three(*[x[k][None] for k in face], *[np.array([0.3])] * 3, 0.8)[0]:
                want.add((i, j))
    got = {(r.i, r.j) for r in network.permeable_edges(spheres, atoms, 0.8).collect()}
    assert got == want and 0 < len(got)
    middle = network.permeable_edges(spheres, atoms, 0.8, centroid=True)
    for r in middle.collect():
        c = np.mean([x[k] for k in r.face], axis=0)
        assert len(r.face) > 2 and all(np.linalg.norm(x[k] - c) >= 1.1 for k in r.face)


def test_depth_and_accessible_pockets(spark):
    edges = spark.createDataFrame([(-1, 0), (0, 1), (1, 2), (-1, 5), (7, 8)], "i long, j long")
    assert {(r.node, r.depth, r.buried) for r in P.depth_from_outside(edges).collect()} == {(-1, 0, False), (0, 1, False), (5, 1, False), (1, 2, False), (2, 3, False), (7, None, True), (8, None, True)}
    assert {(r.node, r.component) for r in P.accessible_pockets(edges).collect()} == {(0, 0), (1, 0), (2, 0), (5, 5)}
    assert {r.node for r in P.accessible_pockets(edges, 2).collect()} == {0, 1, 2}


@pytest.mark.parametrize("small", [False, True])
def test_levels_and_components_of_points(monkeypatch, small):
    """One part's work against brute force, also with every limit small: a crowd, a loose cloud, a chain and wide gaps."""
    if small:
        for name, value in (("TRIED", 7), ("LOOK", 1), ("FEW", 2)):
            monkeypatch.setattr(reach, name, value)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random((80, 3)) * 0.3, rng.random((60, 3)) * 3 - 1.5, np.outer(np.arange(40), [0.099, 0, 0]) + 4, np.array([[1e6, -1e6, 3.0], [1e6, -1e6, 3.05]])])
    radius, n = 0.1, len(x)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= radius
    want = np.full(n, reach.UNKNOWN)
    want[[0, 141]], level = [1, 4], 0
    for level in range(n):
        reached = near[want == level].any(axis=0)
        want[reached] = np.minimum(want[reached], level + 1)
    linked = near.sum(axis=1) > 1
    want[linked & (want == reach.UNKNOWN)] = reach.BURIED
    rows = pd.DataFrame({"part": 0, "own": True, "node": np.arange(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "depth": np.nan})
    rows.loc[[0, 141], "depth"] = [1, 4]
    rows = rows.sample(frac=1, random_state=1)
    got = reach._lowered(radius, True)(rows)
    known = {0: 1, 141: 4} | dict(zip(got["node"], got["depth"], strict=True))
    assert known == {k: int(d) for k, d in enumerate(want) if d != reach.UNKNOWN}
    label = np.arange(n)
    for _ in range(n):
        label = np.array([label[near[k]].min() for k in range(n)])
    stars = reach._stars(radius)(rows)
    assert dict(zip(stars["u"], stars["v"], strict=True)) == {k: int(m) for k, m in enumerate(label) if m != k}


@pytest.mark.parametrize("part", [30, 10_000])
def test_reach_goes_on_from_part_to_part(spark, monkeypatch, part):
    """A long winding chain, in one part and in many: each point is one step on."""
    monkeypatch.setattr(reach, "PART", part)
    turn = np.arange(200)
    x = np.stack([np.cos(turn / 16), np.sin(turn / 16), turn / 100], axis=1)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.07
    assert near.sum() == 200 + 2 * 199
    points = spark.createDataFrame([(int(k), *map(float, v)) for k, v in enumerate(x)] + [(900, 9.0, 9.0, 9.0)], "point_index long, x double, y double, z double")
    doors = spark.createDataFrame([(150,), (900,)], "node long")
    assert {(r.node, r.depth, r.buried) for r in P.depth_of_points(points, 0.07, doors).collect()} == {(-1, 0, False), (900, 1, False), *((k, abs(k - 150) + 1, False) for k in range(200))}
    assert {(r.node, r.component) for r in P.accessible_points(points, 0.07, doors).collect()} == {(900, 900), *((k, 0) for k in range(200))}
