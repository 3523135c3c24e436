import math
import os

import numpy as np
import pytest
from test_geometry import naive_clusters

import __spark_entry__ as entry
from cavitas.operators import reach
from cavitas.plans import queries as plan_queries

DATA = os.environ.get("CAVITAS_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(str([plain(r[k]) for k in order]) for r in want.fetchall())


def equal_to_sql(spark, duckdb, folder, name, vectors):
    """A query and its SQL on embeddings of ``(vec_id, x, y, z)``."""
    rows = [(i, [float(v) for v in p], 0) for i, *p in vectors]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    got, want = entry.queries()[name](spark, str(folder)), connection.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    rows = sorted(str([plain(v) for v in r]) for r in got.collect())
    assert rows == sorted(str([plain(r[k]) for k in order]) for r in want.fetchall())
    return rows


def test_permeability_of_two_shuffles_points_not_pairs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    plan = entry.queries()["permeability_of_two"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_permeability_of_two_of_ids_that_repeat(spark, tmp_path):
    vectors = [(k % 7, *v) for k, v in enumerate(np.random.default_rng(8).random((12, 3)) * 0.2)]
    assert equal_to_sql(spark, pytest.importorskip("duckdb"), tmp_path, "permeability_of_two", [*vectors, (None, 0.1, 0.1, 0.1)])


@pytest.mark.parametrize("name", ["depth_from_outside", "accessible_pockets"])
def test_reach_lists_no_pairs(spark, monkeypatch, name):
    """Of points by distance, neither query makes a row a pair."""
    if not os.path.isdir(DATA):
        pytest.skip("no test data")

    def listed(*_, **__):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(plan_queries.joins, "distance_pairs", listed)
    assert entry.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["depth_from_outside", "accessible_pockets"])
@pytest.mark.parametrize("part", [15, 10_000])
def test_reach_of_odd_points_equals_sql(spark, monkeypatch, tmp_path, name, part):
    """Ids that repeat in two places, no id, no place, a chain, points in one place and some that nothing reaches; in one part and in many."""
    monkeypatch.setattr(reach, "PART", part)
    rng = np.random.default_rng(9)
    vectors = [(1 + k, *v) for k, v in enumerate(rng.random((60, 3)) * 0.2) if k % 25 != 24]
    vectors += [(100 + k, 1 + 0.045 * k, 0, 0) for k in range(20)] + [(203, -0.5, 0, 0), (204, -0.52, 0, 0), (206, -2, 0, 0), (303, 0.5, 0.5, 0.5), (303, -0.52, 0, 0.04)]
    vectors += [(400 + k, 3, 3, 3) for k in range(30)] + [(None, 1, 0, 0), (None, -2, 0, 0), (25, math.nan, 0, 0), (207, math.nan, 0, 0), (208, math.inf, 0, 0), (75, 0.5, 0.5, 0.48)]
    assert equal_to_sql(spark, pytest.importorskip("duckdb"), tmp_path, name, vectors)


LINKAGES = {f"pockets_by_{name}_linkage": name for name in ("complete", "average", "centroid")}


def test_all_have_sql_or_brute_force():
    assert {n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"} == set(LINKAGES)


@pytest.mark.parametrize("name", LINKAGES)
def test_linkage_query_equals_brute_force(spark, name):
    """Three of the query's structures, clustered in plain Python."""
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    got = {}
    for r in entry.queries()[name](spark, DATA).where("system_id < 3").collect():
        got.setdefault((r.system_id, r.pocket_id), []).append(r.sphere_id)
    spheres = plan_queries.spheres(spark, DATA).where("system_id < 3 AND radius BETWEEN 0.05 AND 0.3").orderBy("system_id", "sphere_id").collect()
    want = []
    for system in range(3):
        own = [r for r in spheres if r.system_id == system]
        groups = naive_clusters(np.array([[r.cx, r.cy, r.cz] for r in own]), 0.08, LINKAGES[name], "e") if own else []
        want += [(system, sorted(own[k].sphere_id for k in g)) for g in groups if len(g) >= 4]
    assert want and sorted((s, sorted(v)) for (s, _), v in got.items()) == sorted(want)


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns == ["component", "n"]
