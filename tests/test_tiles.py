"""Nearest points searched for in tiles equal those by brute force."""

import numpy as np
import pytest

from swathe.operators import nearest as nn
from swathe.operators import spatial as sj


@pytest.mark.parametrize("most", [30, 500_000])
def test_nearest_in_tiles(spark, most, monkeypatch):
    """Small tiles whose edges many probes stand at, ties, points that coincide; tiles of many probes dealt to several tasks, or not."""
    monkeypatch.setattr(nn, "TILE", {1: 4, 2: 3, 3: 2})
    monkeypatch.setattr(nn, "MOST_PROBES", most)
    monkeypatch.setattr(nn, "SLICE", 7)
    rng = np.random.default_rng(most)
    p = rng.integers(-20, 20, (200, 2)) / 8
    p[::9] = (0.5, 0.5)
    cloud = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double")
    for metric, d in ((nn.EUCLID, ((p[:, None] - p[None]) ** 2).sum(axis=2)), (nn.MANHATTAN, np.abs(p[:, None] - p[None]).sum(axis=2))):
        far = d + np.where(np.eye(len(p), dtype=bool), np.inf, 0)
        got = {r.id: (r.t_id, r.d2) for r in nn.nearest(cloud, cloud, metric=metric).collect()}
        assert got == {i: (int(far[i].argmin()), float(far[i].min())) for i in range(len(p))}


def test_group_of_the_nearest_in_the_box(spark):
    """The box is open, its corners reach farther than its sides, and pairs are not made."""
    rng = np.random.default_rng(5)
    p, q = rng.integers(-30, 30, (150, 2)) / 8, rng.integers(-40, 40, (80, 2)) / 8 + (0.0, 1 / 16)
    points = spark.createDataFrame([*[(i, *map(float, v), i % 5) for i, v in enumerate(p)], (900, None, 0.0, 7)], "id long, x double, y double, g_id int")
    probes = spark.createDataFrame([*[(i, *map(float, v)) for i, v in enumerate(q)], (999, float("nan"), 0.0)], "id long, x double, y double")
    d = np.where((np.abs(q[:, None] - p[None]) < 0.5).all(axis=2), ((q[:, None] - p[None]) ** 2).sum(axis=2), np.inf)
    want = {i: int(d[i].argmin()) % 5 if np.isfinite(d[i].min()) else -1 for i in range(len(q))}
    assert -1 in want.values()
    assert {r.id: r.g for r in sj.group_of(probes, points, 0.5).collect()} == want | {999: -1}


@pytest.mark.parametrize("most, at_once", [(40, 7), (500_000, 1_000_000)])
def test_pairs_are_numbered_where_they_are_made(spark, most, at_once):
    """Points on a grid, so that many lie on the open boxes' sides, a third of them coincide; tiles of many points dealt to several tasks, or not."""
    from swathe.operators.tiles import numbered_pairs

    rng = np.random.default_rng(most)
    p = rng.integers(-48, 48, (300, 2)) / 16
    p[::3] = (0.25, -0.5)
    rows = [(7 * i % 300, *map(float, v)) for i, v in enumerate(p)] + [(999, None, 1.0), (998, float("nan"), 1.0), (997, 1.0, float("inf")), (None, 0.25, -0.5)]
    cloud = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    want = set(map(tuple, sj.renumbered(sj.neighbours(cloud, 0.75, 0.25)).collect()))
    got = numbered_pairs(cloud, 0.75, 0.25, most, at_once).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert sj.numbered_neighbours(cloud, 0.75, 0.25).dtypes == sj.renumbered(sj.neighbours(cloud, 0.75, 0.25)).dtypes
    assert sj.numbered_neighbours(cloud.limit(0), 0.75).count() == 0


def test_the_query_shuffles_no_pairs(spark):
    """The only rows that are shuffled are points of a tile."""
    from swathe.plans import q_spatial

    plan = q_spatial.QUERIES["neighbors_renumbered"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("most", [40, 200_000])
def test_moments_make_no_pairs(spark, most):
    """Numbers and covariances in open boxes equal those over all pairs, with tiles dealt to several tasks or not; far from 0, where squares lose digits."""
    from swathe.operators import geometry as geo
    from swathe.operators.tiles import box_moments

    rng = np.random.default_rng(most)
    p = rng.integers(-20, 20, (200, 3)) / 8 + (1e5, -1e5, 0.0)
    p[::7] = (1e5, -1e5, 0.5)
    rows = [(i, *map(float, v)) for i, v in enumerate(p)] + [(999, None, 1.0, 1.0), (998, 1.0, 1.0, float("nan")), (997, 1.0, float("inf"), 1.0)]
    cloud = spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3)
    near = (np.abs(p[:, None] - p[None]) < (0.75, 1.0, 0.5)).all(axis=2)
    got = {r.id: r for r in box_moments(cloud, 0.75, 1.0, 0.5, most).collect()}
    assert sorted(got) == list(range(len(p)))
    for i, m in enumerate(near):
        want = np.cov(p[m].T, bias=True)
        assert got[i].n == m.sum()
        assert np.allclose([got[i][c] for c in ("xx", "xy", "xz", "yy", "yz", "zz")], want[np.triu_indices(3)], atol=1e-9)
    assert "Join" not in geo.eigen_normals(cloud, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert geo.eigen_normals(cloud.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("most, most_pairs, at_once", [(40, 10**9, 7), (500_000, 300, 50), (500_000, 10**9, 1_000_000)])
def test_pairs_are_made_in_tiles(spark, most, most_pairs, at_once):
    """Points on a grid, so that many lie on the open boxes' sides, a third of them coincide, two share an id; tiles of many points or pairs dealt to several tasks, or not."""
    from swathe.operators.tiles import box_pairs

    rng = np.random.default_rng(most)
    p = rng.integers(-48, 48, (300, 2)) / 16
    p[::3] = (0.25, -0.5)
    rows = [(7 * i % 300, *map(float, v)) for i, v in enumerate(p)] + [(5, 0.25, -0.5), (999, None, 1.0), (998, float("nan"), 1.0), (997, 1.0, float("inf")), (None, 0.25, -0.5)]
    cloud = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    fine = [r for r in rows if r[0] is not None and r[1] is not None and np.isfinite(r[1:]).all()]
    want = sorted((a[0], b[0]) for a in fine for b in fine if a[0] != b[0] and abs(a[1] - b[1]) < 0.75 and abs(a[2] - b[2]) < 0.25)
    assert sorted(map(tuple, box_pairs(cloud, 0.75, 0.25, most=most, most_pairs=most_pairs, at_once=at_once).collect())) == want
    assert sj.neighbours(cloud, 0.75, 0.25).dtypes == [("id", "bigint"), ("t_id", "bigint")] and sj.neighbours(cloud.limit(0), 0.75).count() == 0


@pytest.mark.parametrize("name", ["neighbors_box2d", "neighbors_rect2d"])
def test_neighbour_queries_shuffle_points_once(spark, name):
    """A join of points with points shuffles each to all cells of its box."""
    from swathe.plans import q_spatial

    plan = q_spatial.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


def odd_cloud(spark):
    """Points of which many coincide or lie on the boxes' sides, with groups and heights that are null or NaN in some."""
    rng = np.random.default_rng(11)
    p = rng.integers(-24, 24, (240, 2)) / 16
    p[::3] = (0.25, -0.5)
    odd = [None, float("nan"), -0.0, 0.0, float("inf"), 1.5, -2.0]
    rows = [(i, *map(float, v), odd[i % 7], odd[i % 5], f"k{i % 4}" if i % 9 else None) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, g_id double, key string").repartition(3)


def both_ways(cloud, residual=None, along=()):
    """The pairs made in tiles and those of the join, which a given cell width asks for."""
    got, joined = sj.neighbours(cloud, 0.75, 0.5, residual, along=along), sj.neighbours(cloud, 0.75, 0.5, residual, cell=1.0, along=along)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and got.dtypes == joined.dtypes
    got, joined = (sorted(map(repr, df.collect())) for df in (got, joined))
    assert got == joined and got


@pytest.mark.parametrize("along", [("t_key",), ("key", "t_x", "x", "t_z", "t_key")])
def test_pairs_take_columns_along(spark, along):
    both_ways(odd_cloud(spark), along=along)


def test_the_leaf_query_shuffles_points_once(spark):
    """Keys are made with the header's one row, which is broadcast."""
    from swathe.plans import q_spatial

    plan = q_spatial.QUERIES["neighbors_with_leaf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join Inner" not in plan.split("InMemoryRelation")[0]


@pytest.mark.parametrize("name", ["neighbors_circle", "neighbors_donut", "neighbors_diff_group", "neighbors_lower_z"])
def test_conditional_pairs_are_made_in_tiles(spark, name):
    test_neighbour_queries_shuffle_points_once(spark, name)


def test_pairs_in_a_circle(spark):
    """On a grid of sixteenths many distances equal the radius."""
    both_ways(odd_cloud(spark), sj.within_circle(0.3125))


def test_pairs_in_a_ring(spark):
    """The inner side belongs to the ring, the outer does not."""
    both_ways(odd_cloud(spark), sj.within_ring(0.125, 0.3125))


@pytest.mark.parametrize("column", ["g_id", "key", "x"])
def test_pairs_of_other_groups(spark, column):
    """Nulls differ from nothing, NaN not from itself, 0 not from -0; groups may be texts."""
    both_ways(odd_cloud(spark), sj.apart_in(column))


@pytest.mark.parametrize("condition", [sj.lower(), sj.apart_in("key") & sj.lower(), sj.within_z(1.5), sj.within_sphere(1.5)])
def test_pairs_by_height(spark, condition):
    """NaN is above all, also above infinity; a point without a height is in no pair."""
    both_ways(odd_cloud(spark), condition)


@pytest.fixture(scope="module")
def dense_cloud(spark):
    """A tile as dense as 36 million points make the queries' cloud, with its rim."""
    rng = np.random.default_rng(3)
    p, ids, z = rng.integers(0, 272, (36_000, 2)) / 100, rng.permutation(36_000_000)[:36_000], rng.integers(90_000, 10_000_000, 36_000) / 100
    rows = [(int(i), *map(float, v), float(h), int(i) % 7 + 1) for i, v, h in zip(ids, p, z, strict=True)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, g_id int").repartition(3).persist()


def stored(pairs, folder):
    """Bytes a row as Parquet."""
    pairs.write.parquet(str(folder))
    return sum(f.stat().st_size for f in folder.glob("*.parquet")) / pairs.sparkSession.read.parquet(str(folder)).count()


def test_pairs_are_stored_small(spark, dense_cloud, tmp_path):
    """Each point's others come nearly as those of the point before, so a page repeats itself. Before: 0.74 bytes a row."""
    assert stored(sj.neighbours(dense_cloud, 0.1), tmp_path / "p") < 0.6


def test_tiles_have_partitions_of_their_own(spark, monkeypatch):
    """Tiles of many pairs are dealt by number, so no two share a task while another has none."""
    from swathe.operators import tiles

    monkeypatch.setattr(tiles, "USUAL", 1)
    monkeypatch.setattr(tiles, "TASK_PAIRS", 10)
    cloud = spark.createDataFrame([(i, i % 10 / 100 + 4 * (i // 20) + 0.5, i % 7 / 10) for i in range(240)], "id long, x double, y double").persist()
    got = tiles.box_pairs(cloud, 0.45)
    assert got.rdd.mapPartitions(lambda rows: [len({r.id // 20 for r in rows})]).collect() == [1] * 12
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in range(240) for b in range(240) if a != b and a // 20 == b // 20 and abs(a % 7 - b % 7) < 5)


CONDITIONS = {"circle": (0.1, sj.within_circle(0.1), 0.7), "donut": (0.1, sj.within_ring(0.04, 0.1), 0.9), "group": (0.1, sj.apart_in("g_id"), 0.9), "lower": (0.25, sj.apart_in("g_id") & sj.lower(), 1.2)}


@pytest.mark.parametrize("name", CONDITIONS)
def test_conditional_pairs_are_stored_small(spark, dense_cloud, tmp_path, name):
    """Before: 0.83, 1.01, 1.06 and 1.64 bytes a row."""
    r, condition, most = CONDITIONS[name]
    assert stored(sj.neighbours(dense_cloud, r, None, condition), tmp_path / "p") < most


def test_pairs_in_a_flat_box_are_stored_small(spark, dense_cloud, tmp_path):
    """Before: 0.75 bytes a row."""
    assert stored(sj.neighbours(dense_cloud, 0.16, 0.06), tmp_path / "p") < 0.6


def test_pairs_with_a_column_along_are_stored_small(spark, dense_cloud, tmp_path):
    """Before: 0.74 bytes a row."""
    assert stored(sj.neighbours(dense_cloud.selectExpr("*", "0 AS key"), 0.1, along=("t_key",)), tmp_path / "p") < 0.6


def test_numbered_pairs_are_stored_small(spark, dense_cloud, tmp_path):
    """A point's pairs come in eights, what is left after those of its batch, so numbers repeat by whole bytes. Before: 1.27 bytes a row."""
    assert stored(sj.numbered_neighbours(dense_cloud, 0.1), tmp_path / "p") < 1.1
