"""Neighbour counts by cells equal those point by point."""

import numpy as np
import pytest

from swathe.operators import spatial as sj

SCHEMA = "id long, x double, y double, z double"


@pytest.mark.parametrize("levels, half", [(1, {"rx": 0.5}), (2, {"rx": 0.75, "ry": 0.25}), (3, {"rx": 0.5, "rz": 0.25})])
def test_counts_by_cells_equal_all_pairs(spark, levels, half):
    """Points on a grid of sixteenths, so that many lie on the open boxes' sides; a third of them coincide, some lack a coordinate."""
    rng = np.random.default_rng(levels)
    p = rng.integers(-24, 24, (240, 3)) / 16
    p[::3] = (0.25, -0.5, 0.0)
    r = [half["rx"], half.get("ry", half["rx"]), half.get("rz", np.inf)]
    want = {i: int((np.abs(p - v) < r).all(axis=1).sum()) for i, v in enumerate(p)}
    got = sj.counts_by_cells(spark.createDataFrame([*[(i, *map(float, v)) for i, v in enumerate(p)], (999, None, 1.0, 1.0)], SCHEMA), levels=levels, **half)
    assert {r.id: r.n for r in got.collect()} == want | {999: 0}


def test_counts_of_nothing(spark):
    assert sj.counts_by_cells(spark.createDataFrame([], SCHEMA), 1.0).count() == 0


@pytest.mark.parametrize("most", [50, 500_000])
def test_counts_make_no_pairs(spark, most):
    """Counts by ranks, with tiles dealt to several tasks or not, equal all pairs; also of other groups, and without the point itself."""
    from swathe.operators.tiles import box_counts

    rng = np.random.default_rng(most)
    p = rng.integers(-24, 24, (300, 2)) / 16
    p[::3] = (0.25, -0.5)
    g = [None if k % 11 == 0 else k % 3 for k in range(len(p))]
    rows = [(i, *map(float, v), g[i]) for i, v in enumerate(p)] + [(999, None, 1.0, 1), (998, float("nan"), 1.0, 1), (997, float("inf"), 1.0, 2)]
    cloud = spark.createDataFrame(rows, "id long, x double, y double, g_id int")
    near = (np.abs(p[:, None] - p[None]) < (0.75, 0.25)).all(axis=2)
    differs = np.array([[a is not None and b is not None and a != b for b in g] for a in g])
    none = {999: 0, 998: 0, 997: 0}
    for more, pairs in (({}, near), ({"itself": False}, near & ~np.eye(len(p), dtype=bool)), ({"apart": "g_id"}, near & differs)):
        got = box_counts(cloud, 0.75, 0.25, most=most, **more)
        assert {r.id: r.n for r in got.collect()} == dict(enumerate(pairs.sum(axis=1).tolist())) | none
    plan = sj.counts(cloud, 0.5, apart="g_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # a join of points with points grows with the square of their density


def test_counts_by_cells_write_no_rows_of_points_and_cells(spark):
    """In two dimensions each point's row is written with none of the cells of its box."""
    cloud = spark.createDataFrame([(i, i % 7 / 4, i % 5 / 4, 0.0) for i in range(40)], SCHEMA)
    plan = sj.counts_by_cells(cloud, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan and "_whole" not in plan
