"""A tree that is kept up equals one that is built again."""

import numpy as np
import pytest

from swathe.lineage import materialize
from swathe.operators import index as ix
from swathe.operators import upkeep
from swathe.operators.windows import header

SCHEMA = "id long, x double, y double, z double"
CHANGES = "id long, op string, x double, y double, z double"


@pytest.mark.parametrize("axes, top", [("xy", 2), ("xyz", 1)])
def test_batches_equal_a_rebuild(spark, axes, top):
    rng = np.random.default_rng(top)
    now = {i: tuple(map(float, v)) for i, v in enumerate(rng.integers(0, 64, (200, 3)) / 4)}
    head = materialize(header(spark.createDataFrame([(i, *v) for i, v in now.items()], SCHEMA), axes))
    tree = upkeep.build(spark.createDataFrame([(i, *v) for i, v in now.items()], SCHEMA), 4, top, axes)
    for batch in range(3):
        state = sorted((r.level, r.key, r.n, r.z, r.id) for r in tree.summaries().collect())
        leaves = [r.id for r in tree.summaries().filter("level = 4").collect()]
        some = rng.permutation(list(now))[:30].tolist()
        changes = [(i, "delete", None, None, None) for i in ({0: some, 1: leaves, 2: [9999, *list(now)[:3]]}[batch])]  # once every leaf's minimum
        gone = {c[0] for c in changes}
        changes += [(i, "move", *map(float, rng.integers(-9, 90, 3) / 4)) for i in some if i not in gone][:20 if batch else 0]  # beyond the box too
        changes += [(1000 * (batch + 1) + k, "insert", *map(float, rng.integers(0, 64, 3) / 4)) for k in range(15)]
        changes += [(77777, "move", 1.0, 1.0, 1.0), (None, "insert", 1.0, 1.0, 1.0)]
        after = tree.changed(spark.createDataFrame(changes, CHANGES))
        for i, op, *v in changes:
            if op == "delete":
                now.pop(i, None)
            elif i is not None and (op == "insert" or i in now):
                now[i] = tuple(v)
        want = ix.rollup(spark.createDataFrame([(i, *v) for i, v in now.items()], SCHEMA), 4, head, axes)
        assert sorted((r.level, r.key, r.n, r.z, r.id) for r in after.summaries().collect()) == sorted((r.level, r.key, r.n, r.z, r.id) for r in want.collect())
        assert sorted((r.level, r.key, r.n, r.z, r.id) for r in tree.summaries().collect()) == state  # the tree before is as it was
        tree = after
    assert {(r.id, r.x, r.y, r.z) for r in tree.points.read().collect()} == {(i, *v) for i, v in now.items()}


def test_only_touched_parts_are_written(spark):
    rows = [(i, float(i % 32), float(i // 32), float(i % 7)) for i in range(1024)]
    tree = upkeep.build(spark.createDataFrame(rows, SCHEMA), 5, 3)
    after = tree.changed(spark.createDataFrame([(0, "delete", None, None, None), (1, "move", 2.0, 0.0, -5.0)], CHANGES))
    assert len(after.points.segments) == 2 and len(after.points.segments[1][1]) == 1 and len(after.points.segments[0][1]) == 63
    assert {p for _, own in after.nodes.segments[1:] for p in own} == {-1, *after.points.segments[1][1]} and len(after.nodes.segments[0][1]) == 63
    root = after.summaries().filter("level = 0").first()
    assert (root.n, root.z, root.id) == (1023, -5.0, 1)
    assert tree.changed(spark.createDataFrame([(5000, "delete", None, None, None)], CHANGES)) is tree
    everything = after.changed(spark.createDataFrame([(i, "delete", None, None, None) for i in range(1024)], CHANGES))
    assert everything.summaries().count() == 0 and everything.points.read().count() == 0
    again = everything.changed(spark.createDataFrame([(5, "insert", 3.0, 3.0, 3.0)], CHANGES))
    assert sorted((r.level, r.n) for r in again.summaries().collect()) == [(d, 1) for d in range(6)]


def test_a_batch_is_checked(spark):
    tree = upkeep.build(spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)], SCHEMA), 2)
    for bad in ([(1, "remove", None, None, None)], [(1, "delete", None, None, None), (1, "insert", 1.0, 1.0, 1.0)], [(1, None, None, None, None)]):
        with pytest.raises(ValueError):
            tree.changed(spark.createDataFrame(bad, CHANGES))


@pytest.mark.parametrize("axes, top", [("xy", 2), ("xyz", 1)])
def test_batches_too_large_to_broadcast(spark, axes, top, monkeypatch):
    """The points are joined with a large batch once, and what that leaves is the new table."""
    monkeypatch.setattr(upkeep, "MOST_IDS", 0)
    test_batches_equal_a_rebuild(spark, axes, top)


def test_kept_points_are_not_dealt_anew(spark, monkeypatch):
    """Points that stay in their part are written by the tasks that read them; only those that are put somewhere are shuffled."""
    rows = [(i, float(i % 32), float(i // 32), float(i % 7)) for i in range(1024)]
    plans = []

    def recorded(df, *by, **options):
        if "x" in df.columns:  # points, not nodes
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, *by, **options)

    for most in (1000, 0):
        monkeypatch.setattr(upkeep, "MOST_IDS", most)
        tree = upkeep.build(spark.createDataFrame(rows, SCHEMA), 5, 3)
        plans.clear()
        with monkeypatch.context() as m:
            m.setattr(upkeep, "materialize", recorded)
            tree.changed(spark.createDataFrame([(0, "delete", None, None, None), (1, "move", 2.0, 0.0, -5.0)], CHANGES))
        assert not any(p.startswith("RebalancePartitions") and "LeftAnti" in p for p in plans)
        assert sum("LeftAnti" in p for p in plans) == (1 if most else 0)
