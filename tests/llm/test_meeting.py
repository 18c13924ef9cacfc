"""Sets that share many runs meet once for each place in which they differ."""

from swathe.llm.similar import _meet


def test_sets_meet_once_in_runs_that_follow_each_other(spark):
    """1 and 2 share runs 10 to 59 one after the other; 3 lacks the runs 10 and 30, so it meets each of them at 11 and at 31."""
    rows = []
    for same in (1, 2, 3):
        own = [b for b in range(10, 60) if same != 3 or b not in (10, 30)]
        rows += [(b, same, 100, 1000 - k, own[k - 1] if k else None, same) for k, b in enumerate(own)]
    live = spark.createDataFrame(rows, "band long, same long, size int, rest int, before long, root long")
    other = live.toDF("b2", "s2", "z2", "e2", "b1", "r2")
    met = sorted((r.same, r.s2, r.band) for r in _meet(live, other, True).collect())
    assert met == [(1, 2, 10), (1, 3, 11), (1, 3, 31), (2, 3, 11), (2, 3, 31)]
