"""Small clouds with answers by brute force, and properties that hold on any cloud."""

import math

import numpy as np
import pytest

from swathe.functions import columns as c
from swathe.operators import geometry as geo
from swathe.operators import index as ix
from swathe.operators import nearest as nn
from swathe.operators import spatial as sj
from swathe.operators import windows as w
from swathe.plans.seeds import seed_points
from swathe.sources import reports, text
from swathe.streaming import seeds as stream

SCHEMA = "id long, x double, y double, z double, g_id int, intensity int"
LATTICE = [(i * 20 + j, float(i), float(j), float((7 * i + 3 * j) % 11), i % 3, (i * j) % 7) for i in range(20) for j in range(20)]


def cloud(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_seeds(rows, s):
    xs, ys = [r[1] for r in rows], [r[2] for r in rows]
    r2 = lambda v: math.floor(v * 100 + 0.5) / 100
    wide, high = r2(max(xs) - min(xs)), r2(max(ys) - min(ys))
    least = max(1, int(0.5 * len(rows) / (wide * high) * s.w * s.w))
    n = [math.floor((side + 2 * s.w * s.o) / s.step + 0.5) - 1 if s.o > 0 else int(side // s.w) + 1 for side in (wide, high)]
    votes = {}
    for i in range(n[0]):
        for j in range(n[1]):
            cx, cy = min(xs) - s.w // 2 + s.step + i * s.step, min(ys) - s.w // 2 + s.step + j * s.step
            own = [(r[3], r[0]) for r in rows if cx - s.half < r[1] < cx + s.half and cy - s.half < r[2] < cy + s.half]
            if len(own) >= least:
                votes[min(own)[1]] = votes.get(min(own)[1], 0) + 1
    low = {k for k, v in votes.items() if v > 1 or s.o == 0}
    out = set(low)
    if s.b:
        for i in range(int(wide // s.b) + 1):
            for j in range(int(high // s.b) + 1):
                cx, cy = min(xs) + s.half_grid + i * s.b, min(ys) + s.half_grid + j * s.b
                own = [r for r in rows if abs(r[1] - cx) < s.half_grid and abs(r[2] - cy) < s.half_grid]
                if own and not any(r[0] in low for r in own):
                    out.add(min((r[3], r[0]) for r in own)[1])
    return out


@pytest.mark.parametrize("s", [w.Setting(w=4, b=4), w.Setting(w=6, b=2, o=0.5), w.Setting(w=4, b=4, o=0.0), w.Setting(w=4, b=0)])
@pytest.mark.parametrize("tiled", [True, False])
def test_seeds_by_brute_force(spark, s, tiled):
    got = {r.id for r in seed_points(cloud(spark, LATTICE), s, tiled=tiled).collect()}
    assert got == brute_seeds(LATTICE, s)


def test_settings_are_checked():
    for bad in ({"w": 0}, {"b": -1}, {"o": 1.0}):
        with pytest.raises(ValueError):
            w.Setting(**bad)


def test_seed_ids_are_unique_and_moves_leave_them(spark):
    a = sorted(r.id for r in seed_points(cloud(spark, LATTICE), w.Setting(w=4, b=4, o=0.5)).collect())
    moved = [(i, x + 1000, y + 2000, z, g, n) for i, x, y, z, g, n in LATTICE]
    assert len(set(a)) == len(a)
    assert a == sorted(r.id for r in seed_points(cloud(spark, moved), w.Setting(w=4, b=4, o=0.5)).collect())


def test_empty_and_single_point(spark):
    assert seed_points(cloud(spark, LATTICE[:0]), w.Setting()).count() == 0
    assert ix.number_leaves(cloud(spark, LATTICE[:0]), 4).count() == 0


def test_leaves_hold_every_point(spark):
    p = cloud(spark, LATTICE)
    leaves = ix.number_leaves(p, 8, 1, 6)
    assert leaves.groupBy().sum("n").first()[0] == len(LATTICE)
    assert leaves.filter("n > 8 AND level < 6").count() == 0
    levels = {r.level: r.n for r in ix.rollup(p, 4).groupBy("level").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert set(levels.values()) == {len(LATTICE)}


@pytest.mark.parametrize("axes", ["xy", "xyz"])
@pytest.mark.parametrize("bucket, fine, level", [(40, 1, 0), (15, 2, 3), (1, 0, 1), (10**6, 3, 7)])
def test_leaves_of_buckets_of_any_size_are_the_same(spark, axes, bucket, fine, level):
    rng = np.random.default_rng(bucket)
    xyz = [*rng.random((200, 3)).tolist(), *(rng.random((150, 3)) * 1e-3).tolist(), *[[0.5, 0.5, 0.5]] * 40]
    rows = [(i, *map(float, v), 0, 0) for i, v in enumerate(xyz)]
    p = cloud(spark, rows)
    deep = 11
    got = ix.number_leaves(p, 9, level, deep, axes=axes, bucket=bucket, fine=fine).collect()
    n = len(axes)
    lo, hi = [min(r[1 + a] for r in rows) for a in range(n)], [max(r[1 + a] for r in rows) for a in range(n)]
    radius = max((b - a) / 2 for a, b in zip(lo, hi, strict=True))
    corner = [a + (b - a) / 2 - radius for a, b in zip(lo, hi, strict=True)]
    cells = [tuple(max(0, min((1 << deep) - 1, math.floor((r[1 + a] - corner[a]) / (2 * radius) * (1 << deep)))) for a in range(n)) for r in rows]
    key = lambda c: sum(((c[a] >> b) & 1) << (n * b + n - 1 - a) for b in range(deep) for a in range(n))
    want = []

    def walk(d, at, own):
        if (len(own) > 9 or d <= level) and own and d < deep:
            for q in range(1 << n):
                child = (at << n) + q
                walk(d + 1, child, [k for k in own if k >> (n * (deep - d - 1)) == child])
        else:
            want.append((d, at, len(own)))

    walk(0, 0, [key(c) for c in cells])
    assert sorted((r.level, r.key, r.n) for r in got) == sorted(want)


def test_leaves_read_the_cloud_twice(spark, tmp_path):
    cloud(spark, LATTICE).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    for df in (ix.number_leaves(p, 8, 1, 12), ix.rollup(p, 4), ix.radius_leaves(p, 4)):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 2
    with pytest.raises(ValueError):
        ix.depth_for_radius(1.0, 1e-9)


def test_number_leaves_by_insertion(spark):
    """The tree of one-by-one insertion has the same leaves."""
    rows = LATTICE[::2]
    radius, cx, cy = 9.5, 9.5, 9.5
    xs, ys = [r[1] for r in rows], [r[2] for r in rows]
    radius = max(max(xs) - min(xs), max(ys) - min(ys)) / 2
    cx, cy = (max(xs) + min(xs)) / 2, (max(ys) + min(ys)) / 2

    def split(own, cx, cy, r, level):
        if (len(own) <= 6 and level > 1) or level == 8:
            return [(level, len(own))]
        out = []
        for q in range(4):
            part = [p for p in own if (p[1] >= cx) == bool(q & 2) and (p[2] >= cy) == bool(q & 1)]
            out += split(part, cx + (r / 2 if q & 2 else -r / 2), cy + (r / 2 if q & 1 else -r / 2), r / 2, level + 1)
        return out

    want = sorted(split(rows, cx, cy, radius, 0))
    got = sorted((r.level, r.n) for r in ix.number_leaves(cloud(spark, rows), 6, 1, 8).collect())
    assert got == want


def test_neighbours_and_nearest_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(z), int(i % 3), 1) for i, (a, b, z) in enumerate(rng.integers(0, 60, (150, 3)) / 4)]
    p = cloud(spark, rows)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and abs(a[1] - b[1]) < 1 and abs(a[2] - b[2]) < 1}
    assert {(r.id, r.t_id) for r in sj.neighbours(p, 1.0).collect()} == want
    near = {r.id: r.t_id for r in nn.nearest(p, p).collect()}
    for a in rows:
        d = sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]) for b in rows if b[0] != a[0])
        assert near[a[0]] == d[0][1]


def test_gold_pairs_are_one_to_one(spark):
    s = w.Setting(w=10)
    seeds = spark.createDataFrame([(0, 1.0, 1.0, 5.0), (1, 1.2, 1.0, 4.0), (2, 9.0, 9.0, 1.0)], "id long, x double, y double, z double")
    gold = spark.createDataFrame([(7, 1.1, 1.0, 0.0), (8, 1.9, 1.0, 0.0)], "id long, x double, y double, z double")
    assert {(r.id, r.gold) for r in w.gold_pairs(seeds, gold, s).collect()} == {(1, 7), (0, 8)}


def test_gold_pairs_of_a_long_chain(spark):
    """Each pair frees the next: far more rounds than a bound of rounds would allow."""
    s = w.Setting(w=10)
    n = 90
    seeds = spark.createDataFrame([(i, i * 0.9, 0.0, float(i)) for i in range(n)], "id long, x double, y double, z double")
    gold = spark.createDataFrame([(1000 + i, i * 0.9 + 0.46, 0.0, 0.0) for i in range(n)], "id long, x double, y double, z double")
    want, free = set(), {1000 + i: i * 0.9 + 0.46 for i in range(n)}
    for i in range(n):
        near = [(abs(x - i * 0.9), g) for g, x in free.items() if abs(x - i * 0.9) < s.step / 2]
        if near:
            want.add((i, min(near)[1]))
            del free[min(near)[1]]
    for rest in (0, 5, 1000):
        assert {(r.id, r.gold) for r in w.gold_pairs(seeds.limit(8) if rest < 1000 else seeds, gold, s, rest).collect()} == {p for p in want if rest == 1000 or p[0] < 8}


@pytest.mark.parametrize("axes", ["xy", "xyz"])
@pytest.mark.parametrize("itself", [False, True])
def test_nearest_at_any_distance(spark, axes, itself):
    """Far outliers, a crowded spot, equal points, equal distances: the same as by comparing all."""
    rng = np.random.default_rng(11)
    xyz = [*(rng.integers(0, 40, (60, 3)) / 4).tolist(), *(rng.random((150, 3)) * 1e-3 + 5).tolist(), *[[7.0, 7.0, 7.0]] * 5, [1e6, 0.0, 0.0], [1e6 + 3, 1.0, 0.0], [-4e5, 2e5, 1e5]]
    rows = [(i, *map(float, q)) for i, q in enumerate(xyz)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    probes = [*rows[::3], *rows[-9:], (5000, 2.1, 3.3, -50.0), (5001, 7.0, 7.0, 7.0)]
    probes = list({r[0]: r for r in probes}.values())
    got = {r.id: (r.t_id, r.d2) for r in nn.nearest(spark.createDataFrame(probes, p.schema), p, itself, axes, most=20).collect()}
    n = len(axes) + 1
    for a in probes:
        d, t = min((sum((u - v) * (u - v) for u, v in zip(a[1:n], b[1:n], strict=True)), b[0]) for b in rows if itself or b[0] != a[0])
        assert got[a[0]][0] == t and got[a[0]][1] == pytest.approx(d, rel=1e-12)
    assert len(got) == len(probes)


METRICS = {
    "manhattan": (nn.MANHATTAN, lambda a, b: sum(abs(u - v) for u, v in zip(a, b, strict=True))),
    "weighted": (nn.weighted(x=9.0, t=0.0), lambda a, b: sum(k * (u - v) ** 2 for k, u, v in zip((9.0, 1.0, 1.0, 0.0), a, b, strict=False))),
    # the caller's own: the largest side, of a box the largest gap
    "chebyshev": (nn.Metric(lambda p, q: nn.F.greatest(*[nn.F.abs(p[a] - q[a]) for a in p]), lambda p, lo, hi: nn.F.greatest(*[nn.gap(p[a], lo[a], hi[a]) for a in p])), lambda a, b: max(abs(u - v) for u, v in zip(a, b, strict=True))),
}


@pytest.mark.parametrize("metric", sorted(METRICS))
@pytest.mark.parametrize("axes, rings", [("xy", 2), ("xyzt", 2), ("xyzt", 0), ("xyz", 0)])
def test_nearest_by_the_callers_distance(spark, metric, axes, rings):
    """Lattice points give many ties, which go to the smaller id; with no rings all goes down the tree."""
    own, brute = METRICS[metric]
    rng = np.random.default_rng(len(axes) + rings)
    xyzt = [*(rng.integers(0, 6, (120, 4)) / 2).tolist(), *(rng.random((60, 4)) * 1e-3 + 1).tolist(), [900.0, -3.0, 5.0, 1.0], [901.0, -3.0, 5.0, 1.0]]
    rows = [(i, *map(float, q)) for i, q in enumerate(xyzt)]
    p = spark.createDataFrame([*rows, (999, None, 1.0, 1.0, 1.0)], "id long, x double, y double, z double, t double")
    got = nn.nearest(p, p, axes=list(axes), metric=own, name="far", rings=rings, most=20)
    assert got.columns == ["id", "t_id", "far"]
    found = {r.id: (r.t_id, r.far) for r in got.collect()}
    assert len(found) == len(rows)
    n = len(axes) + 1
    for a in rows:
        d, t = min((brute(a[1:n], b[1:n]), b[0]) for b in rows if b[0] != a[0])
        assert found[a[0]][0] == t and found[a[0]][1] == pytest.approx(d, rel=1e-12, abs=1e-15)
    with pytest.raises(ValueError):
        nn.weighted(x=-1.0)


def test_nearest_of_few_points(spark):
    p = spark.createDataFrame([(1, 2.0, 2.0)], "id long, x double, y double")
    assert nn.nearest(p, p).count() == 0 and nn.nearest(p, p, itself=True).first().t_id == 1
    assert nn.nearest(p, p.limit(0)).count() == 0 and nn.nearest(p.limit(0), p).count() == 0
    same = spark.createDataFrame([(i, 2.0, 2.0) for i in (3, 1, 2)], "id long, x double, y double")
    assert {r.id: r.t_id for r in nn.nearest(same, same).collect()} == {1: 2, 2: 1, 3: 1}
    line = spark.createDataFrame([(i, float(i * i), 5.0) for i in range(9)], "id long, x double, y double")
    assert {r.id: r.t_id for r in nn.nearest(line, line).collect()} == {0: 1, **{i: i - 1 for i in range(1, 9)}}


@pytest.mark.parametrize("s", [w.Setting(o=0.0), w.Setting(o=0.5), w.Setting(w=7, o=0.8), w.Setting(w=9, o=0.8, exact=True), w.Setting(w=4, o=0.95)])
def test_sliding_minima_equal_windows(spark, s):
    """Points on edges, ties in z, a lone point far off: every window's count and lowest point."""
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, v), 0, 0) for i, v in enumerate([*(rng.integers(0, 60, (300, 3)) / 2).tolist(), *(rng.random((60, 3)) * 30).tolist(), [45.0, 2.0, 1.0]])]
    p = cloud(spark, rows)
    params = w.parameters(p, s)
    key = lambda r: (r.i, r.j, r.n, r.z, r.id, r.x, r.y)
    assert sorted(map(key, w.sliding_stats(p, params, s).collect())) == sorted(map(key, w.window_stats(p, params, s).collect()))


def test_a_row_slides_by_two_anchors_at_any_overlap(spark):
    tile = spark.createDataFrame([(a, a + 18 + a % 2, 0, 1, (float(a * 7 % 11), a)) for a in range(40)], "i0 long, i1 long, j0 long, n long, key struct<v:double,id:long>")
    got = {r.i: (r.n, r.key.v, r.key.id) for r in w._slide(tile, "i0", "i1", 18, ["j0"], "i").collect()}
    for i in range(60):
        own = [(float(a * 7 % 11), a) for a in range(40) if a <= i <= a + 18 + a % 2]
        assert got.get(i) == ((len(own), *min(own)) if own else None)


def test_order_keys(spark):
    from pyspark.sql import functions as F

    from swathe.functions.ordering import lowest, number_of, order_key

    rng = np.random.default_rng(3)
    zs = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, 1.7e308, -1.7e308, math.inf, -math.inf, 0.1, 0.1 + 2**-56, *map(float, rng.normal(size=50) * 10.0 ** rng.integers(-300, 300, 50))]
    rows = [(z, i) for i, z in enumerate(zs * 2)]
    df = spark.createDataFrame(rows, "z double, id long").withColumn("k", order_key("z", "id", "z"))
    assert [(r.z, r.back) for r in df.orderBy("k").select("z", number_of("k").alias("back")).collect()] == sorted(rows)
    assert df.groupBy((F.col("id") % 3).alias("g")).agg(*lowest("k", "low")).select("low", number_of("k")).count() == 3
    last = spark.createDataFrame([(None, 1), (float("nan"), 2), (5.0, None), (7.0, 3), (7.0, 2)], "z double, id long").select(order_key("z", "id").alias("k"))
    assert last.filter("k IS NULL").count() == 2 and tuple(last.agg(*lowest("k", "z")).first()) == ((7.0, 2), 7.0)


def test_lowest_points_are_reduced_before_the_shuffle(spark):
    """What is shuffled is the lowest point of each group in each task: an aggregate stands below each exchange by the group."""
    p = cloud(spark, LATTICE)
    s = w.Setting(w=4, b=4)
    params = w.parameters(p, s)
    for df in (w.window_stats(p, params, s), w.stage1(p, params, s), w.fill(p, p.limit(3), params, s), w.raster_minima(p, params, s), ix.rollup(p, 4), ix.radius_leaves(p, 4), ix.chunks(p, 16), sj.group_of(p, p)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_min" in plan and "CartesianProduct" not in plan


def test_the_clouds_ids(spark):
    from swathe.sources import cloud as source

    folder = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(folder):
        pytest.skip("the driver's tables are absent")
    p = source.points(spark, folder)
    assert p.rdd.getNumPartitions() > 1
    n = p.count()
    assert p.select("id").distinct().count() == n and p.groupBy().max("id").first()[0] == n


def test_systems_of_any_size(spark):
    from pyspark.sql import functions as F

    from swathe.functions.matrices import solved

    rows = [([2.0, 0.0, 0.0, 4.0], [2.0, 2.0]), ([1.0, 2.0, 2.0, 4.0], [1.0, 2.0]), ([0.0, 1.0, 1.0, 0.0], [3.0, 5.0]), ([4.0], [2.0]), (None, [1.0]), ([1.0, 2.0], [1.0, 2.0]), ([float("nan")], [1.0]), ([], [])]
    got = spark.createDataFrame(rows, "m array<double>, v array<double>").coalesce(1).select(solved(F.col("m"), F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == [[1.0, 0.5], None, [5.0, 3.0], [0.5], None, None, None, None]


def test_octree_by_insertion(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, q)) for i, q in enumerate(rng.random((300, 3)) ** 3)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    lo, hi = np.min([q[1:] for q in rows], axis=0), np.max([q[1:] for q in rows], axis=0)

    def split(own, centre, r, level):
        if len(own) <= 10 or level == 9:
            return [(level, len(own))]
        out = []
        for o in range(8):
            up = np.array([o & 4, o & 2, o & 1], bool)
            out += split([q for q in own if ((np.array(q[1:]) >= centre) == up).all()], centre + np.where(up, r / 2, -r / 2), r / 2, level + 1)
        return out

    want = sorted(split(rows, (lo + hi) / 2, (hi - lo).max() / 2, 0))
    assert sorted((r.level, r.n) for r in ix.number_leaves(p, 10, -1, 4, deepest=9, axes="xyz").collect()) == want


def test_cloud_without_extent(spark):
    p = spark.createDataFrame([(i, 3.0, 4.0, float(i)) for i in range(5)], "id long, x double, y double, z double")
    assert [(r.key, r.n, r.id) for r in ix.radius_leaves(p, 3).collect()] == [(0, 5, 0)]


def test_folders_on_a_cluster_must_be_shared(spark, monkeypatch):
    from swathe import lineage

    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Far)
    big = lineage.materialize(spark.range(1000).selectExpr("id", "sha2(cast(id as string), 512) AS h"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().logical().toString() or "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(lineage.small(big, 2000)) and not hinted(lineage.small(big, 999)) and not hinted(lineage.small(big, 2000, 10_000))


def test_hull_and_normals(spark):
    p = cloud(spark, LATTICE)
    hulls = {r.g_id: {(v.x, v.y) for v in r.hull} for r in geo.convex_hull(p, "g_id").collect()}
    assert hulls[0] == {(0.0, 0.0), (18.0, 0.0), (18.0, 19.0), (0.0, 19.0)}
    flat = spark.createDataFrame([(i * 5 + j, float(i), float(j), 0.5 * i) for i in range(5) for j in range(5)], "id long, x double, y double, z double")
    for r in geo.eigen_normals(flat, 2.5).collect():
        assert abs(r.nx + 0.4472136) < 1e-6 and abs(r.ny) < 1e-6 and abs(r.nz - 0.8944272) < 1e-6


def test_eigenvalues(spark):
    from pyspark.sql import functions as F

    rows = [(0, 4.0, 1.0, 0.5, 3.0, -0.25, 2.0), (1, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, xx double, xy double, xz double, yy double, yz double, zz double")
    got = {r[0]: r[1:] for r in df.select("id", *c.eigenvalues3(*[F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")])).collect()}
    for i, xx, xy, xz, yy, yz, zz in rows:
        want = np.linalg.eigvalsh([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])[::-1]
        assert np.allclose(got[i], want)


def test_text_files(spark, tmp_path):
    one = tmp_path / "a.xyz"
    one.write_text("3 0.0 2.0 0.0 5.5\n0.00 0.00 1.25 9 9\n  1.5\t2.5 3.5\n2.0 5.5 -1.0\n")
    got = [tuple(r) for r in text.read_xyz(spark, str(one), header=True).orderBy("id").collect()]
    assert got == [(0, 0.0, 0.0, 1.25), (1, 1.5, 2.5, 3.5), (2, 2.0, 5.5, -1.0)]
    assert tuple(text.read_header(spark, str(one)).first()) == (3, 0.0, 2.0, 0.0, 5.5)
    two = tmp_path / "b.txt"
    two.write_text("1,2,3,4\n1 2 3\n5\t6 7,8\n")
    assert [tuple(r) for r in text.read_delimited(spark, str(two)).collect()] == [(1.0, 2.0, 3.0, 4), (5.0, 6.0, 7.0, 8)]
    assert text.catalog_header(spark, "/data/sample24.xyz").first().n == 7492
    assert text.catalog_header(spark, "/data/unknown.xyz").count() == 0


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    many = tmp_path / "many"
    many.mkdir()
    lines = []
    for k in range(3):
        own = [f"{k}.5 {i}.25 1.0" if i % 50 else f"bad {k} {i}" for i in range(400 * (3 - k))]
        (many / f"part-{k}.txt").write_text("\n".join(own) + "\n")
        lines += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        got = [(r.id, f"{r.x} {r.y} {r.z}") for r in text.read_xyz(spark, str(many)).orderBy("id").collect()]
        bad = [(r.id, r.value) for r in text.malformed_lines(spark, str(many)).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted([(i, v) for i, v in [*got, *bad]]) == list(enumerate(lines))


def test_las_files(spark, tmp_path):
    import struct

    from swathe.sources import las

    def write(name, version, points, length=20, cut=0):
        head = bytearray(375 if version == 4 else 227)
        head[:4], head[24], head[25] = b"LASF", 1, version
        struct.pack_into("<I", head, 96, len(head) + 5)
        struct.pack_into("<BHI", head, 104, 1, length, 0 if version == 4 else len(points))
        struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.001, 1000.0, 2000.0, -5.0)
        if version == 4:
            struct.pack_into("<Q", head, 247, len(points))
        body = b"".join(struct.pack("<3iH", *p).ljust(length, b"\x07") for p in points)
        (tmp_path / name).write_bytes(bytes(head) + b"extra" + body[: len(body) - cut])

    a, b = [(i, -2 * i, 1000 * i, i % 7) for i in range(70_000)], [(5, 6, 7, 65535), (8, 9, 10, 0)]
    write("a.las", 2, a)
    write("b.las", 4, b, length=34, cut=3)
    got = {r.id: (r.x, r.y, r.z, r.intensity) for r in las.read_las(spark, str(tmp_path / "*.las")).collect()}
    assert len(got) == 70_001 and set(got) == set(range(70_001))
    for k in (0, 1, 65_536, 69_999):
        assert got[k] == pytest.approx((1000 + k * 0.01, 2000 - k * 0.02, -5 + k, k % 7))
    assert got[70_000] == pytest.approx((1000.05, 2000.06, -4.993, 65535))
    with pytest.raises(ValueError):
        list(las.parse(b"PDF"))


def test_reports(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("start\nRunning: a 4\n time 1.5\n time 2.5\nRunning: b 8\nfinished\n 0.25 s\n")
    assert sorted((r.run, r.seconds) for r in reports.read_run_log(spark, str(log)).collect()) == [("a 4", 1.5), ("a 4", 2.5), ("b 8", 0.25)]
    stats = tmp_path / "stats.txt"
    stats.write_text("Points histogram\n1 10 10\n2 5 10\n\nLevel histogram\n3 15\n")
    got = sorted((r.section, r.number, r.leaves) for r in reports.read_tree_statistics(spark, str(stats)).collect())
    assert got == [("Level histogram", 3.0, 15), ("Points histogram", 1.0, 10), ("Points histogram", 2.0, 5)]
    csv = tmp_path / "sum.csv"
    csv.write_text("Optimization;Cloud;TimeTree;TimeOWM;Level;MinRadMaxNum\nA;x;1.5;2.5;3;0.1\n")
    assert reports.read_summary(spark, str(csv)).first().TimeOWM == 2.5


def test_stream_of_points(spark, tmp_path):
    s = w.Setting(w=4, b=0)
    p = cloud(spark, LATTICE)
    params = w.parameters(p, s).persist()
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.tiles(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), params, s).writeStream.format("memory").queryName("tiles").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = stream.minima(spark.table("tiles"), params)
    want = w.stage1(p, params, s).drop("x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_plan_has_no_all_pairs_join(spark):
    p = cloud(spark, LATTICE)
    plan = sj.neighbours(p, 1.0)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_crowded_cells_split_on(spark):
    rows = [(i, 0.01 * (i % 8), 0.01 * (i // 8), 0.0) for i in range(64)] + [(100, 900.0, 900.0, 0.0), (101, -100.0, -100.0, 0.0)]
    p = spark.createDataFrame([(i, float(x), float(y), z) for i, x, y, z in rows], "id long, x double, y double, z double")
    capped = [r.n for r in ix.number_leaves(p, 8, 1, 6, empty=False).collect()]
    got = [r.n for r in ix.number_leaves(p, 8, 1, 6, empty=False, deepest=ix.MAX_DEPTH).collect()]
    assert max(capped) == 64 and max(got) <= 8 and sum(got) == len(rows)
