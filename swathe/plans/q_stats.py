"""Queries of aggregates, geometry columns and benchmark tables, with their SQL."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import matrices as mx
from ..operators import bench_tables as bt
from ..operators import geometry as geo
from ..operators import stats as st
from ..sources.cloud import POINTS3_SQL, POINTS_SQL, points, points3

P = f"WITH p AS ({POINTS_SQL})"
E3 = "WITH p AS (" + POINTS3_SQL.format(a=1, b=2, c=3) + ")"

#: runs of three variants on four clouds, each variant faster than the one before: their times are means over the rows of ``lineitem`` that belong to them, of whole numbers, so that both engines get the same doubles
RUNS = """SELECT *, tree + owm AS total FROM (
 SELECT ord, CASE ord WHEN 0 THEN 'baseline' WHEN 1 THEN 'quadtree' ELSE 'parallel' END AS opt, cloud, CAST(quantity AS DOUBLE) / CAST(n AS DOUBLE) / CAST(1 + 2 * ord AS DOUBLE) AS tree, CAST(price AS DOUBLE) / CAST(n AS DOUBLE) / CAST(1000 + 1000 * ord AS DOUBLE) AS owm
 FROM (SELECT CAST(l_linenumber % 3 AS INT) AS ord, substr('abcd', CAST(l_suppkey % 4 AS INT) + 1, 1) AS cloud, count(*) AS n, sum(CAST(l_quantity AS INT)) AS quantity, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS price FROM lineitem GROUP BY 1, 2) AS g) AS t"""
#: a sweep of threads and radius on two hosts and clouds, likewise
SWEEP = """SELECT host, cloud, threads, CAST(least + 0.0 AS DOUBLE) / CAST(10 AS DOUBLE) AS radius, CAST(quantity AS DOUBLE) / CAST(n AS DOUBLE) / CAST(threads AS DOUBLE) + CAST(abs(least - 11) AS DOUBLE) / CAST(10 AS DOUBLE) AS seconds, CAST(99 AS DOUBLE) + CAST(quantity % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS accuracy
 FROM (SELECT substr('xy', CAST(l_orderkey % 2 AS INT) + 1, 1) AS host, substr('ab', CAST(l_partkey % 2 AS INT) + 1, 1) AS cloud, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AS threads, CASE l_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 11 ELSE 20 END AS least, count(*) AS n, sum(CAST(l_quantity AS INT)) AS quantity FROM lineitem GROUP BY 1, 2, 3, 4) AS g"""
RING = [(2.0, 2.0), (60.0, 5.0), (70.0, 50.0), (35.0, 30.0), (10.0, 70.0)]


def _values(rows: list[tuple]) -> str:
    # as doubles, not decimals
    lit = lambda v: f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


RUNS_SQL = f"WITH r AS ({RUNS})"
SWEEP_SQL = f"WITH r AS ({SWEEP})"


def _of_lineitem(s, d, sql):
    return s.sql(sql.replace("FROM lineitem", "FROM {rows}"), rows=s.read.parquet(f"{d}/lineitem.parquet"))


def runs(s, d):
    return _of_lineitem(s, d, RUNS)


def sweep(s, d):
    return _of_lineitem(s, d, SWEEP)


def r6(df, digits: int = 6):
    return df.select(*[(F.round(k, digits) + 0.0).alias(k) if t == "double" else F.col(k) for k, t in df.dtypes])


def speedups(s, d):
    return bt.speedup_vs_baseline(runs(s, d), "baseline", "opt", "cloud", "total").join(runs(s, d).select("opt", "cloud", "ord"), ["opt", "cloud"])


def xyz():
    """Columns; made when a query is, as they need a session."""
    return F.col("x"), F.col("y"), F.col("z")


def _lines(s, d):
    x, y, z = xyz()
    ix, iy = c.line_intersection((0.0, 0.0, x, y), (0.0, 40.0, y, x + 1))
    nx, ny = c.nearest_on_line(x, y, 10.0, 5.0, 70.0, 60.0)
    mx, my = c.midpoint(x, y, 43.0, 43.0)
    rx, ry = c.rotate(x, y, 0.5)
    tx, ty = c.moved(x, y, 3.0, 4.0, 2.5)
    a, b, k = c.line_coefficients(10.0, 5.0, x, y)
    cols = dict(dist=c.point_line_distance(x, y, 10.0, 5.0, 70.0, 60.0), ix=ix, iy=iy, nx=nx, ny=ny, mx=mx, my=my, rx=rx, ry=ry, tx=tx, ty=ty, la=a, lb=b, lc=k, d=F.sqrt(c.distance2(x, y, 43.0, 43.0)))
    return r6(points(s, d).select("id", *[v.alias(n) for n, v in cols.items()]), 4)


def _vectors(s, d):
    x, y, z = xyz()
    a, b = (x, y, z), (1.0, 2.0, 2.0)
    u, v, w = c.cross(a, b)
    n1, n2, n3 = c.normalized(a)
    g1, g2, g3 = c.axis_angles((x + 1, y + 1, z + 1))
    cols = dict(dot=c.dot(a, b), cx=u, cy=v, cz=w, norm2=c.norm((x, y)), norm3=c.norm(a), n1=n1, n2=n2, n3=n3, g1=g1, g2=g2, g3=g3)
    cols |= dict(plain=c.angle2(x - 43, y - 43), half=c.angle2(x - 43, y - 43, "half"), full=c.angle2(x - 43, y - 43, "full"))
    return r6(points(s, d).select("id", *[e.alias(n) for n, e in cols.items()]), 4)


def _vector_ops(s, d):
    x, y, z = xyz()
    a, b = (x, y, z), (1.5, -2.0, 0.25)
    p, q = c.perpendicular((x, y))
    named = {"a": c.added(a, b), "s": c.subtracted(a, b), "m": c.scaled_by(a, 2.5), "o": c.to_origin(a, (43.0, 43.0, 100.0))}
    cols = {f"{k}{v}": e for k, own in named.items() for v, e in zip("xyz", own, strict=True)} | {"px": p, "py": q}
    # 1 / x is no finite number where x is 0
    cols["inverse"] = c.number(F.when(x == 0, F.lit(float("inf"))).otherwise(1 / x))
    return r6(points(s, d).select("id", *[e.alias(n) for n, e in cols.items()]), 6)


def _system():
    """A symmetric 3x3 matrix of a point's coordinates."""
    x, y, z = xyz()
    return [[x + 5, y, 1.0], [y, z + 7, 1.0], [1.0, 1.0, 9.0]]


def _matrix_ops(s, d):
    a = _system()
    low, up = mx.lu(a)
    b = [[1.0, 2.0, 0.5], [0.0, -1.0, 3.0], [4.0, 0.25, 1.0]]
    inv, prod, turned, both = mx.inverse(a), mx.mat_mat(a, b), mx.transpose(b), mx.mat_sum(a, b)
    v = list(xyz())
    cols = {f"l{r}{k}": low[r][k] for r in range(3) for k in range(r)} | {f"u{r}{k}": up[r][k] for r in range(3) for k in range(r, 3)}
    cols |= {f"i{r}{k}": inv[r][k] for r in range(3) for k in range(3)} | {f"p{r}{k}": prod[r][k] for r in range(3) for k in range(3)}
    cols |= {f"v{r}": e for r, e in enumerate(mx.mat_vec(turned, v))} | {f"o{r}{k}": e for r, row in enumerate(mx.outer(v, v)) for k, e in enumerate(row) if k >= r} | {f"s{r}": both[r][r] for r in range(3)}
    return r6(points3(s, d).select("id", *[e.alias(n) for n, e in cols.items()]), 6)


def _solve(s, d):
    flat = F.array(*[c.num(v) for row in _system() for v in row])
    got = points3(s, d).select("id", mx.solved(flat, F.array(*xyz())).alias("s"))
    return r6(got.select("id", *[F.get("s", F.lit(i)).alias(n) for i, n in enumerate("uvw")]), 4)


def _normals(s, d):
    """What makes a normal one: its length, its side, and that the scatter matrix only shortens it, by the least eigenvalue."""
    g = geo.eigen_normals(points3(s, d), 0.5)
    m, v = [["xx", "xy", "xz"], ["xy", "yy", "yz"], ["xz", "yz", "zz"]], [F.col(k) for k in ("nx", "ny", "nz")]
    turned = mx.mat_vec([[F.col(k) for k in row] for row in m], v)
    least = c.dot(tuple(turned), tuple(v))
    off = c.norm(tuple(t - least * u for t, u in zip(turned, v, strict=True)))
    return r6(g.select("id", "n", F.round(c.norm(tuple(v)), 6).alias("size"), (F.col("nz") >= 0).alias("up"), least.alias("least"), F.round(off, 6).alias("off")), 5)


def _tests(s, d):
    x, y, z = xyz()
    cols = dict(r2=c.round2(x / 7), onrange=c.on_range(x, 10, 20), onint=c.on_intensity(z, x, 0.2), diff=c.differs_in_range(x, y, 0.1), deg=c.on_degree(x * 10, y * 10, 5.0), inside=c.in_polygon(x, y, RING), turn=F.round(c.ccw(10.0, 5.0, 70.0, 60.0, x, y), 4))
    return points(s, d).select("id", *[v.alias(n) for n, v in cols.items()])


def _polygon(s, d):
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in RING])
    # one ring per group: the literal one, moved
    g = points(s, d).select("g_id").distinct().withColumn("ring", F.transform(ring, lambda v: F.struct((v["x"] * F.col("g_id")).alias("x"), (v["y"] + F.col("g_id")).alias("y"))))
    cx, cy = c.centroid(F.col("ring"))
    return r6(g.select("g_id", (c.shoelace2(F.col("ring")) / 2).alias("area"), c.perimeter(F.col("ring")).alias("perimeter"), cx.alias("cx"), cy.alias("cy")), 4)


def _plane(s, d):
    fit = st.plane_fit(points(s, d), "z", "g_id")
    a, b, k = c.plane_normal(F.col("a"), F.col("b"))
    return r6(fit.select("g_id", "a", "b", "c", a.alias("na"), b.alias("nb"), k.alias("nc"), c.plane_distance(10.0, 20.0, 30.0, F.col("a"), F.col("b"), F.col("c")).alias("dist")), 4)


def _eigen(s, d):
    g = st.scatter(points3(s, d), "g_id")
    cov = [F.col(k) / F.col("n") for k in ("xx", "xy", "xz", "yy", "yz", "zz")]
    e = c.eigenvalues3(*cov)
    # sums of the eigenvalues, of their squares and their product are the trace, the squared norm and the determinant
    return r6(g.select("g_id", (e[0] + e[1] + e[2]).alias("trace"), (e[0] * e[0] + e[1] * e[1] + e[2] * e[2]).alias("norm2"), (e[0] * e[1] * e[2]).alias("det")), 6)


def _polar(s, d):
    x, y, z = xyz()
    (ax, ay), (bx, by) = c.polar_pair(x, y, z, 0.5)
    (sx, sy), (tx, ty) = c.segment_ends(x, y, 3.0, 4.0, 2.5)
    cols = dict(ax=ax, ay=ay, bx=bx, qy=by, sx=sx, sy=sy, tx=tx, ty=ty)
    return r6(points(s, d).select("id", *[v.alias(n) for n, v in cols.items()]), 4)


def _patch(s, d):
    x, y, z = xyz()
    corners = c.plane_patch((x, y, z), (x + 3, y + 4, z + 1), (0.0, 0.0, 1.0))
    return r6(points(s, d).select("id", *[v.alias(f"{a}{i}") for i, k in enumerate(corners) for a, v in zip("xyz", k, strict=True)]), 4)


HULL = [(10.0, 10.0), (60.0, 5.0), (70.0, 50.0), (35.0, 70.0)]

QUERIES = {
    "argmin_z": lambda s, d: st.lowest(points(s, d)),
    "intensity_range": lambda s, d: points(s, d).agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi")),
    "intensity_normalized": lambda s, d: r6(st.normalized(points(s, d).select("id", "intensity"), "intensity")),
    "stddev_pop_z": lambda s, d: r6(points(s, d).groupBy("g_id").agg(F.stddev_pop("z").alias("sd"), F.avg("z").alias("mean")), 4),
    "timing_stats": lambda s, d: r6(runs(s, d).filter("ord > 0").groupBy("cloud").agg(F.avg("total").alias("mean"), F.var_samp("total").alias("variance"), F.stddev_samp("total").alias("sd"))),
    "scatter_matrix": lambda s, d: r6(st.scatter(points3(s, d), "g_id"), 6),
    "distinct_ids": lambda s, d: points(s, d).select("intensity").distinct(),
    "sort_by_size": lambda s, d: points(s, d).groupBy("g_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g_id"),
    "has_value": lambda s, d: st.values_of(points(s, d), "g_id", "intensity", 7),
    "best_config": lambda s, d: bt.best_config(sweep(s, d), ["host", "cloud"], ["threads", "radius"], "seconds"),
    "best_optimization": lambda s, d: r6(bt.best_optimization(runs(s, d), "opt", "total"), 8),
    "speedup_vs_baseline": lambda s, d: r6(bt.speedup_vs_baseline(runs(s, d), "baseline", "opt", "cloud", "total")),
    "speedup_vs_previous": lambda s, d: r6(bt.speedup_vs_previous(runs(s, d), "ord", "opt", "cloud", "total")),
    "speedup_sum": lambda s, d: r6(speedups(s, d).groupBy("cloud").agg(F.sum("speedup").alias("speedup"))),
    "speedup_pct_of_max": lambda s, d: r6(bt.percent_of_max(speedups(s, d), "ord", "opt", "cloud")),
    "filter_opts": lambda s, d: runs(s, d).filter(F.col("cloud").isin("a", "c") & ~F.col("opt").rlike("^base")).select("opt", "cloud", "tree", "owm"),
    "efficiency_loss": lambda s, d: r6(bt.efficiency_loss(sweep(s, d).filter("threads = 8"), "cloud", "radius", "seconds")),
    "efficiency_best": lambda s, d: r6(bt.efficiency_loss(sweep(s, d).filter("threads = 8"), "cloud", "radius", "seconds").agg(F.max(F.struct("efficiency", "radius")).alias("m")).select("m.radius", "m.efficiency")),
    "cross_host_best": lambda s, d: r6(bt.cross_host_best(runs(s, d).withColumn("host", F.when(F.col("cloud").isin("a", "b"), "x").otherwise("y")), "host", "opt", "total", ("quadtree", "parallel"))),
    "accuracy_range": lambda s, d: sweep(s, d).groupBy("cloud").agg(F.min("accuracy").alias("lo"), F.max("accuracy").alias("hi")),
    "linear_fit": lambda s, d: r6(st.line_fit(sweep(s, d), "threads", "seconds", "cloud")),
    "parabola_fit": lambda s, d: r6(st.parabola_fit(sweep(s, d), "radius", "seconds", "cloud"), 4),
    "cubic_fit": lambda s, d: r6(st.polynomial_fit(points(s, d), "x", "z", 3, "g_id"), 7),
    "exponential_curve_fit": lambda s, d: r6(st.exponential_fit(sweep(s, d), "threads", "seconds", "cloud"), 6),
    "exponential_fit": lambda s, d: r6(st.line_fit(sweep(s, d).withColumn("logged", F.log("seconds")), "threads", "logged", "cloud"), 6),
    "line_geometry": _lines,
    "vector_geometry": _vectors,
    "vector_ops": _vector_ops,
    "matrix_ops": _matrix_ops,
    "scalar_tests": _tests,
    "polygon_measures": _polygon,
    "plane_fit": _plane,
    "eigenvalues": _eigen,
    "bounding_cube": lambda s, d: points(s, d).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.max("z") - F.min("z")).alias("width")),
    "discretize_segments": lambda s, d: r6(geo.discretized(points(s, d).select("id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")), 10.0), 4),
    "curve_points": lambda s, d: r6(geo.fitted_curve(points(s, d), "g_id"), 4),
    "polar_points": _polar,
    "plane_patch": _patch,
    "in_hull": lambda s, d: points(s, d).filter(c.in_hull(F.col("x"), F.col("y"), HULL)).select("id"),
    # whole hundredths, so that three points in line are so in doubles too
    "convex_hull": lambda s, d: geo.convex_hull(points(s, d).select("g_id", F.round(F.col("x") * 100).alias("x"), F.round(F.col("y") * 100).alias("y")), "g_id").select("g_id", F.explode("hull").alias("p")).select("g_id", "p.x", "p.y"),
    "eigen_normals": _normals,
    "linear_solve": _solve,
}


def _r(e: str, n: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0 AS {n}"


_L = "CAST(10 AS DOUBLE)", "CAST(5 AS DOUBLE)", "CAST(70 AS DOUBLE)", "CAST(60 AS DOUBLE)"
_DET = "(y * (0 - y) - (x + 1 - 40) * (0 - x))"
_T = "(((x - 10) * 60 + (y - 5) * 55) / CAST(6625 AS DOUBLE))"
_C, _S = math.cos(0.5), math.sin(0.5)
_ANG = lambda more: f"CASE WHEN atan2(y - 43, x - 43) < 0 THEN atan2(y - 43, x - 43) + CAST({more} AS DOUBLE) ELSE atan2(y - 43, x - 43) END"
_CROSSES = " + ".join(f"CASE WHEN ((CAST({a[1]} AS DOUBLE) > y) <> (CAST({b[1]} AS DOUBLE) > y)) AND x < (y - CAST({a[1]} AS DOUBLE)) * CAST({(b[0] - a[0]) / (b[1] - a[1])!r} AS DOUBLE) + CAST({a[0]} AS DOUBLE) THEN 1 ELSE 0 END" for a, b in zip(RING, RING[1:] + RING[:1], strict=True))
_RINGS = P + ", v AS (SELECT * FROM " + _values([(i, *r) for i, r in enumerate(RING)]) + " AS t(i, x, y)), g AS (SELECT DISTINCT g_id FROM p), r AS (SELECT g_id, i, v.x * g_id AS ax, v.y + g_id AS ay FROM v, g), e AS (SELECT a.g_id, a.ax, a.ay, b.ax AS bx, b.ay AS qy FROM r a JOIN r b ON a.g_id = b.g_id AND b.i = (a.i + 1) % 5)"
_N3 = "sqrt(x * x + y * y + z * z)"
_M3 = "sqrt((x + 1) * (x + 1) + (y + 1) * (y + 1) + (z + 1) * (z + 1))"
_FIT = P + ", f AS (SELECT g_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mt, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, z) AS xt, covar_pop(y, z) AS yt FROM p GROUP BY g_id), f2 AS (SELECT *, (xt * yy - xy * yt) / (xx * yy - xy * xy) AS a, (xx * yt - xt * xy) / (xx * yy - xy * xy) AS b FROM f), f3 AS (SELECT *, mt - a * mx - b * my AS c, sqrt(a * a + b * b + 1) AS s FROM f2)"
_COV = E3 + ", q AS (SELECT g_id, " + ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))) + " FROM p GROUP BY g_id)"
_SP = RUNS_SQL + ", sp AS (SELECT r.ord, r.opt, r.cloud, b.total / r.total AS speedup FROM r JOIN r b ON b.cloud = r.cloud AND b.opt = 'baseline')"



def _det4(k: int | None = None) -> str:
    """The determinant of the cubic's normal equations, with the right side in column ``k``."""
    cell = lambda r, c: f"t{r}" if c == k else f"s{r + c}"
    even = lambda p: sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2 == 0
    return "0" + "".join(f" {'+' if even(p) else '-'} {' * '.join(cell(r, c) for r, c in enumerate(p))}" for p in itertools.permutations(range(4)))


ORACLES = {
    "argmin_z": P + " SELECT z, id FROM p ORDER BY z, id LIMIT 1",
    "intensity_range": P + " SELECT min(intensity) AS lo, max(intensity) AS hi FROM p",
    "intensity_normalized": f"{P} SELECT id, intensity, {_r('(intensity - (SELECT min(intensity) FROM p)) / ((SELECT max(intensity) FROM p) - (SELECT min(intensity) FROM p))', 'scaled')} FROM p",
    "stddev_pop_z": f"{P} SELECT g_id, {_r('stddev_pop(z)', 'sd', 4)}, {_r('avg(z)', 'mean', 4)} FROM p GROUP BY g_id",
    "timing_stats": f"{RUNS_SQL} SELECT cloud, {_r('avg(total)', 'mean')}, {_r('var_samp(total)', 'variance')}, {_r('stddev_samp(total)', 'sd')} FROM r WHERE ord > 0 GROUP BY cloud",
    "scatter_matrix": f"{E3} SELECT g_id, count(*) AS n, " + ", ".join(_r(f"covar_pop({a}, {b}) * count(*)", a + b) for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))) + " FROM p GROUP BY g_id",
    "distinct_ids": P + " SELECT DISTINCT intensity FROM p",
    "sort_by_size": P + " SELECT g_id, count(*) AS n FROM p GROUP BY g_id",
    "has_value": P + " , v AS (SELECT g_id, list_sort(list(DISTINCT intensity)) AS v FROM p GROUP BY g_id) SELECT g_id, coalesce(list_position(v, 7), 0) - 1 AS at, len(list_filter(v, lambda q: q <> 7)) AS left FROM v",
    "best_config": SWEEP_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY host, cloud ORDER BY seconds, threads, radius) AS rn FROM r) SELECT host, cloud, threads, radius, seconds FROM k WHERE rn = 1",
    "best_optimization": f"{RUNS_SQL} SELECT opt, {_r('avg(total)', 'mean', 8)} FROM r GROUP BY opt ORDER BY avg(total), opt LIMIT 1",
    "speedup_vs_baseline": f"{_SP} SELECT opt, cloud, {_r('speedup', 'speedup')} FROM sp",
    "speedup_vs_previous": f"{RUNS_SQL} SELECT opt, cloud, {_r('lag(total) OVER (PARTITION BY cloud ORDER BY ord) / total', 'speedup')} FROM r",
    "speedup_sum": f"{_SP} SELECT cloud, {_r('sum(speedup)', 'speedup')} FROM sp GROUP BY cloud",
    "speedup_pct_of_max": f"{_SP}, q AS (SELECT *, speedup / max(speedup) OVER (PARTITION BY cloud) * 100 AS percent FROM sp) SELECT opt, cloud, {_r('percent', 'percent')}, {_r('percent - coalesce(lag(percent) OVER (PARTITION BY cloud ORDER BY ord), 0)', 'added')} FROM q",
    "filter_opts": RUNS_SQL + " SELECT opt, cloud, tree, owm FROM r WHERE cloud IN ('a', 'c') AND NOT regexp_matches(opt, '^base')",
    "efficiency_loss": f"{SWEEP_SQL}, q AS (SELECT *, min(seconds) OVER (PARTITION BY cloud) / seconds AS e FROM r WHERE threads = 8) SELECT radius, {_r('avg(e)', 'efficiency')} FROM q GROUP BY radius",
    "efficiency_best": f"{SWEEP_SQL}, q AS (SELECT *, min(seconds) OVER (PARTITION BY cloud) / seconds AS e FROM r WHERE threads = 8) SELECT radius, {_r('avg(e)', 'efficiency')} FROM q GROUP BY radius ORDER BY avg(e) DESC, radius DESC LIMIT 1",
    "cross_host_best": f"{RUNS_SQL}, m AS (SELECT CASE WHEN cloud IN ('a', 'b') THEN 'x' ELSE 'y' END AS host, opt, avg(total) AS mean FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY mean, opt) AS rn FROM m WHERE opt IN ('quadtree', 'parallel')) SELECT host, opt, {_r('mean', 'mean')} FROM m WHERE opt NOT IN ('quadtree', 'parallel') OR EXISTS (SELECT 1 FROM k WHERE k.host = m.host AND k.opt = m.opt AND rn = 1)",
    "accuracy_range": SWEEP_SQL + " SELECT cloud, min(accuracy) AS lo, max(accuracy) AS hi FROM r GROUP BY cloud",
    "linear_fit": f"{SWEEP_SQL} SELECT cloud, {_r('regr_slope(seconds, threads)', 'slope')}, {_r('regr_intercept(seconds, threads)', 'intercept')} FROM r GROUP BY cloud",
    "exponential_fit": f"{SWEEP_SQL} SELECT cloud, {_r('regr_slope(ln(seconds), threads)', 'slope')}, {_r('regr_intercept(ln(seconds), threads)', 'intercept')} FROM r GROUP BY cloud",
    "parabola_fit": f"{SWEEP_SQL}, f AS (SELECT cloud, avg(radius) AS m1, avg(radius * radius) AS m2, avg(seconds) AS my, covar_pop(radius, radius) AS xx, covar_pop(radius * radius, radius) AS xu, covar_pop(radius * radius, radius * radius) AS uu, covar_pop(radius, seconds) AS xt, covar_pop(radius * radius, seconds) AS ut FROM r GROUP BY cloud), k AS (SELECT *, (ut * xx - xt * xu) / (uu * xx - xu * xu) AS a, (xt * uu - ut * xu) / (uu * xx - xu * xu) AS b FROM f) SELECT cloud, {_r('a', 'a', 4)}, {_r('b', 'b', 4)}, {_r('my - b * m1 - a * m2', 'c', 4)} FROM k",
    "linear_solve": f"{E3}, k AS (SELECT *, (x + 5) * ((z + 7) * 9 - 1) - y * (y * 9 - 1) + (y - (z + 7)) AS det FROM p) SELECT id, {_r('(x * ((z + 7) * 9 - 1) - y * (y * 9 - z) + (y - (z + 7) * z)) / det', 'u', 4)}, {_r('((x + 5) * (y * 9 - z) - x * (y * 9 - 1) + (y * z - y)) / det', 'v', 4)}, {_r('((x + 5) * ((z + 7) * z - y) - y * (y * z - y) + x * (y - (z + 7))) / det', 'w', 4)} FROM k",
    "line_geometry": f"{P} SELECT id, " + ", ".join(_r(e, n, 4) for n, e in {
        "dist": "abs(55 * x - 60 * y + 70 * 5 - 60 * 10) / sqrt(CAST(6625 AS DOUBLE))",
        "ix": f"CASE WHEN {_DET} <> 0 THEN (0 - (0 - x) * ((x + 1 - 40) * 0 + (0 - y) * 40)) / {_DET} END", "iy": f"CASE WHEN {_DET} <> 0 THEN (y * ((0 - y) * 40)) / {_DET} END",
        "nx": f"10 + {_T} * 60", "ny": f"5 + {_T} * 55", "mx": "(x + 43) / 2", "my": "(y + 43) / 2",
        "rx": f"x * CAST({_C!r} AS DOUBLE) - y * CAST({_S!r} AS DOUBLE)", "ry": f"x * CAST({_S!r} AS DOUBLE) + y * CAST({_C!r} AS DOUBLE)", "tx": "x + CAST(1.5 AS DOUBLE)", "ty": "y + CAST(2.0 AS DOUBLE)",
        "la": "y - 5", "lb": "10 - x", "lc": "(y - 5) * 10 + (10 - x) * 5", "d": "sqrt((x - 43) * (x - 43) + (y - 43) * (y - 43))"}.items()) + " FROM p",
    "vector_geometry": f"{P} SELECT id, " + ", ".join(_r(e, n, 4) for n, e in {
        "dot": "x + 2 * y + 2 * z", "cx": "y * 2 - z * 2", "cy": "z - x * 2", "cz": "x * 2 - y", "norm2": "sqrt(x * x + y * y)", "norm3": _N3,
        "n1": f"CASE WHEN {_N3} > 0 THEN x / {_N3} END", "n2": f"CASE WHEN {_N3} > 0 THEN y / {_N3} END", "n3": f"CASE WHEN {_N3} > 0 THEN z / {_N3} END", "g1": f"degrees(acos((x + 1) / {_M3}))", "g2": f"degrees(acos((y + 1) / {_M3}))", "g3": f"degrees(acos((z + 1) / {_M3}))",
        "plain": "atan2(y - 43, x - 43)", "half": _ANG(math.pi), "full": _ANG(2 * math.pi)}.items()) + " FROM p",
    "scalar_tests": f"{P} SELECT id, floor(x / 7 * 100 + 0.5) / 100 AS r2, x >= 10 AND x <= 20 AS onrange, abs(z - x) <= greatest(z, x) * CAST(0.2 AS DOUBLE) AS onint, abs(x - y) < (x + y) / 2 * CAST(0.1 AS DOUBLE) AS diff, least(abs(x * 10 - y * 10) % 360, 360 - abs(x * 10 - y * 10) % 360) <= 5 AS deg, ({_CROSSES}) % 2 = 1 AS inside, round(60 * (y - 5) - 55 * (x - 10), 4) AS turn FROM p",
    "polygon_measures": f"{_RINGS}, k AS (SELECT g_id, sum(ax * qy - bx * ay) AS a2, sum(sqrt((ax - bx) * (ax - bx) + (ay - qy) * (ay - qy))) AS pe, sum((ax + bx) * (ax * qy - bx * ay)) AS sx, sum((ay + qy) * (ax * qy - bx * ay)) AS sy FROM e GROUP BY g_id) SELECT g_id, {_r('a2 / 2', 'area', 4)}, {_r('pe', 'perimeter', 4)}, {_r('sx / (a2 * 3)', 'cx', 4)}, {_r('sy / (a2 * 3)', 'cy', 4)} FROM k",
    "plane_fit": f"{_FIT} SELECT g_id, {_r('a', 'a', 4)}, {_r('b', 'b', 4)}, {_r('c', 'c', 4)}, {_r('-a / s', 'na', 4)}, {_r('-b / s', 'nb', 4)}, {_r('1 / s', 'nc', 4)}, {_r('abs(a * 10 + b * 20 - 30 + c) / s', 'dist', 4)} FROM f3",
    "eigenvalues": f"{_COV} SELECT g_id, {_r('xx + yy + zz', 'trace')}, {_r('xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)', 'norm2')}, {_r('xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)', 'det')} FROM q",
    "bounding_cube": P + " SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS width FROM p",
    "discretize_segments": f"{P}, k AS (SELECT id, x, y, sqrt(x * x + y * y) AS len FROM p), s AS (SELECT *, unnest(range(1, CAST(floor(len / 10) AS BIGINT) + 1)) AS step FROM k) SELECT id, step, {_r('x / len * step * 10', 'x', 4)}, {_r('y / len * step * 10', 'y', 4)} FROM s",
    "curve_points": f"{P}, f AS (SELECT g_id, avg(x) AS m1, avg(x * x) AS m2, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x * x, x) AS xu, covar_pop(x * x, x * x) AS uu, covar_pop(x, y) AS xt, covar_pop(x * x, y) AS ut, min(x) AS lo, max(x) AS hi, avg(z) AS z FROM p GROUP BY g_id), k AS (SELECT *, (ut * xx - xt * xu) / (uu * xx - xu * xu) AS a, (xt * uu - ut * xu) / (uu * xx - xu * xu) AS b FROM f), h AS (SELECT *, my - b * m1 - a * m2 AS c, floor((hi - lo) / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) < 10 AS short FROM k), e AS (SELECT *, unnest(range(0, CASE WHEN short THEN 20 ELSE CAST(floor((hi - lo) / CAST(0.5 AS DOUBLE)) AS BIGINT) END)) AS i FROM h), w AS (SELECT *, CASE WHEN short THEN m1 - 5 ELSE lo END + CAST(0.5 AS DOUBLE) * i AS x FROM e) SELECT g_id, i, {_r('x', 'x', 4)}, {_r('a * x * x + b * x + c', 'y', 4)}, {_r('z', 'z', 4)} FROM w",
    "polar_points": f"{P} SELECT id, " + ", ".join(_r(e, n, 4) for n, e in {"ax": f"x + z * CAST({_C!r} AS DOUBLE) - CAST({_S!r} AS DOUBLE)", "ay": f"y + z * CAST({_S!r} AS DOUBLE) + CAST({_C!r} AS DOUBLE)", "bx": f"x + z * CAST({_C!r} AS DOUBLE) + CAST({_S!r} AS DOUBLE)", "qy": f"y + z * CAST({_S!r} AS DOUBLE) - CAST({_C!r} AS DOUBLE)", "sx": "x + CAST(1.5 AS DOUBLE)", "sy": "y + CAST(2 AS DOUBLE)", "tx": "x - CAST(1.5 AS DOUBLE)", "ty": "y - CAST(2 AS DOUBLE)"}.items()) + " FROM p",
    "plane_patch": f"{P} SELECT id, " + ", ".join(_r(f"{v} + (CAST({t} AS DOUBLE) * {a} + CAST({u} AS DOUBLE) * {b}) * CAST(7.5 AS DOUBLE)", f"{v}{i}", 4) for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))) for v, t, u in (("x", 0.6, 0.8), ("y", 0.8, -0.6), ("z", 0.2, 0.0))) + " FROM p",
    "in_hull": f"{P} SELECT id FROM p WHERE " + " AND ".join(f"({b[0] - a[0]}) * (y - {a[1]}) - ({b[1] - a[1]}) * (x - {a[0]}) >= 0" for a, b in zip(HULL, HULL[1:], strict=False)),
    "vector_ops": f"{P} SELECT id, " + ", ".join(_r(e, n) for n, e in {
        **{f"a{v}": f"{v} + CAST({b} AS DOUBLE)" for v, b in zip("xyz", (1.5, -2.0, 0.25), strict=True)}, **{f"s{v}": f"{v} - CAST({b} AS DOUBLE)" for v, b in zip("xyz", (1.5, -2.0, 0.25), strict=True)},
        **{f"m{v}": f"{v} * CAST(2.5 AS DOUBLE)" for v in "xyz"}, **{f"o{v}": f"{v} - {b}" for v, b in zip("xyz", (43, 43, 100), strict=True)}, "px": "-y", "py": "x", "inverse": "CASE WHEN x <> 0 THEN 1 / x END"}.items()) + " FROM p",
    "matrix_ops": f"{E3}, k AS (SELECT *, x + 5 AS a, z + 7 AS e FROM p), d AS (SELECT *, a * (e * 9 - 1) - y * (y * 9 - 1) + (y - e) AS det, e - y / a * y AS u11 FROM k) SELECT id, " + ", ".join(_r(e, n) for n, e in {
        "l10": "y / a", "l20": "1 / a", "l21": "(1 - y / a) / u11", "u00": "a", "u01": "y", "u02": "CAST(1 AS DOUBLE)", "u11": "u11", "u12": "1 - y / a", "u22": "9 - 1 / a - (1 - y / a) * (1 - y / a) / u11",
        "i00": "(e * 9 - 1) / det", "i01": "(1 - y * 9) / det", "i02": "(y - e) / det", "i10": "(1 - y * 9) / det", "i11": "(a * 9 - 1) / det", "i12": "(y - a) / det", "i20": "(y - e) / det", "i21": "(y - a) / det", "i22": "(a * e - y * y) / det",
        "p00": "a + 4", "p01": "2 * a - y + CAST(0.25 AS DOUBLE)", "p02": "a * CAST(0.5 AS DOUBLE) + 3 * y + 1", "p10": "y + 4", "p11": "2 * y - e + CAST(0.25 AS DOUBLE)", "p12": "y * CAST(0.5 AS DOUBLE) + 3 * e + 1", "p20": "CAST(37 AS DOUBLE)", "p21": "CAST(3.25 AS DOUBLE)", "p22": "CAST(12.5 AS DOUBLE)",
        "v0": "x + 4 * z", "v1": "2 * x - y + CAST(0.25 AS DOUBLE) * z", "v2": "CAST(0.5 AS DOUBLE) * x + 3 * y + z", "o00": "x * x", "o01": "x * y", "o02": "x * z", "o11": "y * y", "o12": "y * z", "o22": "z * z", "s0": "a + 1", "s1": "e - 1", "s2": "CAST(10 AS DOUBLE)"}.items()) + " FROM d",
    "cubic_fit": P + ", m AS (SELECT g_id, avg(x) AS m FROM p GROUP BY g_id), u AS (SELECT p.g_id, m, x - m AS u, z FROM p JOIN m ON m.g_id = p.g_id), s AS (SELECT g_id, any_value(m) AS m, " + ", ".join(f"sum({'*'.join(['u'] * k) or 'CAST(1 AS DOUBLE)'}) AS s{k}" for k in range(7)) + ", " + ", ".join(f"sum({'*'.join(['u'] * k + ['z'])}) AS t{k}" for k in range(4)) + " FROM u GROUP BY g_id), q AS (SELECT g_id, m, " + ", ".join(f"({_det4(k)}) / ({_det4()}) AS k{k}" for k in range(4)) + f" FROM s) SELECT g_id, {_r('k3', 'a', 7)}, {_r('k2 - 3 * m * k3', 'b', 7)}, {_r('k1 - 2 * m * k2 + 3 * m * m * k3', 'c', 7)}, {_r('k0 - m * k1 + m * m * k2 - m * m * m * k3', 'd', 7)} FROM q",
    "exponential_curve_fit": SWEEP_SQL.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + f", h AS (SELECT cloud, CAST(threads AS DOUBLE) AS x, seconds AS y FROM r), g AS (SELECT cloud, 0 AS step, exp(regr_intercept(ln(y), x)) AS a, regr_slope(ln(y), x) AS b FROM h GROUP BY cloud UNION ALL SELECT cloud, step + 1, a + (er * ff - ef * fr) / (ee * ff - ef * ef), b + (ee * fr - er * ef) / (ee * ff - ef * ef) FROM (SELECT g.cloud, step, a, b, sum(exp(2 * b * x)) AS ee, sum(a * x * exp(2 * b * x)) AS ef, sum(a * x * a * x * exp(2 * b * x)) AS ff, sum((y - a * exp(b * x)) * exp(b * x)) AS er, sum((y - a * exp(b * x)) * a * x * exp(b * x)) AS fr FROM g JOIN h ON h.cloud = g.cloud WHERE step < 60 GROUP BY g.cloud, step, a, b)) SELECT cloud, {_r('a', 'a')}, {_r('b', 'b')} FROM g WHERE step = 60",
    "convex_hull": P + """, q AS (SELECT DISTINCT g_id, round(x * 100) AS x, round(y * 100) AS y FROM p),
w AS (SELECT *, min(y) OVER a AS la, max(y) OVER a AS ha, min(y) OVER b AS lb, max(y) OVER b AS hb FROM q WINDOW a AS (PARTITION BY g_id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY g_id ORDER BY x, y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT g_id, x, y FROM w WHERE la IS NULL OR lb IS NULL OR y <= la OR y >= ha OR y <= lb OR y >= hb)
SELECT a.g_id, a.x, a.y FROM c a WHERE EXISTS (SELECT 1 FROM c b WHERE b.g_id = a.g_id AND (b.x <> a.x OR b.y <> a.y) AND NOT EXISTS (SELECT 1 FROM c r WHERE r.g_id = a.g_id
 AND ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) < 0 OR (b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) = 0 AND (b.x - a.x) * (r.x - a.x) + (b.y - a.y) * (r.y - a.y) < 0)))""",
    "eigen_normals": E3 + f", nb AS (SELECT a.id, count(*) AS n, covar_pop(b.x, b.x) AS xx, covar_pop(b.x, b.y) AS xy, covar_pop(b.x, b.z) AS xz, covar_pop(b.y, b.y) AS yy, covar_pop(b.y, b.z) AS yz, covar_pop(b.z, b.z) AS zz FROM p a JOIN p b ON abs(a.x - b.x) < 1 AND b.x > a.x - CAST(0.5 AS DOUBLE) AND b.x < a.x + CAST(0.5 AS DOUBLE) AND b.y > a.y - CAST(0.5 AS DOUBLE) AND b.y < a.y + CAST(0.5 AS DOUBLE) AND b.z > a.z - CAST(0.5 AS DOUBLE) AND b.z < a.z + CAST(0.5 AS DOUBLE) GROUP BY a.id HAVING count(*) >= 3), q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM nb), s AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM q), h AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * s * s * s) AS h FROM s) SELECT id, n, CAST(1 AS DOUBLE) AS size, true AS up, {_r(f'q + 2 * s * cos(acos(greatest(-1, least(1, h))) / 3 + CAST({2 * math.pi / 3!r} AS DOUBLE))', 'least', 5)}, CAST(0 AS DOUBLE) AS off FROM h",
}
