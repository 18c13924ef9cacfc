"""Overlapping-window minimum: parameters, windows, votes and empty-cell filling.

All boxes are open: a point on an edge is in no box. Ties in z go to the smaller id. The header is a one-row DataFrame that is broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round2, rounded, trunc
from ..functions.ordering import lowest, number_of, order_key
from ..lineage import materialize


@dataclass(frozen=True)
class Setting:
    """Window size w, grid size b (0: no filling), overlap o; half sides are whole unless ``exact``."""

    w: int = 10
    b: int = 20
    o: float = 0.8
    exact: bool = False

    def __post_init__(self) -> None:
        if self.w <= 0 or self.b < 0 or not 0 <= self.o < 1:
            raise ValueError("w must be above 0, b not below 0 and o in [0, 1)")

    @property
    def step(self) -> float:
        return math.floor(self.w * (1 - self.o) * 100 + 0.5) / 100

    @property
    def half(self) -> float:
        return self.w / 2 if self.exact else float(self.w // 2)

    @property
    def half_grid(self) -> float:
        return self.b / 2 if self.exact else float(self.b // 2)


def header(points: DataFrame, axes: str = "xy") -> DataFrame:
    """n and the bounding box of a cloud (minx, maxx, miny, maxy, and z if in ``axes``), one row."""
    return points.agg(F.count("*").alias("n"), *[f(a).alias(f"{name}{a}") for a in axes for name, f in (("min", F.min), ("max", F.max))])


def parameters(points: DataFrame, s: Setting, head: DataFrame | None = None) -> DataFrame:
    """The header with width, height, density, least number of points in a window, and numbers of windows and cells."""
    head = header(points) if head is None else head
    p = head.withColumn("width", round2(F.col("maxx") - F.col("minx"))).withColumn("height", round2(F.col("maxy") - F.col("miny")))
    p = p.withColumn("density", F.col("n") / (F.col("width") * F.col("height")))
    p = p.withColumn("minnum", F.greatest(F.lit(1).cast("long"), trunc(0.5 * F.col("density") * s.w * s.w)))

    def windows(side: str) -> Column:
        return rounded((F.col(side) + 2 * s.w * s.o) / s.step) - 1 if s.o > 0 else F.floor(F.col(side) / s.w).cast("long") + 1

    p = p.withColumn("ncols", windows("width")).withColumn("nrows", windows("height"))
    for name, side in (("gcols", "width"), ("grows", "height")):
        p = p.withColumn(name, F.floor(F.col(side) / s.b).cast("long") + 1 if s.b else F.lit(0).cast("long"))
    return p


def window_centre(i: Column, lo: str, s: Setting) -> Column:
    return F.col(lo) - float(s.w // 2 if not s.exact else s.w / 2) + s.step + i * s.step


def cell_centre(i: Column, lo: str, s: Setting) -> Column:
    return F.col(lo) + s.half_grid + i * float(s.b)


def windows(params: DataFrame, s: Setting) -> DataFrame:
    """i, j and centre of every window."""
    g = params.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ncols") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nrows") - 1)).alias("j"))
    return g.select("i", "j", window_centre(F.col("i"), "minx", s).alias("cx"), window_centre(F.col("j"), "miny", s).alias("cy"))


def with_spans(points: DataFrame, params: DataFrame, s: Setting, clip: bool = True) -> DataFrame:
    """id, x, y, z, ``key`` (the order by z, then id) of points in a window, and the windows i0..i1, j0..j1 whose open extent holds them.

    An estimate is tested against the edges themselves, so spans are exact. Without ``clip`` they go on beyond the first and last window, as if there were more. Estimates, edges and
    spans are columns of their own, step by step: as one expression they make a method that the JVM doesn't compile.
    """
    own = params.select("minx", "miny", "ncols", "nrows")
    base = lambda lo: F.col(lo) - float(s.w // 2 if not s.exact else s.w / 2) + s.step
    j = points.select("id", "x", "y", "z").crossJoin(F.broadcast(own))
    axes = (("x", "minx", "i", "ncols"), ("y", "miny", "j", "nrows"))
    guess = []
    for v, lo, k, _ in axes:
        guess.append((F.floor((F.col(v) - s.half - base(lo)) / s.step) + 1).cast("long").alias(f"_{k}a"))
        guess.append((F.ceil((F.col(v) + s.half - base(lo)) / s.step) - 1).cast("long").alias(f"_{k}b"))
    j = j.select("*", *guess)
    upper = lambda i, lo: window_centre(i, lo, s) + s.half
    lower = lambda i, lo: window_centre(i, lo, s) - s.half
    shifts = []
    for v, lo, k, _ in axes:
        a, b = F.col(f"_{k}a"), F.col(f"_{k}b")
        shifts.append((F.col(f"_{k}a") + F.when(F.col(v) < upper(a - 1, lo), -1).when(F.col(v) < upper(a, lo), 0).otherwise(1)).alias(f"_{k}0"))
        shifts.append((F.col(f"_{k}b") + F.when(F.col(v) > lower(b + 1, lo), 1).when(F.col(v) > lower(b, lo), 0).otherwise(-1)).alias(f"_{k}1"))
    j = j.select("id", "x", "y", "z", "ncols", "nrows", *shifts)
    zero = F.lit(0).cast("long")
    ends = [(F.greatest(F.col(f"_{k}0"), zero) if clip else F.col(f"_{k}0")).alias(f"{k}0") for _, _, k, _ in axes]
    ends += [(F.least(F.col(f"_{k}1"), F.col(n) - 1) if clip else F.col(f"_{k}1")).alias(f"{k}1") for _, _, k, n in axes]
    j = j.select("id", "x", "y", "z", *ends)
    # a filter would be pushed, with all that its columns are made of, into the join; what a null makes no row of is not
    spans = F.when(F.expr("i0 <= i1 AND j0 <= j1"), F.array(F.struct("i0", "i1", "j0", "j1")))
    return j.select("id", "x", "y", "z", order_key("z", "id", "x", "y").alias("key"), F.inline(spans))


def _explode(df: DataFrame, *keep: str) -> DataFrame:
    one = df.select(*keep, F.explode(F.sequence("i0", "i1")).alias("i"), "j0", "j1")
    return one.select(*keep, "i", F.explode(F.sequence("j0", "j1")).alias("j"))


def point_windows(points: DataFrame, params: DataFrame, s: Setting) -> DataFrame:
    """id, z, i, j: each point in each window that holds it."""
    return _explode(with_spans(points, params, s), "id", "z")


def window_stats(points: DataFrame, params: DataFrame, s: Setting, tiled: bool = True) -> DataFrame:
    """i, j, n and the lowest point (z, id, x, y) of every window with points; its coordinates come along, so no later step joins the cloud.

    ``tiled``: points held by the same windows are first reduced to one tile, so tiles are exploded and shuffled, not points.
    """
    each = _explode(tiles(points, params, s) if tiled else with_spans(points, params, s).withColumn("n", F.lit(1).cast("long")), "n", "key")
    got = each.groupBy("i", "j").agg(F.sum("n").alias("n"), *lowest("key", "z", "xy"))
    return got.select("i", "j", "n", "z", number_of("key").alias("id"), "x", "y")


def tiles(points: DataFrame, params: DataFrame, s: Setting) -> DataFrame:
    """i0, i1, j0, j1, n and the lowest point (key, z, x, y) of each set of points that the same windows hold."""
    return with_spans(points, params, s).groupBy("i0", "i1", "j0", "j1").agg(F.count("*").alias("n"), *lowest("key", "z", "xy"))


def _slide(rows: DataFrame, lo: str, hi: str, every: int, by: list[str], name: str) -> DataFrame:
    """(by, ``name``, n, key): for each number between ``lo`` and ``hi`` of any row, the sum of n and the least key of the rows that hold it; intervals of one axis.

    An anchor stands at each multiple of ``every``. A row that holds an anchor is seen by the numbers from there to its ``hi``, of which each needs only the least of the rows that end at it or later,
    and by those from its ``lo`` to there, of which each needs the least of the rows that begin at it or earlier: running sums and minima away from each anchor. As no interval is much longer than
    ``every``, a row holds one or two anchors, and each number looks up two values, however many rows hold it. Rows between two anchors go to their few numbers themselves.
    """
    first, last = F.ceil(F.col(lo) / every).cast("long"), F.floor(F.col(hi) / every).cast("long")
    held = rows.select(*by, lo, hi, "n", "key", first.alias("_first"), last.alias("_last"))
    at = held.filter("_first <= _last").select(*by, lo, hi, "n", "key", F.explode(F.sequence("_first", "_last")).alias("_t"))
    anchor = F.col("_t") * every

    def running(found: DataFrame, end: str, order: Column, start: Column, stop: Column) -> DataFrame:
        away = Window.partitionBy(*by, "_t").orderBy(order)
        got = found.groupBy(*by, "_t", end).agg(F.sum("n").alias("n"), F.min("key").alias("key"))
        got = got.select(*by, "_t", end, F.sum("n").over(away).alias("n"), F.min("key").over(away).alias("key"), F.lead(end).over(away).alias("_next"))
        return got.select(*by, F.explode(F.when(start <= stop, F.sequence(start, stop))).alias(name), "n", "key")

    to_right = running(at, hi, F.desc(hi), F.greatest(F.coalesce(F.col("_next") + 1, anchor), anchor), F.least(F.col(hi), anchor + every - 1))
    before = at.filter((F.col(lo) > anchor - every) & (F.col(lo) < anchor))
    to_left = running(before, lo, F.asc(lo), F.col(lo), F.coalesce(F.col("_next") - 1, anchor - 1))
    short = held.filter("_first > _last").select(*by, F.explode(F.sequence(lo, hi)).alias(name), "n", "key")
    return to_right.unionByName(to_left).unionByName(short).groupBy(*by, name).agg(F.sum("n").alias("n"), F.min("key").alias("key"))


def sliding_stats(points: DataFrame, params: DataFrame, s: Setting) -> DataFrame:
    """The same as ``window_stats`` by sliding minima and sums, along x and then along y: what is shuffled for a tile doesn't grow with the overlap."""
    every = max(1, math.ceil(2 * s.half / s.step) - 1)
    spans = with_spans(points, params, s, clip=False)
    tile = materialize(spans.groupBy("i0", "i1", "j0", "j1").agg(F.count("*").alias("n"), F.min("key").alias("key")))
    strips = materialize(_slide(tile, "i0", "i1", every, ["j0", "j1"], "i"))
    got = _slide(strips, "j0", "j1", every, ["i"], "j").crossJoin(F.broadcast(params.select("ncols", "nrows")))
    got = got.filter("i >= 0 AND i < ncols AND j >= 0 AND j < nrows")
    return got.select("i", "j", "n", F.col("key.v").alias("z"), number_of("key").alias("id"), "key.x", "key.y")


def stage1(points: DataFrame, params: DataFrame, s: Setting, tiled: bool = True, sliding: bool = False) -> DataFrame:
    """The lowest point of each window that holds enough points; an id for each window. ``sliding``: by sliding minima, for large overlaps."""
    stats = sliding_stats(points, params, s) if sliding else window_stats(points, params, s, tiled)
    return stats.crossJoin(F.broadcast(params.select("minnum"))).filter("n >= minnum").drop("minnum")


def votes(minima: DataFrame, least: int = 2) -> DataFrame:
    """id, x, y, z and in how many windows it is lowest, ``least`` at least."""
    return minima.groupBy("id").agg(F.count("*").alias("votes"), *[F.first(c).alias(c) for c in "xyz"]).filter(F.col("votes") >= least)


def local_lowest(points: DataFrame, params: DataFrame, s: Setting, tiled: bool = True) -> DataFrame:
    """id, x, y, z of the points that stage 2 keeps: chosen by more than one window, or by any if windows do not overlap."""
    return votes(stage1(points, params, s, tiled), 2 if s.o > 0 else 1).select("id", "x", "y", "z")


def with_cells(points: DataFrame, params: DataFrame, s: Setting) -> DataFrame:
    """The points in an open grid cell, with its ci and cj. Cells are apart, so a point has one at most."""
    j = points.crossJoin(F.broadcast(params.select("minx", "miny", "gcols", "grows")))
    j = j.select("*", *[F.floor((F.col(v) - F.col(lo)) / float(s.b)).cast("long").alias(f"_{v}") for v, lo in (("x", "minx"), ("y", "miny"))])

    def cell(v: str, lo: str) -> Column:
        a = F.col(f"_{v}")
        inside = lambda i: (F.col(v) > cell_centre(i, lo, s) - s.half_grid) & (F.col(v) < cell_centre(i, lo, s) + s.half_grid)
        return F.when(inside(a), a).when(inside(a - 1), a - 1).when(inside(a + 1), a + 1)

    j = j.select(*points.columns, "gcols", "grows", cell("x", "minx").alias("ci"), cell("y", "miny").alias("cj"))
    # no filter, as for spans
    return j.select(*points.columns, F.inline(F.when(F.expr("ci >= 0 AND cj >= 0 AND ci < gcols AND cj < grows"), F.array(F.struct("ci", "cj")))))


def empty_cells(chosen: DataFrame, params: DataFrame, s: Setting) -> DataFrame:
    """Grid cells without a point of ``chosen`` (id, x, y); cells without any point are among them."""
    own = with_cells(chosen.select("id", "x", "y"), params, s).select("ci", "cj").distinct()
    grid = params.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("gcols") - 1)).alias("ci"), "grows").select("ci", F.explode(F.sequence(F.lit(0).cast("long"), F.col("grows") - 1)).alias("cj"))
    return grid.join(own, ["ci", "cj"], "left_anti")


def fill(points: DataFrame, chosen: DataFrame, params: DataFrame, s: Setting) -> DataFrame:
    """The lowest point (ci, cj, z, id, x, y) of each cell that has points, but none of ``chosen`` (id, x, y); one pass over the points."""
    best = with_cells(points.select("id", "x", "y", "z"), params, s).withColumn("key", order_key("z", "id", "x", "y")).groupBy("ci", "cj").agg(*lowest("key", "z", "xy"))
    own = with_cells(chosen.select("id", "x", "y"), params, s).select("ci", "cj").distinct()
    return best.join(own, ["ci", "cj"], "left_anti").select("ci", "cj", "z", number_of("key").alias("id"), "x", "y")


def low_outliers_removed(points: DataFrame, params: DataFrame, size: float = 20.0, factor: float = 0.8) -> DataFrame:
    """Points whose z is above ``factor`` times the mean of their cell, both rounded to two decimals; half-open cells."""
    j = points.crossJoin(F.broadcast(params.select("minx", "miny")))
    cell = lambda v, lo: F.floor((F.col(v) - F.col(lo)) / size).cast("long")
    keyed = j.select(*points.columns, cell("x", "minx").alias("ci"), cell("y", "miny").alias("cj"))
    means = keyed.groupBy("ci", "cj").agg(F.sum("z").alias("s"), F.count("*").alias("c"))
    return keyed.join(means, ["ci", "cj"]).filter(round2(F.col("z")) > round2(factor * round2(F.col("s") / F.col("c")))).select(*points.columns)


def raster_minima(points: DataFrame, params: DataFrame, s: Setting) -> DataFrame:
    """The raster form of stage 1: k + 1 shifted half-open rasters per axis, k = w / step - 1; cells with few points are left out.

    As k shifts stay below a cell's side, a point stands in its unshifted cell up to some shift and in the one before from there on: points
    with the same cells and turning shifts are reduced to one tile, and tiles are dealt to the rasters, not points.
    """
    k = int(math.floor(s.w / s.step + 0.5)) - 1
    j = points.select("id", "x", "y", "z").crossJoin(F.broadcast(params.select("minx", "miny")))
    cell = lambda v, lo, sh: F.floor((F.col(v) - F.col(lo) - sh * s.step) / float(s.w)).cast("long")
    stays = lambda v, lo: reduce(Column.__add__, [(cell(v, lo, sh) == cell(v, lo, 0)).cast("int") for sh in range(k + 1)])
    keyed = j.select("z", cell("x", "minx", 0).alias("c0"), stays("x", "minx").alias("cs"), cell("y", "miny", 0).alias("d0"), stays("y", "miny").alias("ds"), order_key("z", "id").alias("key"))
    tile = keyed.groupBy("c0", "cs", "d0", "ds").agg(F.count("*").alias("n"), *lowest("key", "z"))
    each = tile.select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("si")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("sj"))
    at = lambda c, stay, sh: (F.col(c) - F.when(F.col(sh) < F.col(stay), 0).otherwise(1)).alias(c[0] + "c")
    got = each.select("si", "sj", at("c0", "cs", "si"), at("d0", "ds", "sj"), "n", "key").groupBy("si", "sj", "cc", "dc").agg(F.sum("n").alias("n"), *lowest("key", "z"))
    got = got.crossJoin(F.broadcast(params.select("density")))
    return got.filter(F.col("n") >= rounded(0.5 * round2(F.col("density")) * s.w * s.w)).select("si", "sj", F.col("cc").alias("ci"), F.col("dc").alias("cj"), "n", "z", number_of("key").alias("id"))


def raster_votes(minima: DataFrame, points: DataFrame) -> DataFrame:
    """Rows that are identical in all attributes but their id, once each, with the sum of their scores, above 1."""
    chosen = minima.groupBy("id").agg(F.count("*").alias("score"))
    kept = [c for c in points.columns if c != "id"]
    return points.join(chosen, "id").groupBy(*kept).agg(F.sum("score").alias("score")).filter("score > 1")


def raster_fill(points: DataFrame, chosen: DataFrame, params: DataFrame, size: float) -> DataFrame:
    """The lowest point of each half-open cell without a row of ``chosen`` (x, y)."""
    cell = lambda v, lo: F.floor((F.col(v) - F.col(lo)) / size).cast("long")
    keyed = lambda df: df.crossJoin(F.broadcast(params.select("minx", "miny"))).select(*df.columns, cell("x", "minx").alias("ci"), cell("y", "miny").alias("cj"))
    own = keyed(chosen.select("x", "y")).select("ci", "cj").distinct()
    best = keyed(points.select("id", "x", "y", "z")).withColumn("key", order_key("z", "id")).groupBy("ci", "cj").agg(*lowest("key", "z"))
    return best.join(own, ["ci", "cj"], "left_anti").select("ci", "cj", "z", number_of("key").alias("id"))


def gold_matches(seeds: DataFrame, gold: DataFrame, s: Setting, dz: float = 0.01) -> DataFrame:
    """Seeds with a gold point in the open box of half a step around them and less than ``dz`` away in z; gold may serve more than once."""
    r = s.step / 2
    cell = lambda v: F.floor(F.col(v) / s.step).cast("long")
    near = seeds.withColumn("gx", F.explode(F.sequence(F.floor((F.col("x") - r) / s.step).cast("long"), F.floor((F.col("x") + r) / s.step).cast("long"))))
    near = near.withColumn("gy", F.explode(F.sequence(F.floor((F.col("y") - r) / s.step).cast("long"), F.floor((F.col("y") + r) / s.step).cast("long"))))
    g = gold.select(F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("z").alias("hz"), cell("x").alias("kx"), cell("y").alias("ky"))
    on = (near.gx == g.kx) & (near.gy == g.ky) & (g.hx > near.x - r) & (g.hx < near.x + r) & (g.hy > near.y - r) & (g.hy < near.y + r) & (F.abs(near.z - g.hz) < dz)
    return near.join(g, on, "left_semi").select(*seeds.columns).distinct()


def gold_pairs(seeds: DataFrame, gold: DataFrame, s: Setting, rest: int = 100_000) -> DataFrame:
    """(seed id, gold id), each used once: seeds by z then id each take the free gold point nearest in the open box of half a step.

    Rows are compared through cells; what is connected is settled by rank in rounds, each a distributed join: a pair is
    settled when no smaller pair of its seed or its gold is left. Rounds go on until nothing is left, or at most ``rest`` pairs, which
    the driver settles in one pass in their order, so long chains end soon.
    """
    r = s.step / 2
    cell = lambda v: F.floor(F.col(v) / s.step).cast("long")
    near = seeds.withColumn("gx", F.explode(F.sequence(F.floor((F.col("x") - r) / s.step).cast("long"), F.floor((F.col("x") + r) / s.step).cast("long"))))
    near = near.withColumn("gy", F.explode(F.sequence(F.floor((F.col("y") - r) / s.step).cast("long"), F.floor((F.col("y") + r) / s.step).cast("long"))))
    g = gold.select(F.col("id").alias("gold"), F.col("x").alias("hx"), F.col("y").alias("hy"), cell("x").alias("kx"), cell("y").alias("ky"))
    on = (near.gx == g.kx) & (near.gy == g.ky) & (g.hx > near.x - r) & (g.hx < near.x + r) & (g.hy > near.y - r) & (g.hy < near.y + r)
    d2 = (F.col("x") - F.col("hx")) * (F.col("x") - F.col("hx")) + (F.col("y") - F.col("hy")) * (F.col("y") - F.col("hy"))
    left = near.join(g, on).select("id", "gold", F.struct("z", "id", d2.alias("d"), "gold").alias("k")).distinct()
    left, done = materialize(left), []
    while left.limit(rest + 1).count() > rest:
        by_seed, by_gold = left.groupBy("id").agg(F.min("k").alias("a")), left.groupBy("gold").agg(F.min("k").alias("b"))
        now = materialize(left.join(by_seed, "id").join(by_gold, "gold").filter("k = a AND k = b").select("id", "gold"))
        done.append(now)
        left = materialize(left.join(now.select("id"), "id", "left_anti").join(now.select("gold"), "gold", "left_anti"))
    pairs, took, given = [], set(), set()
    for r in left.orderBy("k").select("id", "gold").collect() if rest else []:
        if r.id not in took and r.gold not in given:
            pairs.append((r.id, r.gold))
            took.add(r.id)
            given.add(r.gold)
    return reduce(DataFrame.union, done, left.sparkSession.createDataFrame(pairs, left.select("id", "gold").schema))
