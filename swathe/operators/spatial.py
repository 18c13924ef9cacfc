"""Spatial joins: cell-bucketed equi-joins with an exact residual, and pairs of neighbours made in tiles.

Both sides are keyed by square cells; a probe is copied to every cell that its box touches, a target stands in one. The cell should be about as
wide as the box, so a probe goes to a few cells. A range condition alone would compare all with all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import box_mindist2
from ..lineage import materialize
from .nearest import boxed, nearest
from .tiles import Within, box_counts, box_pairs, differ, less, numbered_pairs

Pred = Column | Within


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long")))


def spatial_join(probes: DataFrame, targets: DataFrame, rx: float, ry: float | None = None, cell: float | None = None, residual: Pred | None = None, how: str = "inner", rz: float | None = None) -> DataFrame:
    """Probes with the targets in the open box of half sides rx, ry (and rz, if given) around them.

    Columns of probes keep their names, those of targets get the prefix ``t_``; ``residual`` may use both. With ``rz`` cells are cubes.
    """
    half = {"x": rx, "y": rx if ry is None else ry} | ({} if rz is None else {"z": rz})
    size = cell or 2 * max(half.values())
    p, on = probes, F.lit(True) if residual is None else residual.column() if isinstance(residual, Within) else residual
    for a, r in half.items():
        p = p.select("*", _cells(F.col(a) - r, F.col(a) + r, size).alias(f"_c{a}"))
        on = (F.col(f"_c{a}") == F.col(f"_t{a}")) & (F.col(f"t_{a}") > F.col(a) - r) & (F.col(f"t_{a}") < F.col(a) + r) & on
    t = targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns], *[F.floor(F.col(a) / size).cast("long").alias(f"_t{a}") for a in half])
    return p.join(t, on, how).drop(*[f"{k}{a}" for k in ("_c", "_t") for a in half])


def other() -> Column:
    return F.col("id") != F.col("t_id")


def neighbours(points: DataFrame, rx: float, ry: float | None = None, residual: Pred | None = None, cell: float | None = None, rz: float | None = None, along: tuple[str, ...] = ()) -> DataFrame:
    """(id, t_id): every point with the others in its box; ``along``: further columns, like ``t_key`` for the other's key.

    In two dimensions, without ``cell`` and with no ``residual`` but a ``Within``, pairs are made in tiles (``box_pairs``): points are shuffled once each, with a rim, and not sorted. Else
    points are joined, and each is shuffled to all cells of its box.
    """
    if rz is None and cell is None and (residual is None or isinstance(residual, Within)):
        return box_pairs(points, rx, ry, residual, along)
    if isinstance(residual, Within):
        residual = residual.column()
    cond = other() if residual is None else other() & residual
    return spatial_join(points, points, rx, ry, cell, cond, rz=rz).select("id", "t_id", *along)


def _apart2(p: dict, t: dict, axes: str = "xy"):
    parts = [p[a] - t[a] for a in axes]
    return reduce(lambda a, b: a + b, [d * d for d in parts])


def within_z(r: float) -> Within:
    return Within(lambda p, t: less(p["z"] - r, t["z"]) & less(t["z"], p["z"] + r), ("z",))


def within_circle(r: float) -> Within:
    return Within(lambda p, t: _apart2(p, t) < r * r)


def within_ring(inner: float, outer: float) -> Within:
    return Within(lambda p, t: (_apart2(p, t) < outer * outer) & ~(_apart2(p, t) < inner * inner))


def within_sphere(r: float) -> Within:
    return Within(lambda p, t: _apart2(p, t, "xyz") < r * r, ("z",))


def apart_in(column: str) -> Within:
    """Points that differ in a column."""
    return Within(lambda p, t: differ(p[column], t[column]), (column,), (column,))


def lower() -> Within:
    """Points with a lower z."""
    return Within(lambda p, t: less(t["z"], p["z"]), ("z",), ("z",))


def counts(points: DataFrame, rx: float, ry: float | None = None, residual: Pred | None = None, itself: bool = True, rz: float | None = None, apart: str | None = None) -> DataFrame:
    """(id, n): how many points are in each one's box; 0 where none is. ``apart``: only those that differ in that column.

    In two dimensions and without a ``residual`` no pair is made (``box_counts``).
    """
    if rz is None and residual is None:
        return box_counts(points, rx, ry, itself, apart)
    cond = residual.column() if isinstance(residual, Within) else residual
    if apart:
        cond = F.col(apart) != F.col(f"t_{apart}") if cond is None else cond & (F.col(apart) != F.col(f"t_{apart}"))
    if not itself:
        cond = other() if cond is None else other() & cond
    found = spatial_join(points, points, rx, ry, None, cond, rz=rz).groupBy("id").agg(F.count("*").alias("n"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by_cells(points: DataFrame, rx: float, ry: float | None = None, rz: float | None = None, levels: int = 2) -> DataFrame:
    """(id, n) as ``counts`` gives it, each point itself included, for clouds so dense that the pairs would be too many.

    In two dimensions the cells are the halves, quarters and so on of a tile's ranks (``box_counts``). With ``rz`` cells hold their number of points and the tight box around these. A cell whose box lies within a point's box is added as a whole, one that
    only meets it is parted into cells a quarter as wide, and points are compared in the last cells of the rim alone. Points that coincide are
    never parted. Cells of the first level are as wide as the largest half side; denser clouds want more ``levels``.
    """
    if rz is None:
        return box_counts(points, rx, ry)
    half = {"x": rx, "y": rx if ry is None else ry, "z": rz}
    sizes = [max(half.values()) / 4**k for k in range(levels)]  # quarters are exact, so cells nest
    at = lambda a, size: F.floor(F.col(a) / size).cast("long")
    inside = lambda lo, hi, a: (lo > F.col(a) - half[a]) & (hi < F.col(a) + half[a])
    keys = [f"_c{a}" for a in half]
    left = points.select("id", *half)
    for a, r in half.items():
        left = left.select("*", _cells(F.col(a) - r, F.col(a) + r, sizes[0]).alias(f"_c{a}"))
    sure = []
    for k, size in enumerate(sizes):
        bounds = [f(a).alias(f"_{m}{a}") for a in half for f, m in ((F.min, "lo"), (F.max, "hi"))]
        cells = points.groupBy(*[at(a, size).alias(f"_c{a}") for a in half]).agg(F.count("*").alias("n"), *bounds)
        if k:  # the rim's cells are looked up by the cell around them
            cells = cells.select(*[F.col(c).alias(f"_k{c[2:]}") for c in keys], *[F.floor(F.col(c) / 4).alias(c) for c in keys], *[c for c in cells.columns if c not in keys])
        meets = whole = F.lit(True)
        for a, r in half.items():
            meets = meets & (F.col(f"_hi{a}") > F.col(a) - r) & (F.col(f"_lo{a}") < F.col(a) + r)
            whole = whole & inside(F.col(f"_lo{a}"), F.col(f"_hi{a}"), a)
        own = [F.col(f"_k{a}").alias(f"_c{a}") if k else F.col(f"_c{a}") for a in half]
        met = materialize(left.join(cells, keys).filter(meets).select("id", *half, *own, "n", whole.alias("_whole")))
        sure.append(met.filter("_whole").select("id", "n"))
        left = met.filter("not _whole").select("id", *half, *keys)
    near = points.select(*[F.col(a).alias(f"t_{a}") for a in half], *[at(a, sizes[-1]).alias(f"_c{a}") for a in half])
    on = F.lit(True)
    for a in half:
        on = on & inside(F.col(f"t_{a}"), F.col(f"t_{a}"), a)
    found = left.join(near, keys).filter(on).select("id", F.lit(1).cast("long").alias("n"))
    for part in sure:
        found = found.unionByName(part)
    return points.select("id").join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def group_of(probes: DataFrame, points: DataFrame, r: float = 1.0) -> DataFrame:
    """(id, g): the group of the nearest point in the box, -1 without one; equal distances go to the smaller id. Ids are one point's each.

    The nearest point is searched for in cells as wide as the density needs, so a crowded box is not compared as a whole.
    """
    finite = lambda df: df.filter(" AND ".join(f"{a} IS NOT NULL AND abs({a}) < double('inf')" for a in "xy"))
    found = nearest(finite(probes.select("id", "x", "y")), finite(points.select("id", "x", "y")), True, metric=boxed(r)).filter(F.col("d2") < float("inf"))
    best = found.join(points.select(F.col("id").alias("t_id"), F.col("g_id").alias("g")), "t_id").select("id", "g")
    return probes.select("id").join(best, "id", "left").select("id", F.coalesce("g", F.lit(-1)).alias("g"))


def renumbered(pairs: DataFrame) -> DataFrame:
    """``pairs`` (id, t_id) with 0-based numbers of each probe's hits by t_id."""
    return pairs.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("t_id")) - 1)


def numbered_neighbours(points: DataFrame, rx: float, ry: float | None = None) -> DataFrame:
    """(id, t_id, number) as ``renumbered`` gives it of ``neighbours``, without a shuffle of the pairs; ids are one point's each."""
    return numbered_pairs(points, rx, ry)


def box_join(a: DataFrame, b: DataFrame, size: float, most: int | None = None, axes: str = "xy") -> DataFrame:
    """(id, t_id, hits) of overlapping closed boxes (id, xmin, ymin, xmax, ymax; zmin and zmax too for ``axes`` "xyz").

    Both sides stand in all cells that they touch; a pair is reported by the cell of its lower common corner alone. With ``most``, a box
    gets its first partners by id only (a capped buffer), ``hits`` being the true number.
    """
    names = [f"{a}{k}" for k in ("min", "max") for a in axes]

    def keyed(df: DataFrame, mark: str) -> DataFrame:
        got = df.select(*[F.col(c).alias(f"{mark}{c}") for c in ("id", *names)])
        for c in axes:
            got = got.select("*", _cells(F.col(f"{mark}{c}min"), F.col(f"{mark}{c}max"), size).alias(f"{mark}c{c}"))
        return got

    on = F.lit(True)
    for c in axes:
        meet = (F.col(f"a_{c}min") <= F.col(f"b_{c}max")) & (F.col(f"a_{c}max") >= F.col(f"b_{c}min"))
        corner = F.floor(F.greatest(f"a_{c}min", f"b_{c}min") / size) == F.col(f"a_c{c}")
        on = (F.col(f"a_c{c}") == F.col(f"b_c{c}")) & meet & corner & on
    got = keyed(a, "a_").join(keyed(b, "b_"), on).select(F.col("a_id").alias("id"), F.col("b_id").alias("t_id"))
    if most is None:
        return got
    ranked = got.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("t_id"))).withColumn("hits", F.count("*").over(Window.partitionBy("id")))
    return ranked.filter(F.col("rn") <= most).select("id", "t_id", "hits")


def box_distances(points: DataFrame, box: tuple) -> DataFrame:
    return points.select("id", box_mindist2(F.col("x"), F.col("y"), box).alias("d2"))
