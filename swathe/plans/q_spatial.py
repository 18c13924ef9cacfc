"""Queries of spatial predicates, joins and neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import index as ix
from ..operators import nearest as nn
from ..operators import spatial as sj
from ..sources.cloud import POINTS3_SQL, POINTS_SQL, holed, points, points3

R, R3, CHUNK = 0.25, 0.1, 64
BOX = (20.0, 30.0, 41.5, 52.25)
BOX3 = (-0.5, -0.25, 0.0, 0.75, 0.5, 0.625)
TOL = 0.5


def _chunk_boxes(spark, d):
    return ix.chunks(points(spark, d), CHUNK).select(F.col("chunk").alias("id"), "xmin", "ymin", "xmax", "ymax")


def _leaf_boxes(spark, d, depth=5):
    """Tight boxes of the cells with points, a bit larger."""
    g = ix.with_keys(points(spark, d), depth).groupBy("key").agg(*[F.expr(e).alias(n) for n, e in (("xmin", "min(x) - 0.01D"), ("ymin", "min(y) - 0.01D"), ("xmax", "max(x) + 0.01D"), ("ymax", "max(y) + 0.01D"))])
    return g.withColumnRenamed("key", "id")


def _with_leaf(spark, d):
    return sj.neighbours(ix.with_keys(points(spark, d), 6).select("id", "x", "y", "key"), R, along=("t_key",)).withColumnRenamed("t_key", "leaf")


_CORNERS3 = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")


def _chunk_boxes3(spark, d):
    return ix.chunks(points3(spark, d), 16, axes="xyz").select(F.col("chunk").alias("id"), *_CORNERS3)


def _leaf_boxes3(spark, d):
    """Tight boxes of the octree's cells with points, a bit larger."""
    g = ix.with_keys(points3(spark, d), 3, axes="xyz").groupBy("key").agg(*[F.expr(f"{c[1:]}({c[0]}) {'-' if c.endswith('min') else '+'} 0.01D").alias(c) for c in _CORNERS3])
    return g.withColumnRenamed("key", "id")


def _corner3(spark, d):
    box = tuple(F.col(k) for k in _CORNERS3)
    return _chunk_boxes3(spark, d).select("id", c.box_overlap(box, BOX3).alias("overlaps"), c.box_within(box, BOX3).alias("within"))


def _tolerance(spark, d):
    box = tuple(F.col(k) for k in ("xmin", "ymin", "xmax", "ymax"))
    return _chunk_boxes(spark, d).select("id", c.box_overlap(BOX, box, TOL).alias("overlaps"), c.box_within(box, BOX, TOL).alias("within"), c.in_limits((F.col("xmin"), F.col("ymin")), BOX, TOL).alias("corner_in"))


def _mindist3(spark, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points3(spark, d).select("id", F.round(c.box_mindist2(x, y, BOX3, z), 6).alias("mindist"), F.round(c.box_minmaxdist2(x, y, BOX3, z), 6).alias("minmaxdist"))


def _mindist(spark, d):
    p = points(spark, d)
    return p.select("id", F.round(c.box_mindist2(F.col("x"), F.col("y"), BOX), 6).alias("mindist"), F.round(c.box_minmaxdist2(F.col("x"), F.col("y"), BOX), 6).alias("minmaxdist"))


def _corner(spark, d):
    b = _chunk_boxes(spark, d)
    one = ("xmin", "ymin", "xmax", "ymax")
    box = tuple(F.col(k) for k in one)
    return b.select("id", c.box_overlap(box, BOX).alias("overlaps"), c.box_within(box, BOX).alias("within"), c.box_within(BOX, box).alias("covers"))


P = f"WITH p AS ({POINTS_SQL})"
E3 = "WITH p AS (" + POINTS3_SQL.format(a=1, b=2, c=3) + ")"


def pairs_sql(src: str, r: float, ry: float | None = None, more: str = "", itself: bool = False) -> str:
    """nb: pairs (id, t_id) by cells, as comparing all with all would not end."""
    ry = r if ry is None else ry
    size = max(2 * r, 2 * ry)
    d = lambda v: f"CAST({v} AS DOUBLE)"
    fl = lambda v: f"CAST(floor(({v}) / {d(size)}) AS BIGINT)"
    return f"""{src},
pc AS (SELECT *, unnest(range({fl(f'x - {d(r)}')}, {fl(f'x + {d(r)}')} + 1)) AS ax FROM p),
pd AS (SELECT *, unnest(range({fl(f'y - {d(ry)}')}, {fl(f'y + {d(ry)}')} + 1)) AS ay FROM pc),
tc AS (SELECT *, {fl('x')} AS bx, {fl('y')} AS by FROM p),
nb AS (SELECT a.id AS id, b.id AS t_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, b.g_id AS t_g FROM pd a JOIN tc b ON a.ax = b.bx AND a.ay = b.by
 WHERE b.x > a.x - {d(r)} AND b.x < a.x + {d(r)} AND b.y > a.y - {d(ry)} AND b.y < a.y + {d(ry)} {'' if itself else 'AND a.id <> b.id'} {more})"""


Z3 = f"AND b.z > a.z - CAST({R3} AS DOUBLE) AND b.z < a.z + CAST({R3} AS DOUBLE)"
CIRCLE = f"AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < CAST({R} AS DOUBLE) * CAST({R} AS DOUBLE)"
INNER = "AND NOT (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE)"
SPHERE = f"AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < CAST({R3} AS DOUBLE) * CAST({R3} AS DOUBLE)"
PAIRS = " SELECT id, t_id FROM nb"
_COUNT = " SELECT p.id, count(nb.t_id) AS n FROM p LEFT JOIN nb ON nb.id = p.id GROUP BY p.id"


OTHER = sj.apart_in("g_id")

QUERIES = {
    "inside_box": lambda s, d: points(s, d).filter(c.inside_box(F.col("x"), F.col("y"), 40.0, 40.0, 7.5)).select("id"),
    "inside_box3": lambda s, d: points3(s, d).filter(c.inside_box3(F.col("x"), F.col("y"), F.col("z"), 0.0, 0.0, 0.0, 1.0)).select("id"),
    "inside_circle": lambda s, d: points(s, d).filter(c.inside_circle(F.col("x"), F.col("y"), 40.0, 40.0, 7.5)).select("id"),
    "box_overlap": _corner,
    "box_inside": lambda s, d: _corner(s, d).filter("within").select("id"),
    "neighbors_box2d": lambda s, d: sj.neighbours(points(s, d), R),
    "neighbors_rect2d": lambda s, d: sj.neighbours(points(s, d), 0.4, 0.15),
    "neighbors_box3d": lambda s, d: sj.neighbours(points3(s, d), R3, rz=R3),
    "neighbors_sphere": lambda s, d: sj.neighbours(points3(s, d), R3, residual=sj.within_sphere(R3), rz=R3),
    "neighbors_diff_group": lambda s, d: sj.neighbours(points(s, d), R, residual=OTHER),
    "neighbors_lower_z": lambda s, d: sj.neighbours(points(s, d), R, residual=OTHER & sj.lower()),
    "neighbors3d_no_group": lambda s, d: sj.neighbours(points3(s, d), R3, residual=OTHER, rz=R3),
    "neighbors_circle": lambda s, d: sj.neighbours(points(s, d), R, residual=sj.within_circle(R)),
    "neighbors_donut": lambda s, d: sj.neighbours(points(s, d), R, residual=sj.within_ring(0.1, R)),
    "neighbors_with_leaf": _with_leaf,
    "neighbors_renumbered": lambda s, d: sj.numbered_neighbours(points(s, d), R),
    "neighbor_counts": lambda s, d: sj.counts(points(s, d), R),
    "neighbor_counts_cells": lambda s, d: sj.counts_by_cells(points(s, d), R),
    "neighbor_counts_cells_3d": lambda s, d: sj.counts_by_cells(points3(s, d), R3, rz=R3),
    "neighbor_counts_3d": lambda s, d: sj.counts(points3(s, d), R3, rz=R3),
    "neighbor_counts_diff_group": lambda s, d: sj.counts(points(s, d), R, apart="g_id"),
    "leaf_neighbors": lambda s, d: sj.box_join(_leaf_boxes(s, d), _leaf_boxes(s, d), 4.0),
    "bvh_overlaps": lambda s, d: sj.box_join(_chunk_boxes(s, d), _chunk_boxes(s, d), 4.0, most=8),
    "point_group": lambda s, d: sj.group_of(points(s, d).withColumn("x", F.col("x") + 0.005), points(s, d), 0.25),
    "nearest_neighbor": lambda s, d: nn.nearest(points(s, d), points(s, d)).select("id", "t_id", F.round("d2", 6).alias("d2")),
    "nearest_neighbor_3d": lambda s, d: nn.nearest(points3(s, d), points3(s, d), axes="xyz").select("id", "t_id", F.round("d2", 6).alias("d2")),
    "nearest_manhattan": lambda s, d: nn.nearest(points(s, d), points(s, d), metric=nn.MANHATTAN, name="distance").select("id", "t_id", F.round("distance", 6).alias("distance")),
    "nearest_weighted": lambda s, d: nn.nearest(points3(s, d), points3(s, d), axes="xyz", metric=nn.weighted(x=4.0, z=0.25), name="distance").select("id", "t_id", F.round("distance", 6).alias("distance")),
    "box_overlap_3d": _corner3,
    "box_tolerance": _tolerance,
    "leaf_neighbors_3d": lambda s, d: sj.box_join(_leaf_boxes3(s, d), _leaf_boxes3(s, d), 0.5, axes="xyz"),
    "bvh_overlaps_3d": lambda s, d: sj.box_join(_chunk_boxes3(s, d), _chunk_boxes3(s, d), 0.5, most=8, axes="xyz"),
    "box_mindist_3d": _mindist3,
    "box_mindist": _mindist,
    "bbox_merge": lambda s, d: _chunk_boxes(s, d).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")).select("*", F.round((F.col("xmin") + F.col("xmax")) / 2, 6).alias("cx"), F.round((F.col("ymin") + F.col("ymax")) / 2, 6).alias("cy")),
    "points_except": lambda s, d: points(s, d).join(holed(s, d).select("id"), "id", "left_anti").select("id", "x", "y", "z"),
    "points_union_all": lambda s, d: points(s, d).select("id", "z").unionByName(holed(s, d).select("id", "z")),
}

_CK = f"""{P}, hd AS (SELECT min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM p),
mc AS (SELECT p.*, least(65535, CAST(floor((x - minx) / (maxx - minx) * 65536) AS BIGINT)) AS mx, least(65535, CAST(floor((y - miny) / (maxy - miny) * 65536) AS BIGINT)) AS my FROM p, hd),
rk AS (SELECT *, row_number() OVER (ORDER BY {" + ".join(f"(((mx >> {b}) & 1) << {2 * b + 1}) + (((my >> {b}) & 1) << {2 * b})" for b in range(16))}, id) - 1 AS rank FROM mc),
bx AS (SELECT rank // {CHUNK} AS id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM rk GROUP BY 1)"""


def _keys(depth: int) -> str:
    n = 1 << depth
    cell = lambda v: f"greatest(0, least({n - 1}, CAST(floor(({v} - (c{v} - radius)) / (2 * radius) * {n}) AS BIGINT)))"
    bits = " + ".join(f"(((kx >> {b}) & 1) << {2 * b + 1}) + (((ky >> {b}) & 1) << {2 * b})" for b in range(depth))
    return f"""hk AS (SELECT greatest((max(x) - min(x)) / 2, (max(y) - min(y)) / 2) AS radius, min(x) + (max(x) - min(x)) / 2 AS cx, min(y) + (max(y) - min(y)) / 2 AS cy FROM p),
kk AS (SELECT id, x, y, {cell('x')} AS kx, {cell('y')} AS ky FROM p, hk), ke AS (SELECT id, x, y, {bits} AS key FROM kk)"""


_HD3 = "hd AS (SELECT min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz FROM p)"
_BITS3 = lambda k, n: " + ".join(f"((({k}x >> {b}) & 1) << {3 * b + 2}) + ((({k}y >> {b}) & 1) << {3 * b + 1}) + ((({k}z >> {b}) & 1) << {3 * b})" for b in range(n))
_CK3 = f"""{E3}, {_HD3},
mc AS (SELECT p.*, {", ".join(f"least(2097151, CAST(floor(({v} - min{v}) / (max{v} - min{v}) * 2097152) AS BIGINT)) AS m{v}" for v in "xyz")} FROM p, hd),
rk AS (SELECT *, row_number() OVER (ORDER BY {_BITS3("m", 21)}, id) - 1 AS rank FROM mc),
bx AS (SELECT rank // 16 AS id, min(x) AS xmin, min(y) AS ymin, min(z) AS zmin, max(x) AS xmax, max(y) AS ymax, max(z) AS zmax FROM rk GROUP BY 1)"""
_LB3 = f"""{E3}, {_HD3}, geo AS (SELECT greatest((maxx - minx) / 2, (maxy - miny) / 2, (maxz - minz) / 2) AS radius, minx + (maxx - minx) / 2 AS cx, miny + (maxy - miny) / 2 AS cy, minz + (maxz - minz) / 2 AS cz FROM hd),
kk AS (SELECT x, y, z, {", ".join(f"greatest(0, least(7, CAST(floor(({v} - (c{v} - radius)) / (2 * radius) * 8) AS BIGINT))) AS k{v}" for v in "xyz")} FROM p, geo),
bx AS (SELECT {_BITS3("k", 3)} AS id, {", ".join(f"min({v}) - CAST(0.01 AS DOUBLE) AS {v}min, max({v}) + CAST(0.01 AS DOUBLE) AS {v}max" for v in "xyz")} FROM kk GROUP BY 1)"""
_MEET3 = " AND ".join(f"a.{v}min <= b.{v}max AND a.{v}max >= b.{v}min" for v in "xyz")
_MEET = "a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin"
_X0, _Y0, _X1, _Y1 = (f"CAST({v} AS DOUBLE)" for v in BOX)
_NEAR = lambda v, lo, hi: f"(CASE WHEN {v} <= ({lo} + {hi}) / 2 THEN {lo} ELSE {hi} END)"
_FAR = lambda v, lo, hi: f"(CASE WHEN {v} >= ({lo} + {hi}) / 2 THEN {lo} ELSE {hi} END)"
_SQ = lambda e: f"({e}) * ({e})"

ORACLES = {
    "inside_box": P + " SELECT id FROM p WHERE x > 32.5 AND x < 47.5 AND y > 32.5 AND y < 47.5",
    "inside_box3": E3 + " SELECT id FROM p WHERE x > -1 AND x < 1 AND y > -1 AND y < 1 AND z > -1 AND z < 1",
    "inside_circle": P + " SELECT id FROM p WHERE (x - 40) * (x - 40) + (y - 40) * (y - 40) < 56.25",
    "box_overlap": f"{_CK} SELECT id, xmin <= {_X1} AND xmax >= {_X0} AND ymin <= {_Y1} AND ymax >= {_Y0} AS overlaps, xmin >= {_X0} AND xmax <= {_X1} AND ymin >= {_Y0} AND ymax <= {_Y1} AS within, xmin <= {_X0} AND xmax >= {_X1} AND ymin <= {_Y0} AND ymax >= {_Y1} AS covers FROM bx",
    "box_inside": f"{_CK} SELECT id FROM bx WHERE xmin >= {_X0} AND xmax <= {_X1} AND ymin >= {_Y0} AND ymax <= {_Y1}",
    "neighbors_box2d": pairs_sql(P, R) + PAIRS,
    "neighbors_rect2d": pairs_sql(P, 0.4, 0.15) + PAIRS,
    "neighbors_box3d": pairs_sql(E3, R3, None, Z3) + PAIRS,
    "neighbors_sphere": pairs_sql(E3, R3, None, SPHERE) + PAIRS,
    "neighbors_diff_group": pairs_sql(P, R, None, "AND a.g_id <> b.g_id") + PAIRS,
    "neighbors_lower_z": pairs_sql(P, R, None, "AND a.g_id <> b.g_id AND b.z < a.z") + PAIRS,
    "neighbors3d_no_group": pairs_sql(E3, R3, None, Z3 + " AND a.g_id <> b.g_id") + PAIRS,
    "neighbors_circle": pairs_sql(P, R, None, CIRCLE) + PAIRS,
    "neighbors_donut": pairs_sql(P, R, None, CIRCLE + " " + INNER) + PAIRS,
    "neighbors_with_leaf": f"{pairs_sql(P, R)}, {_keys(6)} SELECT nb.id, t_id, key AS leaf FROM nb JOIN ke ON ke.id = t_id",
    "neighbors_renumbered": pairs_sql(P, R) + " SELECT id, t_id, row_number() OVER (PARTITION BY id ORDER BY t_id) - 1 AS number FROM nb",
    "neighbor_counts": pairs_sql(P, R, itself=True) + _COUNT,
    "neighbor_counts_cells": pairs_sql(P, R, itself=True) + _COUNT,
    "neighbor_counts_cells_3d": pairs_sql(E3, R3, None, Z3, True) + _COUNT,
    "neighbor_counts_3d": pairs_sql(E3, R3, None, Z3, True) + _COUNT,
    "neighbor_counts_diff_group": pairs_sql(P, R, None, "AND a.g_id <> b.g_id") + _COUNT,
    "leaf_neighbors": f"{P}, {_keys(5)}, bx AS (SELECT key AS id, min(x) - CAST(0.01 AS DOUBLE) AS xmin, min(y) - CAST(0.01 AS DOUBLE) AS ymin, max(x) + CAST(0.01 AS DOUBLE) AS xmax, max(y) + CAST(0.01 AS DOUBLE) AS ymax FROM ke GROUP BY key) SELECT a.id, b.id AS t_id FROM bx a JOIN bx b ON {_MEET}",
    "bvh_overlaps": f"{_CK}, hit AS (SELECT a.id, b.id AS t_id FROM bx a JOIN bx b ON {_MEET}), rn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t_id) AS rn, count(*) OVER (PARTITION BY id) AS hits FROM hit) SELECT id, t_id, hits FROM rn WHERE rn <= 8",
    "point_group": f"""WITH t AS ({POINTS_SQL}), q AS (SELECT id, x + CAST(0.005 AS DOUBLE) AS x, y FROM t),
pc AS (SELECT *, unnest(range(CAST(floor((x - 0.25) / CAST(0.5 AS DOUBLE)) AS BIGINT), CAST(floor((x + 0.25) / CAST(0.5 AS DOUBLE)) AS BIGINT) + 1)) AS ax FROM q),
pd AS (SELECT *, unnest(range(CAST(floor((y - 0.25) / CAST(0.5 AS DOUBLE)) AS BIGINT), CAST(floor((y + 0.25) / CAST(0.5 AS DOUBLE)) AS BIGINT) + 1)) AS ay FROM pc),
tc AS (SELECT *, CAST(floor(x / CAST(0.5 AS DOUBLE)) AS BIGINT) AS bx, CAST(floor(y / CAST(0.5 AS DOUBLE)) AS BIGINT) AS by FROM t),
nb AS (SELECT a.id, min(struct_pack(d := (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), i := b.id, g := b.g_id)) AS m FROM pd a JOIN tc b ON a.ax = b.bx AND a.ay = b.by WHERE b.x > a.x - 0.25 AND b.x < a.x + 0.25 AND b.y > a.y - 0.25 AND b.y < a.y + 0.25 GROUP BY a.id)
SELECT q.id, coalesce(m.g, -1) AS g FROM q LEFT JOIN nb ON nb.id = q.id""",
    "nearest_neighbor": pairs_sql(P, 4.0) + ", m AS (SELECT id, min(struct_pack(d2 := d2, t := t_id)) AS m FROM nb GROUP BY id) SELECT id, m.t AS t_id, round(m.d2, 6) AS d2 FROM m",
    "nearest_neighbor_3d": E3 + ", m AS (SELECT a.id, min(struct_pack(d2 := (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), t := b.id)) AS m FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id) SELECT id, m.t AS t_id, round(m.d2, 6) AS d2 FROM m",
    "nearest_manhattan": pairs_sql(P, 4.0).replace("(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2", "abs(a.x - b.x) + abs(a.y - b.y) AS d2") + ", m AS (SELECT id, min(struct_pack(d2 := d2, t := t_id)) AS m FROM nb WHERE d2 < 4 GROUP BY id) SELECT id, m.t AS t_id, round(m.d2, 6) AS distance FROM m",
    "nearest_weighted": E3 + ", m AS (SELECT a.id, min(struct_pack(d := (a.x - b.x) * (a.x - b.x) * CAST(4 AS DOUBLE) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) * CAST(0.25 AS DOUBLE), t := b.id)) AS m FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id) SELECT id, m.t AS t_id, round(m.d, 6) AS distance FROM m",
    "box_overlap_3d": f"{_CK3} SELECT id, " + " AND ".join(f"{v}min <= CAST({BOX3[k + 3]} AS DOUBLE) AND {v}max >= CAST({BOX3[k]} AS DOUBLE)" for k, v in enumerate("xyz")) + " AS overlaps, " + " AND ".join(f"{v}min >= CAST({BOX3[k]} AS DOUBLE) AND {v}max <= CAST({BOX3[k + 3]} AS DOUBLE)" for k, v in enumerate("xyz")) + " AS within FROM bx",
    "box_tolerance": f"{_CK} SELECT id, " + " AND ".join(f"{v}max - CAST({BOX[k]} AS DOUBLE) >= CAST({TOL} AS DOUBLE) AND {v}min - CAST({BOX[k + 2]} AS DOUBLE) <= CAST({TOL} AS DOUBLE)" for k, v in enumerate("xy")) + " AS overlaps, " + " AND ".join(f"{v}max - CAST({BOX[k + 2]} AS DOUBLE) <= CAST({TOL} AS DOUBLE) AND {v}min - CAST({BOX[k]} AS DOUBLE) >= CAST({TOL} AS DOUBLE)" for k, v in enumerate("xy")) + " AS within, " + " AND ".join(f"{v}min - CAST({BOX[k]} AS DOUBLE) > CAST({TOL} AS DOUBLE) AND {v}min - CAST({BOX[k + 2]} AS DOUBLE) < CAST({TOL} AS DOUBLE)" for k, v in enumerate("xy")) + " AS corner_in FROM bx",
    "leaf_neighbors_3d": f"{_LB3} SELECT a.id, b.id AS t_id FROM bx a JOIN bx b ON {_MEET3}",
    "bvh_overlaps_3d": f"{_CK3}, hit AS (SELECT a.id, b.id AS t_id FROM bx a JOIN bx b ON {_MEET3}), rn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t_id) AS rn, count(*) OVER (PARTITION BY id) AS hits FROM hit) SELECT id, t_id, hits FROM rn WHERE rn <= 8",
    "box_mindist_3d": f"{E3} SELECT id, round(" + " + ".join(_SQ(f"greatest(CAST({BOX3[k]} AS DOUBLE) - {v}, {v} - CAST({BOX3[k + 3]} AS DOUBLE), 0)") for k, v in enumerate("xyz")) + ", 6) AS mindist, round(least(" + ", ".join(" + ".join(_SQ(f"{v} - " + (_NEAR if v == u else _FAR)(v, f"CAST({BOX3[k]} AS DOUBLE)", f"CAST({BOX3[k + 3]} AS DOUBLE)")) for k, v in enumerate("xyz")) for u in "xyz") + "), 6) AS minmaxdist FROM p",
    "box_mindist": f"{P} SELECT id, round({_SQ(f'greatest({_X0} - x, x - {_X1}, 0)')} + {_SQ(f'greatest({_Y0} - y, y - {_Y1}, 0)')}, 6) AS mindist, round(least({_SQ('x - ' + _NEAR('x', _X0, _X1))} + {_SQ('y - ' + _FAR('y', _Y0, _Y1))}, {_SQ('y - ' + _NEAR('y', _Y0, _Y1))} + {_SQ('x - ' + _FAR('x', _X0, _X1))}), 6) AS minmaxdist FROM p",
    "bbox_merge": f"{_CK} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, round((min(xmin) + max(xmax)) / 2, 6) AS cx, round((min(ymin) + max(ymax)) / 2, 6) AS cy FROM bx",
    "points_except": P + " SELECT id, x, y, z FROM p WHERE x > 20 AND x < 60 AND y > 20 AND y < 60 AND id % 8 <> 0",
    "points_union_all": P + " SELECT id, z FROM p UNION ALL SELECT id, z FROM p WHERE NOT (x > 20 AND x < 60 AND y > 20 AND y < 60 AND id % 8 <> 0)",
}
