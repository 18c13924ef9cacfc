"""Queries of the window operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as w
from ..sources.cloud import POINTS_SQL, holed, points
from .seeds import seed_points, summary

S = w.Setting()
S4 = w.Setting(b=4)


def cte(s: w.Setting, hole: bool = False) -> str:
    """p: points; prm: parameters; in DuckDB's SQL."""
    where = "WHERE NOT (x > 20 AND x < 60 AND y > 20 AND y < 60 AND id % 8 <> 0)" if hole else ""
    d = lambda v: f"CAST({v} AS DOUBLE)"
    windows = lambda side: f"CAST(floor(({side} + {d(2 * s.w * s.o)}) / {d(s.step)} + 0.5) AS BIGINT) - 1" if s.o > 0 else f"CAST(floor({side} / {s.w}) AS BIGINT) + 1"
    cells = lambda side: f"CAST(floor({side} / {s.b}) AS BIGINT) + 1" if s.b else "CAST(0 AS BIGINT)"
    return f"""WITH p AS (SELECT * FROM ({POINTS_SQL}) {where}),
hd AS (SELECT count(*) AS n, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM p),
h2 AS (SELECT *, floor((maxx - minx) * 100 + 0.5) / 100 AS width, floor((maxy - miny) * 100 + 0.5) / 100 AS height FROM hd),
h3 AS (SELECT *, n / (width * height) AS density FROM h2),
prm AS (SELECT *, greatest(1, CAST(floor({d(0.5)} * density * {s.w} * {s.w}) AS BIGINT)) AS minnum, {windows('width')} AS ncols, {windows('height')} AS nrows, {cells('width')} AS gcols, {cells('height')} AS grows FROM h3)"""


def cx(i: str, lo: str, s: w.Setting) -> str:
    return f"({lo} - CAST({s.w / 2 if s.exact else s.w // 2} AS DOUBLE) + CAST({s.step} AS DOUBLE) + {i} * CAST({s.step} AS DOUBLE))"


def pw(s: w.Setting) -> str:
    """pw: points in windows, by unnesting a generous range and testing the open box."""
    r = f"CAST({s.half} AS DOUBLE)"
    n = int(2 * s.half / s.step) + 3
    lo = lambda v, l: f"CAST(floor(({v} - {r} - ({l} - CAST({s.w / 2 if s.exact else s.w // 2} AS DOUBLE) + CAST({s.step} AS DOUBLE))) / CAST({s.step} AS DOUBLE)) AS BIGINT)"
    return f""",
px AS (SELECT id, x, y, z, minx, miny, ncols, nrows, unnest(range({lo('x', 'minx')} - 1, {lo('x', 'minx')} + {n})) AS i FROM p, prm),
py AS (SELECT *, unnest(range({lo('y', 'miny')} - 1, {lo('y', 'miny')} + {n})) AS j FROM px WHERE i >= 0 AND i < ncols AND x > {cx('i', 'minx', s)} - {r} AND x < {cx('i', 'minx', s)} + {r}),
pw AS (SELECT id, z, i, j FROM py WHERE j >= 0 AND j < nrows AND y > {cx('j', 'miny', s)} - {r} AND y < {cx('j', 'miny', s)} + {r}),
ws AS (SELECT i, j, count(*) AS n, min(struct_pack(z := z, id := id)) AS m FROM pw GROUP BY i, j),
s1 AS (SELECT i, j, ws.n AS n, m.z AS z, m.id AS id FROM ws, prm WHERE ws.n >= minnum),
llp AS (SELECT id, count(*) AS votes FROM s1 GROUP BY id HAVING count(*) > {1 if s.o > 0 else 0})"""


def cells(s: w.Setting) -> str:
    r = f"CAST({s.half_grid} AS DOUBLE)"
    c = lambda i, lo: f"({lo} + {r} + {i} * CAST({s.b} AS DOUBLE))"
    return f""",
gx AS (SELECT id, x, y, z, minx, miny, gcols, grows, unnest(range(CAST(floor((x - minx) / {s.b}) AS BIGINT) - 1, CAST(floor((x - minx) / {s.b}) AS BIGINT) + 2)) AS ci FROM p, prm),
gy AS (SELECT *, unnest(range(CAST(floor((y - miny) / {s.b}) AS BIGINT) - 1, CAST(floor((y - miny) / {s.b}) AS BIGINT) + 2)) AS cj FROM gx WHERE ci >= 0 AND ci < gcols AND x > {c('ci', 'minx')} - {r} AND x < {c('ci', 'minx')} + {r}),
gc AS (SELECT id, z, ci, cj FROM gy WHERE cj >= 0 AND cj < grows AND y > {c('cj', 'miny')} - {r} AND y < {c('cj', 'miny')} + {r}),
own AS (SELECT DISTINCT ci, cj FROM gc WHERE id IN (SELECT id FROM llp)),
grid AS (SELECT ci, unnest(range(0, grows)) AS cj FROM (SELECT unnest(range(0, gcols)) AS ci, grows FROM prm)),
emp AS (SELECT ci, cj FROM grid g WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.ci = g.ci AND o.cj = g.cj)),
best AS (SELECT ci, cj, min(struct_pack(z := z, id := id)) AS m FROM gc GROUP BY ci, cj),
s3 AS (SELECT b.ci, b.cj, m.z AS z, m.id AS id FROM best b WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.ci = b.ci AND o.cj = b.cj)),
seeds AS (SELECT id, 'window' AS source FROM llp UNION ALL SELECT id, 'grid' AS source FROM s3)"""


def _with(s: w.Setting, body, hole: bool = False):
    def run(spark, sf_dir):
        p = holed(spark, sf_dir) if hole else points(spark, sf_dir)
        return body(p, w.parameters(p, s), s)

    return run


def _raster_minima(p, prm, s):
    return w.raster_minima(p, prm, s)


def _gold(p, prm, s):
    lowest = lambda t: w.local_lowest(p, w.parameters(p, t), t)
    return w.gold_matches(lowest(s), lowest(w.Setting(w=8)), s)


def _gold_ratio(p, prm, s):
    found = _gold(p, prm, s).agg(F.count("*").alias("matched"))
    gold = w.local_lowest(p, w.parameters(p, w.Setting(w=8)), w.Setting(w=8)).agg(F.count("*").alias("gold"))
    return found.crossJoin(gold).select("matched", "gold", F.round(F.col("matched") / F.col("gold") * 100, 4).alias("ratio"))


def _gold_pairs(p, prm, s):
    lowest = lambda t: w.local_lowest(p, w.parameters(p, t), t)
    return w.gold_pairs(lowest(s), lowest(w.Setting(w=8)), s)


def _clean(p, prm, s):
    return w.low_outliers_removed(p, prm, 5.0, 0.8).select("id", "z")


NO_OVERLAP, NO_GRID = w.Setting(o=0.0, b=4), w.Setting(b=0)
#: an odd window, whose half side is a whole number unless ``exact``
ODD = w.Setting(w=9, exact=True)
#: overlaps of the sliding minima
SLIDING = {"owm_sliding_half": w.Setting(o=0.5), "owm_sliding_stage1": S, "owm_sliding_dense": w.Setting(o=0.95)}

QUERIES = {
    "owm_params": _with(S, lambda p, prm, s: prm.select("n", "minx", "maxx", "miny", "maxy", "width", "height", F.round("density", 6).alias("density"), "minnum", "ncols", "nrows", "gcols", "grows")),
    "owm_windows": _with(S, lambda p, prm, s: w.windows(prm, s).select("i", "j", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))),
    "owm_point_windows": _with(S, lambda p, prm, s: w.point_windows(p, prm, s)),
    "owm_window_stats": _with(S, lambda p, prm, s: w.window_stats(p, prm, s).drop("x", "y")),
    "owm_stage1": _with(S, lambda p, prm, s: w.stage1(p, prm, s).drop("x", "y")),
    "owm_tiled_stage1": _with(S, lambda p, prm, s: w.stage1(p, prm, s).select("i", "j", "n", "id", "x", "y", "z")),
    **{name: _with(t, lambda p, prm, s: w.stage1(p, prm, s, sliding=True).select("i", "j", "n", "id", "x", "y", "z")) for name, t in SLIDING.items()},
    "owm_stage1_gpu_box": _with(ODD, lambda p, prm, s: w.stage1(p, prm, s).drop("x", "y")),
    "owm_stage2": _with(S, lambda p, prm, s: w.local_lowest(p, prm, s).select("id")),
    "owm_llp_votes": _with(S, lambda p, prm, s: w.votes(w.stage1(p, prm, s), 1).select("id", "votes")),
    "owm_grid_cells": _with(S4, lambda p, prm, s: w.with_cells(p.select("id", "x", "y"), prm, s).select("id", "ci", "cj")),
    "owm_empty_cells": _with(S4, lambda p, prm, s: w.empty_cells(w.local_lowest(p, prm, s), prm, s)),
    "owm_stage3": _with(S4, lambda p, prm, s: w.fill(p, w.local_lowest(p, prm, s), prm, s).drop("x", "y")),
    "owm_stage3_holed": _with(S4, lambda p, prm, s: w.fill(p, w.local_lowest(p, prm, s), prm, s).drop("x", "y"), hole=True),
    "owm_seed_points": lambda spark, d: seed_points(points(spark, d), S4),
    "owm_seed_points_default": lambda spark, d: seed_points(points(spark, d), S),
    "owm_no_overlap": lambda spark, d: seed_points(points(spark, d), NO_OVERLAP),
    "owm_no_grid": lambda spark, d: seed_points(points(spark, d), NO_GRID),
    "owm_summary": lambda spark, d: summary(points(spark, d), S4),
    "owm_raster_stage1": _with(S, _raster_minima),
    "owm_raster_votes": _with(S, lambda p, prm, s: w.raster_votes(w.raster_minima(p, prm, s), p)),
    "owm_raster_fill": _with(S, lambda p, prm, s: w.raster_fill(p, w.raster_votes(w.raster_minima(p, prm, s), p), prm, 4.0)),
    "outlier_clean": _with(S, _clean),
    "gold_match_semi": _with(S, lambda p, prm, s: _gold(p, prm, s)),
    "gold_match_ratio": _with(S, _gold_ratio),
    "gold_match_pairs": _with(S, _gold_pairs),
}

_A, _B = cte(S) + pw(S), cte(S4) + pw(S4) + cells(S4)
_RASTER = cte(S) + """,
sh AS (SELECT unnest(range(0, 5)) AS si), r0 AS (SELECT a.si, b.si AS sj FROM sh a, sh b),
rc AS (SELECT id, x, y, z, density, si, sj, CAST(floor((x - minx - si * CAST(2.0 AS DOUBLE)) / 10) AS BIGINT) AS ci, CAST(floor((y - miny - sj * CAST(2.0 AS DOUBLE)) / 10) AS BIGINT) AS cj FROM p, prm, r0),
rg AS (SELECT si, sj, ci, cj, count(*) AS n, min(struct_pack(z := z, id := id)) AS m, any_value(density) AS density FROM rc GROUP BY si, sj, ci, cj),
rs AS (SELECT si, sj, ci, cj, n, m.z AS z, m.id AS id FROM rg WHERE n >= CAST(floor(CAST(0.5 AS DOUBLE) * (floor(density * 100 + 0.5) / 100) * 10 * 10 + 0.5) AS BIGINT)),
rv AS (SELECT x, y, p.z AS z, count(*) AS score FROM rs JOIN p ON p.id = rs.id GROUP BY x, y, p.z HAVING count(*) > 1)"""
_RASTER_ROWS = _RASTER.replace("rv AS (SELECT x, y, p.z AS z, count(*) AS score FROM rs JOIN p ON p.id = rs.id GROUP BY x, y, p.z HAVING count(*) > 1)", "rv AS (SELECT x, y, p.z AS z, g_id, intensity, count(*) AS score FROM rs JOIN p ON p.id = rs.id GROUP BY x, y, p.z, g_id, intensity HAVING count(*) > 1)")


def _lowest_points(s: w.Setting, name: str) -> str:
    return f"{name} AS (SELECT p.id, x, y, z FROM p JOIN ({cte(s) + pw(s)} SELECT id FROM llp) l ON l.id = p.id)"


_GOLD = cte(S) + pw(S) + ", sd AS (SELECT p.id, x, y, z FROM p WHERE id IN (SELECT id FROM llp)), " + _lowest_points(w.Setting(w=8), "gd")
_MATCH = _GOLD + ", hit AS (SELECT id, x, y, z FROM sd WHERE EXISTS (SELECT 1 FROM gd WHERE gd.x > sd.x - CAST(1.0 AS DOUBLE) AND gd.x < sd.x + CAST(1.0 AS DOUBLE) AND gd.y > sd.y - CAST(1.0 AS DOUBLE) AND gd.y < sd.y + CAST(1.0 AS DOUBLE) AND abs(sd.z - gd.z) < CAST(0.01 AS DOUBLE)))"
_SEEDS = "SELECT p.id, x, y, z, source FROM p JOIN seeds ON seeds.id = p.id"

ORACLES = {
    "owm_params": cte(S) + " SELECT n, minx, maxx, miny, maxy, width, height, round(density, 6) AS density, minnum, ncols, nrows, gcols, grows FROM prm",
    "owm_windows": cte(S) + f", wi AS (SELECT minx, miny, nrows, unnest(range(0, ncols)) AS i FROM prm), wj AS (SELECT *, unnest(range(0, nrows)) AS j FROM wi) SELECT i, j, round({cx('i', 'minx', S)}, 6) AS cx, round({cx('j', 'miny', S)}, 6) AS cy FROM wj",
    "owm_point_windows": _A + " SELECT id, z, i, j FROM pw",
    "owm_window_stats": _A + " SELECT i, j, n, m.z AS z, m.id AS id FROM ws",
    "owm_stage1": _A + " SELECT * FROM s1",
    "owm_tiled_stage1": _A + " SELECT i, j, n, p.id, x, y, p.z AS z FROM s1 JOIN p ON p.id = s1.id",
    **{name: cte(t) + pw(t) + " SELECT i, j, n, p.id, x, y, p.z AS z FROM s1 JOIN p ON p.id = s1.id" for name, t in SLIDING.items()},
    "owm_stage1_gpu_box": cte(ODD) + pw(ODD) + " SELECT * FROM s1",
    "owm_stage2": _A + " SELECT id FROM llp",
    "owm_llp_votes": _A + " SELECT id, count(*) AS votes FROM s1 GROUP BY id",
    "owm_grid_cells": _B + " SELECT id, ci, cj FROM gc",
    "owm_empty_cells": _B + " SELECT ci, cj FROM emp",
    "owm_stage3": _B + " SELECT * FROM s3",
    "owm_stage3_holed": cte(S4, True) + pw(S4) + cells(S4) + " SELECT * FROM s3",
    "owm_seed_points": f"{_B} {_SEEDS}",
    "owm_seed_points_default": f"{cte(S) + pw(S) + cells(S)} {_SEEDS}",
    "owm_no_overlap": f"{cte(NO_OVERLAP) + pw(NO_OVERLAP) + cells(NO_OVERLAP)} {_SEEDS}",
    "owm_no_grid": f"{cte(NO_GRID) + pw(NO_GRID)} SELECT p.id, x, y, z, 'window' AS source FROM p JOIN llp ON llp.id = p.id",
    "owm_summary": _B + " SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM seeds) AS seeds, (SELECT count(*) FROM p) - (SELECT count(*) FROM seeds) AS reduced",
    "owm_raster_stage1": _RASTER + " SELECT * FROM rs",
    "owm_raster_votes": _RASTER_ROWS + " SELECT * FROM rv",
    "owm_raster_fill": _RASTER_ROWS + ", k AS (SELECT id, x, y, z, CAST(floor((x - minx) / 4) AS BIGINT) AS ci, CAST(floor((y - miny) / 4) AS BIGINT) AS cj FROM p, prm), o AS (SELECT DISTINCT CAST(floor((x - minx) / 4) AS BIGINT) AS ci, CAST(floor((y - miny) / 4) AS BIGINT) AS cj FROM rv, prm), b AS (SELECT ci, cj, min(struct_pack(z := z, id := id)) AS m FROM k GROUP BY ci, cj) SELECT b.ci, b.cj, m.z AS z, m.id AS id FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ci = b.ci AND o.cj = b.cj)",
    "outlier_clean": cte(S) + ", k AS (SELECT id, z, floor((x - minx) / 5) AS ci, floor((y - miny) / 5) AS cj FROM p, prm), mn AS (SELECT ci, cj, sum(z) / count(*) AS mz FROM k GROUP BY ci, cj) SELECT id, z FROM k JOIN mn USING (ci, cj) WHERE floor(z * 100 + 0.5) / 100 > floor(CAST(0.8 AS DOUBLE) * (floor(mz * 100 + 0.5) / 100) * 100 + 0.5) / 100",
    "gold_match_pairs": _GOLD.replace("WITH p AS", "WITH RECURSIVE p AS", 1) + """,
nr AS MATERIALIZED (SELECT sd.id, gd.id AS gold, row_number() OVER (ORDER BY sd.z, sd.id, (sd.x - gd.x) * (sd.x - gd.x) + (sd.y - gd.y) * (sd.y - gd.y), gd.id) AS n FROM sd JOIN gd ON gd.x > sd.x - CAST(1.0 AS DOUBLE) AND gd.x < sd.x + CAST(1.0 AS DOUBLE) AND gd.y > sd.y - CAST(1.0 AS DOUBLE) AND gd.y < sd.y + CAST(1.0 AS DOUBLE)),
st AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS a, CAST([] AS BIGINT[]) AS b UNION ALL
 SELECT nr.n, CASE WHEN list_contains(st.a, nr.id) OR list_contains(st.b, nr.gold) THEN st.a ELSE list_append(st.a, nr.id) END, CASE WHEN list_contains(st.a, nr.id) OR list_contains(st.b, nr.gold) THEN st.b ELSE list_append(st.b, nr.gold) END FROM st JOIN nr ON nr.n = st.n + 1),
en AS (SELECT a, b FROM st ORDER BY n DESC LIMIT 1)
SELECT unnest(a) AS id, unnest(b) AS gold FROM en""",
    "gold_match_semi": _MATCH + " SELECT id, x, y, z FROM hit",
    "gold_match_ratio": _MATCH + " SELECT (SELECT count(*) FROM hit) AS matched, (SELECT count(*) FROM gd) AS gold, round((SELECT count(*) FROM hit) / (SELECT count(*) FROM gd) * 100, 4) AS ratio",
}
