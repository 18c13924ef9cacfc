"""Queries of the spatial indexes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morton as m
from ..operators import index as ix
from ..operators import stats as st
from ..operators import trees as tr
from ..operators import upkeep
from ..operators.windows import header
from ..lineage import materialize
from ..sources.cloud import POINTS3_SQL, POINTS_SQL, points, points3
from .q_windows import S4, cells, cte, pw
from .seeds import seed_points

#: with 24 points a leaf at most, the leaves of the test clouds stand at several levels; FORCED: all split down to that level
DEPTH, MOST, LEVEL, FORCED, CHUNK, DEPTH3, MOST3 = 6, 24, 2, 5, 64, 3, 32

P = f"""WITH p AS ({POINTS_SQL}),
hd AS (SELECT count(*) AS n, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM p),
geo AS (SELECT (maxx - minx) / 2 AS rx, (maxy - miny) / 2 AS ry, greatest((maxx - minx) / 2, (maxy - miny) / 2) AS radius, minx + (maxx - minx) / 2 AS cx, miny + (maxy - miny) / 2 AS cy FROM hd)"""


def _bits(x: str, y: str, n: int) -> str:
    """Interleaved bits by arithmetic, x on the higher of each two."""
    return " + ".join(f"((({x} >> {b}) & 1) << {2 * b + 1}) + ((({y} >> {b}) & 1) << {2 * b})" for b in range(n))


def _unbits(key: str, low: int) -> str:
    """The cell number in x (``low`` 0) or y (1) of a quadtree key of up to 20 levels."""
    return "(" + " + ".join(f"((({key} >> {2 * b + 1 - low}) & 1) << {b})" for b in range(20)) + ")"


def _bits3(x: str, y: str, z: str, n: int) -> str:
    return " + ".join(f"((({x} >> {b}) & 1) << {3 * b + 2}) + ((({y} >> {b}) & 1) << {3 * b + 1}) + ((({z} >> {b}) & 1) << {3 * b})" for b in range(n))


def _keyed(depth: int) -> str:
    n = 1 << depth
    cell = lambda v, c: f"greatest(0, least({n - 1}, CAST(floor(({v} - ({c} - radius)) / (2 * radius) * {n}) AS BIGINT)))"
    return f""",
kc AS (SELECT id, x, y, z, g_id, intensity, radius, {cell('x', 'cx')} AS kx, {cell('y', 'cy')} AS ky FROM p, geo),
ky AS (SELECT *, {_bits('kx', 'ky', depth)} AS key FROM kc)"""


def _tree(src: str, keyed: str, wide: int, most: int, level: int) -> str:
    """lf: the leaves of a tree, level by level from the root; each level's nodes are joined to those that split above."""
    deep = ix.MAX_DEPTH
    out = [f"{src}{keyed}", f"c{deep} AS MATERIALIZED (SELECT key, count(*) AS n FROM ky GROUP BY key)"]
    out += [f"c{v} AS MATERIALIZED (SELECT key >> {wide} AS key, CAST(sum(n) AS BIGINT) AS n FROM c{v + 1} GROUP BY 1)" for v in range(deep - 1, -1, -1)]
    split = lambda v: f"(n > {most} OR {v} <= {level})" if v < deep else "false"
    out.append(f"t0 AS MATERIALIZED (SELECT key, n, {split(0)} AS split FROM c0)")
    for v in range(1, deep + 1):
        out.append(f"t{v} AS MATERIALIZED (SELECT key, n, {split(v)} AND n > 0 AS split FROM (SELECT (t.key << {wide}) + q AS key, coalesce(c.n, 0) AS n FROM t{v - 1} t CROSS JOIN (SELECT unnest(range(0, {1 << wide})) AS q) LEFT JOIN c{v} c ON c.key = (t.key << {wide}) + q WHERE t.split))")
    union = " UNION ALL ".join(f"SELECT {v} AS level, key, n FROM t{v} WHERE NOT split" for v in range(deep + 1))
    out.append(f"lf AS (SELECT CAST(level AS INT) AS level, key, CAST(n AS BIGINT) AS n, geo.radius / pow(2.0, level) AS radius FROM ({union}), geo)")
    return ",\n".join(out)


_NODES = _tree(P, _keyed(ix.MAX_DEPTH), 2, MOST, LEVEL)


def leaves(spark, d):
    return ix.number_leaves(points(spark, d), MOST, LEVEL, ix.MAX_DEPTH)


def octree_leaves(spark, d):
    return ix.number_leaves(points3(spark, d), MOST3, 0, ix.MAX_DEPTH, axes="xyz")


def forced_leaves(spark, d):
    return ix.number_leaves(points(spark, d), MOST, FORCED, ix.MAX_DEPTH, fine=3, bucket=2000)


def _sub(spark, d, of):
    """A query over the tree of the seed points, a part of the cloud."""
    p = points(spark, d)
    head, parents = materialize(header(p)), materialize(leaves(spark, d).select("level", "key", "n"))
    return of(p, materialize(seed_points(p, S4).select("id")), parents, head)


def _upkeep(spark, d):
    """The summaries after four batches: a group's points deleted, one's moved (some beyond the box), copies of one inserted below it, and every leaf's lowest point deleted."""
    p = points(spark, d)
    tree = upkeep.build(p, DEPTH)
    none = [F.lit(None).cast("double").alias(a) for a in "xyz"]
    tree = tree.changed(p.filter("g_id = 7").select("id", F.lit("delete").alias("op"), *none))
    tree = tree.changed(p.filter("g_id = 6").select("id", F.lit("move").alias("op"), F.expr("x + 1.5D").alias("x"), F.expr("y - 0.75D").alias("y"), "z"))
    tree = tree.changed(p.filter("g_id = 1").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("insert").alias("op"), "x", "y", F.expr("z - 1D").alias("z")))
    return tree.changed(tree.summaries().filter(F.col("level") == DEPTH).select("id", F.lit("delete").alias("op"), *none)).summaries()


def _octant(spark, d):
    p = points3(spark, d)
    g = F.broadcast(ix.geometry(header(p, "xyz"), "xyz"))
    return p.crossJoin(g).select("id", ix.octant(*[F.col(c) for c in ("x", "y", "z", "cx", "cy", "cz")]).alias("octant"))


def _mixed():
    """A 32-bit hash that SQL can compute too."""
    return F.pmod(F.col("id") * 2654435761, F.lit(1 << 32))


def _gather(spark, d):
    p = points(spark, d)
    index = ix.shuffled(p.select("id"), _mixed()).select("position", "id")
    return ix.gathered(p, index).select("position", "id", "x", "y", "z")


def _morton3(spark, d):
    e = points3(spark, d)
    c = lambda v: F.floor((F.col(v) + 1024) * 512).cast("long")
    return e.select("id", m.morton3(c("x"), c("y"), c("z")).alias("code"))


def _morton3_decode(spark, d):
    x, y, z = m.unmorton3(F.col("code"))
    return _morton3(spark, d).select("id", x.alias("cx"), y.alias("cy"), z.alias("cz"))


def _morton30(spark, d):
    u = lambda v: (F.col(v) + 4) / 8
    return points3(spark, d).select("id", m.morton30(u("x"), u("y"), u("z")).alias("code"))


def _decode(spark, d):
    a, b = m.unmorton2(F.col("code"))
    return ix.with_morton(points(spark, d)).select("id", a.alias("mx"), b.alias("my"))


def _upper(spark, d):
    p = ix.with_morton(points(spark, d)).select("id", "code")
    return p.select("id", m.common_upper_bits(F.col("code"), F.shiftright("code", 1)).alias("bits"))


def _r(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


QUERIES = {
    "bbox_geometry": lambda s, d: _r(ix.geometry(header(points(s, d))), "rx", "ry", "radius", "cx", "cy"),
    "quadrant_id": lambda s, d: points(s, d).crossJoin(F.broadcast(ix.geometry(header(points(s, d))))).select("id", ix.quadrant(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")).alias("quadrant")),
    "qtree_minradius_leaves": lambda s, d: _r(ix.radius_leaves(points(s, d), ix.depth_for_radius(43.0, 0.5)), "radius"),
    "qtree_maxnum_leaves": lambda s, d: _r(leaves(s, d), "radius"),
    "qtree_forced_leaves": lambda s, d: _r(forced_leaves(s, d), "radius"),
    "qtree_rollup": lambda s, d: ix.rollup(points(s, d), DEPTH),
    "octree_minradius_leaves": lambda s, d: _r(ix.radius_leaves(points3(s, d), DEPTH3, axes="xyz"), "radius"),
    "octree_maxnum_leaves": lambda s, d: _r(octree_leaves(s, d), "radius"),
    "octree_rollup": lambda s, d: ix.rollup(points3(s, d), DEPTH3, axes="xyz"),
    "octant_id": _octant,
    "shuffle_order": lambda s, d: ix.shuffled(points(s, d).select("id", "z"), _mixed()),
    "gather_order": _gather,
    "reverse_order": lambda s, d: ix.reversed_order(points(s, d).select("id")),
    "morton_sorted": lambda s, d: ix.morton_sorted(points(s, d), 4).select("id", "code", "x", "y", "z"),
    "morton2d": lambda s, d: ix.with_morton(points(s, d)).select("id", "code"),
    "morton2d_decode": _decode,
    "morton3d": _morton3,
    "morton3d_decode": _morton3_decode,
    "morton30": _morton30,
    "morton_common_bits": _upper,
    "morton_order": lambda s, d: ix.ranked(points(s, d)).select("id", "code", "rank"),
    "bvh_leaf_chunks": lambda s, d: ix.chunks(points(s, d), CHUNK),
    "bvh_rollup": lambda s, d: ix.chunk_rollup(ix.chunks(points(s, d), CHUNK), 4),
    "bvh_rollup_octree": lambda s, d: ix.chunk_rollup(ix.chunks(points(s, d), CHUNK), 9).filter("level % 3 = 0"),
    "radix_topology": lambda s, d: tr.cloud_topology(points(s, d)),
    "one_point_leaves": lambda s, d: tr.one_point_leaves(points(s, d), axes="xy"),
    "one_point_leaves_3d": lambda s, d: tr.one_point_leaves(points3(s, d), 0.005),
    "subcloud_leaves": lambda s, d: _sub(s, d, lambda p, ids, parents, head: tr.sub_leaves(p, ids, parents, 4, head)),
    "subcloud_chunks": lambda s, d: _sub(s, d, lambda p, ids, parents, head: tr.sub_chunks(p, ids, parents, 16, head)),
    "tree_upkeep": _upkeep,
    "subcloud": lambda s, d: ix.subcloud(points(s, d), ix.radius_leaves(points(s, d), DEPTH)).select("id", "x", "y", "z"),
    "decimate_minmax": lambda s, d: ix.decimated(points(s, d), DEPTH).select("id", "x", "y", "z"),
    "point_leaf": lambda s, d: ix.with_keys(points(s, d), DEPTH).select("id", "key"),
    "leaf_centroid": lambda s, d: _r(st.centroids(ix.with_keys(points(s, d), DEPTH), "key"), "x", "y", "z", "intensity"),
    "leaf_spacing": lambda s, d: _r(st.spacing(leaves(s, d)), "area", "spacing"),
    "leaf_min_radius": lambda s, d: leaves(s, d).agg(F.round(F.min("radius"), 6).alias("radius")),
    "hist_leaf_points": lambda s, d: st.histogram(leaves(s, d), F.col("n"), "n"),
    "hist_leaf_radius": lambda s, d: st.histogram(leaves(s, d), F.round("radius", 6), "radius"),
    "hist_leaf_area": lambda s, d: st.histogram(leaves(s, d), F.round(4 * F.col("radius") * F.col("radius"), 6), "area"),
    "hist_leaf_density": lambda s, d: st.histogram(leaves(s, d), F.round(F.col("n") / (4 * F.col("radius") * F.col("radius")), 4), "density"),
    "hist_leaf_level": lambda s, d: st.histogram(leaves(s, d), F.col("level"), "level"),
    "hist_summary": lambda s, d: st.histogram_summary(leaves(s, d)),
    "hist_weighted_mean": lambda s, d: st.histogram(leaves(s, d), F.col("n"), "n").agg(F.round(st.weighted_mean(None, "n", "leaves"), 6).alias("mean")),
    "hist_mode": lambda s, d: st.mode(st.histogram(leaves(s, d).filter("n > 0"), F.col("n"), "n"), "n", "leaves"),
    "est_min_radius": lambda s, d: header(points(s, d)).select(*[F.round(F.sqrt(k / (F.col("n") / ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))))) / 2, 6).alias(f"r{k}") for k in (8, 32, 128)]),
}

_MORTON = P + f""",
mc AS (SELECT p.*, least(65535, CAST(floor((x - minx) / (maxx - minx) * 65536) AS BIGINT)) AS mx, least(65535, CAST(floor((y - miny) / (maxy - miny) * 65536) AS BIGINT)) AS my FROM p, hd),
mo AS (SELECT *, {_bits('mx', 'my', 16)} AS code FROM mc),
rk AS (SELECT *, row_number() OVER (ORDER BY code, id) - 1 AS rank FROM mo),
ck AS (SELECT rank // {CHUNK} AS chunk, count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, min(struct_pack(z := z, id := id)) AS m FROM rk GROUP BY 1)"""
_ROLL = lambda levels: f"{_MORTON}, lv AS (SELECT unnest(range(0, {levels + 1})) AS level), ro AS (SELECT CAST(level AS INT) AS level, chunk >> CAST(level AS INT) AS node, CAST(sum(n) AS BIGINT) AS n, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, min(m) AS m FROM ck, lv GROUP BY 1, 2)"
_P3 = "WITH p AS (" + POINTS3_SQL.format(a=1, b=2, c=3) + """),
hd AS (SELECT min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz FROM p),
geo AS (SELECT greatest((maxx - minx) / 2, (maxy - miny) / 2, (maxz - minz) / 2) AS radius, minx + (maxx - minx) / 2 AS cx, miny + (maxy - miny) / 2 AS cy, minz + (maxz - minz) / 2 AS cz FROM hd)"""


def _keyed3(depth: int) -> str:
    n = 1 << depth
    cell = lambda v: f"greatest(0, least({n - 1}, CAST(floor(({v} - (c{v} - radius)) / (2 * radius) * {n}) AS BIGINT))) AS k{v}"
    return f""",
kc AS (SELECT id, x, y, z, radius, {cell('x')}, {cell('y')}, {cell('z')} FROM p, geo),
ky AS (SELECT *, {_bits3('kx', 'ky', 'kz', depth)} AS key FROM kc)"""


_OCT = f"{_P3}{_keyed3(DEPTH3)}, lf AS (SELECT key, count(*) AS n, any_value(radius) AS radius, min(struct_pack(z := z, id := id)) AS m FROM ky GROUP BY key)"
_E3 = "WITH e AS (" + POINTS3_SQL.format(a=1, b=2, c=3) + ")"
_C3 = "e3 AS (SELECT id, CAST(floor((x + 1024) * 512) AS BIGINT) AS cx, CAST(floor((y + 1024) * 512) AS BIGINT) AS cy, CAST(floor((z + 1024) * 512) AS BIGINT) AS cz FROM e)"
_U3 = "e3 AS (SELECT id, greatest(0, least(1023, CAST(floor((x + 4) / 8 * 1024) AS BIGINT))) AS cx, greatest(0, least(1023, CAST(floor((y + 4) / 8 * 1024) AS BIGINT))) AS cy, greatest(0, least(1023, CAST(floor((z + 4) / 8 * 1024) AS BIGINT))) AS cz FROM e)"
_QR = f"{P}{_keyed(DEPTH)}, lf AS (SELECT key, count(*) AS n, min(struct_pack(z := z, id := id)) AS m FROM ky GROUP BY key), lv AS (SELECT unnest(range(0, {DEPTH + 1})) AS level), ro AS (SELECT CAST(level AS INT) AS level, key >> CAST(2 * ({DEPTH} - level) AS INT) AS key, CAST(sum(n) AS BIGINT) AS n, min(m) AS m FROM lf, lv GROUP BY 1, 2)"
_D = ix.depth_for_radius(43.0, 0.5)
_BOX = "n, xmin, ymin, xmax, ymax, m.z AS z, m.id AS id"

#: the inner nodes by counting every prefix of every code; a rank's bits follow those of its code
_RADIX = f"""{_MORTON},
g AS (SELECT rank, code, lead(code) OVER (ORDER BY rank) AS nx, lag(code) OVER (ORDER BY rank) AS pv FROM rk),
d AS (SELECT rank, code, CASE WHEN nx IS NULL THEN -1 WHEN nx = code THEN 72 - length(ltrim(bin(xor(rank, rank + 1)), '0')) ELSE 32 - length(ltrim(bin(xor(code, nx)), '0')) END AS r FROM g),
e AS (SELECT rank, code, unnest(range(0, 72)) AS p FROM d),
f AS (SELECT p, CASE WHEN p < 32 THEN code >> (32 - p) ELSE code END AS hi, CASE WHEN p > 32 THEN rank >> (72 - p) ELSE 0 END AS lo, rank FROM e),
h AS (SELECT p, hi, lo, min(rank) AS first, max(rank) AS last FROM f GROUP BY p, hi, lo HAVING count(*) > 1),
n AS (SELECT h.first, h.last, d.rank AS split, d.r AS prefix FROM d JOIN h ON h.p = d.r AND h.hi = (CASE WHEN d.r < 32 THEN code >> (32 - CAST(d.r AS INT)) ELSE code END) AND h.lo = (CASE WHEN d.r > 32 THEN d.rank >> (72 - CAST(d.r AS INT)) ELSE 0 END) WHERE d.r >= 0),
q AS (SELECT n.*, coalesce(a.r, -1) AS ol, b.r AS orr FROM n LEFT JOIN d a ON a.rank = n.first - 1 JOIN d b ON b.rank = n.last),
u AS (SELECT *, CASE WHEN ol < 0 AND orr < 0 THEN NULL WHEN ol > orr THEN first - 1 ELSE last END AS above FROM q),
v AS (SELECT *, CASE WHEN above IS NULL THEN 0 WHEN above = last THEN last ELSE first END AS node FROM u)"""


def _one_point(src: str, keyed, wide: int, deep: int) -> str:
    """ol: leaves of one point by counts of every level: the highest node that holds one point, or the last level's."""
    return f"""{src}{keyed(deep)},
lv AS (SELECT unnest(range(0, {deep + 1})) AS level),
nd AS (SELECT CAST(level AS INT) AS level, key >> CAST({wide} * ({deep} - level) AS INT) AS key, count(*) AS n, min(struct_pack(z := z, id := id)) AS m FROM ky, lv GROUP BY 1, 2),
ol AS (SELECT a.* FROM nd a LEFT JOIN nd b ON b.level = a.level - 1 AND b.key = a.key >> {wide} WHERE (a.n = 1 OR a.level = {deep}) AND (b.n > 1 OR a.level = 0))"""


_SEED_IDS = f"(SELECT DISTINCT id FROM ({cte(S4) + pw(S4) + cells(S4)} SELECT id FROM seeds))"
#: sf: leaves of the seed points, in the whole cloud's root; pf: the cloud's leaves
_SUB = f"""WITH pf AS ({_NODES} SELECT level, key, n FROM lf), kk AS ({P}{_keyed(ix.MAX_DEPTH)} SELECT id, key FROM ky),
sk AS (SELECT id, key FROM kk WHERE id IN {_SEED_IDS})"""
_SUB_LEAVES = f"""{_SUB}, lv AS (SELECT CAST(unnest(range(0, {ix.MAX_DEPTH + 1})) AS INT) AS level),
sn AS (SELECT level, key >> (2 * ({ix.MAX_DEPTH} - level)) AS key, count(*) AS n FROM sk, lv GROUP BY 1, 2),
sl AS (SELECT a.* FROM sn a LEFT JOIN sn b ON b.level = a.level - 1 AND b.key = a.key >> 2 WHERE a.n <= 4 AND (b.n > 4 OR a.level = 0) AND (a.level > 0)),
pn AS (SELECT level, key >> (2 * ({ix.MAX_DEPTH} - level)) AS key, count(*) AS n FROM kk, lv GROUP BY 1, 2)
SELECT sl.level, sl.key, sl.n, CAST(coalesce((SELECT sum(pf.n) FROM pf WHERE pf.n > 0 AND pf.level >= sl.level AND pf.key >> (2 * greatest(0, pf.level - sl.level)) = sl.key),
 (SELECT max(pf.n) FROM pf WHERE pf.level < sl.level AND sl.key >> (2 * greatest(0, sl.level - pf.level)) = pf.key)) AS BIGINT) AS parent_n,
 greatest(1, (SELECT count(*) FROM pf WHERE pf.n > 0 AND pf.level >= sl.level AND pf.key >> (2 * greatest(0, pf.level - sl.level)) = sl.key)) AS parent_leaves FROM sl"""

#: the cloud after the changes, in the first cloud's root
_UPKEEP = f"""{P},
c1 AS (SELECT CASE WHEN g_id = 6 THEN x + CAST(1.5 AS DOUBLE) ELSE x END AS x, CASE WHEN g_id = 6 THEN y - CAST(0.75 AS DOUBLE) ELSE y END AS y, z, id FROM p WHERE g_id <> 7
 UNION ALL SELECT x, y, z - CAST(1 AS DOUBLE), id + 1000000000 FROM p WHERE g_id = 1),
kc AS (SELECT c1.*, {", ".join(f"greatest(0, least({(1 << DEPTH) - 1}, CAST(floor(({v} - (c{v} - radius)) / (2 * radius) * {1 << DEPTH}) AS BIGINT))) AS k{v}" for v in "xy")} FROM c1, geo),
ky AS (SELECT *, {_bits("kx", "ky", DEPTH)} AS key FROM kc),
gone AS (SELECT min(struct_pack(z := z, id := id)).id AS id FROM ky GROUP BY key),
lf AS (SELECT key, count(*) AS n, min(struct_pack(z := z, id := id)) AS m FROM ky WHERE id NOT IN (SELECT id FROM gone) GROUP BY key),
lv AS (SELECT CAST(unnest(range(0, {DEPTH + 1})) AS INT) AS level)
SELECT level, key >> (2 * ({DEPTH} - level)) AS key, CAST(sum(n) AS BIGINT) AS n, min(m).z AS z, min(m).id AS id FROM lf, lv GROUP BY 1, 2"""

ORACLES = {
    "radix_topology": _RADIX + " SELECT v.node, w.node AS parent, v.first, v.last, v.split, CAST(v.prefix AS INT) AS prefix, v.first = v.split AS left_leaf, v.last = v.split + 1 AS right_leaf FROM v LEFT JOIN v w ON w.split = v.above",
    "one_point_leaves": _one_point(P, _keyed, 2, ix.depth_for_radius(43.0, 0.10)) + " SELECT level, key, n, m.z AS z, m.id AS id FROM ol",
    "one_point_leaves_3d": _one_point(_P3, _keyed3, 3, ix.depth_for_radius(0.4, 0.005)) + " SELECT level, key, n, m.z AS z, m.id AS id FROM ol",
    "subcloud_leaves": _SUB_LEAVES,
    "subcloud_chunks": f"{_SUB}, r AS (SELECT *, (row_number() OVER (ORDER BY key, id) - 1) // 16 AS chunk FROM sk) SELECT chunk, count(*) AS n, min(r.key) AS first_key, max(r.key) AS last_key, count(DISTINCT (pf.level, pf.key)) AS parent_leaves FROM r JOIN pf ON r.key >> (2 * ({ix.MAX_DEPTH} - pf.level)) = pf.key GROUP BY chunk",
    "tree_upkeep": _UPKEEP,
    "bbox_geometry": P + " SELECT round(rx, 6) AS rx, round(ry, 6) AS ry, round(radius, 6) AS radius, round(cx, 6) AS cx, round(cy, 6) AS cy FROM geo",
    "quadrant_id": P + " SELECT id, CASE WHEN x >= cx THEN 2 ELSE 0 END + CASE WHEN y >= cy THEN 1 ELSE 0 END AS quadrant FROM p, geo",
    "qtree_minradius_leaves": f"{P}{_keyed(_D)} SELECT {_D} AS level, key, count(*) AS n, min(struct_pack(z := z, id := id)).z AS z, min(struct_pack(z := z, id := id)).id AS id, round(any_value(radius) / {1 << _D}, 6) AS radius FROM ky GROUP BY key",
    "qtree_maxnum_leaves": _NODES + " SELECT level, key, n, round(radius, 6) AS radius FROM lf",
    "qtree_forced_leaves": _tree(P, _keyed(ix.MAX_DEPTH), 2, MOST, FORCED) + " SELECT level, key, n, round(radius, 6) AS radius FROM lf",
    "octree_minradius_leaves": f"{_OCT} SELECT {DEPTH3} AS level, key, n, m.z AS z, m.id AS id, round(radius / {1 << DEPTH3}, 6) AS radius FROM lf",
    "octree_maxnum_leaves": _tree(_P3, _keyed3(ix.MAX_DEPTH), 3, MOST3, 0) + " SELECT level, key, n, round(radius, 6) AS radius FROM lf",
    "octree_rollup": f"{_OCT}, lv AS (SELECT unnest(range(0, {DEPTH3 + 1})) AS level), ro AS (SELECT CAST(level AS INT) AS level, key >> CAST(3 * ({DEPTH3} - level) AS INT) AS key, CAST(sum(n) AS BIGINT) AS n, min(m) AS m FROM lf, lv GROUP BY 1, 2) SELECT level, key, n, m.z AS z, m.id AS id FROM ro",
    "octant_id": _P3 + " SELECT id, CASE WHEN x >= cx THEN 4 ELSE 0 END + CASE WHEN y >= cy THEN 2 ELSE 0 END + CASE WHEN z >= cz THEN 1 ELSE 0 END AS octant FROM p, geo",
    "shuffle_order": P + " SELECT id, z, row_number() OVER (ORDER BY (id * 2654435761) % 4294967296, id) - 1 AS position FROM p",
    "gather_order": P + " SELECT row_number() OVER (ORDER BY (id * 2654435761) % 4294967296, id) - 1 AS position, id, x, y, z FROM p",
    "reverse_order": P + " SELECT id, (SELECT max(id) FROM p) - id + 1 AS reversed FROM p",
    "morton_sorted": _MORTON + " SELECT id, code, x, y, z FROM mo",
    "qtree_rollup": _QR + " SELECT level, key, n, m.z AS z, m.id AS id FROM ro",
    "morton2d": _MORTON + " SELECT id, code FROM mo",
    "morton2d_decode": _MORTON + " SELECT id, mx, my FROM mo",
    "morton3d": f"{_E3}, {_C3} SELECT id, {_bits3('cx', 'cy', 'cz', 21)} AS code FROM e3",
    "morton3d_decode": f"{_E3}, {_C3} SELECT id, cx, cy, cz FROM e3",
    "morton30": f"{_E3}, {_U3} SELECT id, {_bits3('cx', 'cy', 'cz', 10)} AS code FROM e3",
    "morton_common_bits": _MORTON + " SELECT id, CASE WHEN code = 0 THEN 64 ELSE 64 - length(ltrim(bin(xor(code, code >> 1)), '0')) END AS bits FROM mo",
    "morton_order": _MORTON + " SELECT id, code, rank FROM rk",
    "bvh_leaf_chunks": f"{_MORTON} SELECT chunk, {_BOX} FROM ck",
    "bvh_rollup": f"{_ROLL(4)} SELECT level, node, {_BOX} FROM ro",
    "bvh_rollup_octree": f"{_ROLL(9)} SELECT level, node, {_BOX} FROM ro WHERE level % 3 = 0",
    "subcloud": _QR + f" SELECT id, x, y, z FROM p WHERE id IN (SELECT m.id FROM ro WHERE level = {DEPTH})",
    "decimate_minmax": f"{P}{_keyed(DEPTH)}, e AS (SELECT min(struct_pack(z := z, id := id)).id AS a, -max(struct_pack(z := z, id := -id)).id AS b FROM ky GROUP BY key) SELECT id, x, y, z FROM p WHERE id IN (SELECT a FROM e) OR id IN (SELECT b FROM e)",
    "point_leaf": f"{P}{_keyed(DEPTH)} SELECT id, key FROM ky",
    "leaf_centroid": f"{P}{_keyed(DEPTH)} SELECT key, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(intensity), 6) AS intensity FROM ky GROUP BY key",
    "leaf_spacing": _NODES + " SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(4 * radius * radius), 6) AS area, round(sqrt(sum(4 * radius * radius) / sum(n)), 6) AS spacing FROM lf WHERE n > 0",
    "leaf_min_radius": _NODES + " SELECT round(min(radius), 6) AS radius FROM lf",
    "hist_leaf_points": _NODES + " SELECT n, count(*) AS leaves FROM lf GROUP BY n",
    "hist_leaf_radius": _NODES + " SELECT round(radius, 6) AS radius, count(*) AS leaves FROM lf GROUP BY 1",
    "hist_leaf_area": _NODES + " SELECT round(4 * radius * radius, 6) AS area, count(*) AS leaves FROM lf GROUP BY 1",
    "hist_leaf_density": _NODES + " SELECT round(n / (4 * radius * radius), 4) AS density, count(*) AS leaves FROM lf GROUP BY 1",
    "hist_leaf_level": _NODES + " SELECT level, count(*) AS leaves FROM lf GROUP BY level",
    "hist_summary": _NODES + " SELECT count(*) AS leaves, CAST(sum(n) AS BIGINT) AS points, CAST(floor(sum(n) / count(*)) AS BIGINT) AS mean, min(n) AS least, max(n) AS most FROM lf",
    "hist_weighted_mean": _NODES + ", h AS (SELECT n, count(*) AS leaves FROM lf GROUP BY n) SELECT round(sum(n * leaves) / sum(leaves), 6) AS mean FROM h",
    "hist_mode": _NODES + ", h AS (SELECT n, count(*) AS leaves FROM lf WHERE n > 0 GROUP BY n) SELECT n, leaves FROM h ORDER BY leaves DESC, n LIMIT 1",
    "est_min_radius": P + " SELECT " + ", ".join(f"round(sqrt({k} / (n / ((maxx - minx) * (maxy - miny)))) / 2, 6) AS r{k}" for k in (8, 32, 128)) + " FROM hd",
}
