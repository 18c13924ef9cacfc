"""Implicit spatial indexes: quadtrees by cell keys, Morton order, and chunked bounding-volume hierarchies."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import morton as m
from ..functions.ordering import lowest, number_of, order_key
from ..lineage import materialize
from .windows import header

MAX_DEPTH = 20


def f32(v: float) -> float:
    return struct.unpack("f", struct.pack("f", v))[0]


def geometry(head: DataFrame, axes: str = "xy") -> DataFrame:
    """Half sides (rx, ry ...), their maximum ``radius`` and the centre (cx, cy ...) of a header's box."""
    half = {a: (F.col(f"max{a}") - F.col(f"min{a}")) / 2 for a in axes}
    return head.select(*[h.alias(f"r{a}") for a, h in half.items()], F.greatest(*half.values()).alias("radius"), *[(F.col(f"min{a}") + h).alias(f"c{a}") for a, h in half.items()])


def quadrant(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """2 for the upper half in x, 1 for the upper half in y."""
    return F.when(x >= cx, 2).otherwise(0) + F.when(y >= cy, 1).otherwise(0)


def octant(x: Column, y: Column, z: Column, cx: Column, cy: Column, cz: Column) -> Column:
    """4 for the upper half in x, 2 in y, 1 in z."""
    return F.when(x >= cx, 4).otherwise(0) + F.when(y >= cy, 2).otherwise(0) + F.when(z >= cz, 1).otherwise(0)


def with_keys(points: DataFrame, depth: int, head: DataFrame | None = None, axes: str = "xy") -> DataFrame:
    """``points`` with the Morton ``key`` of their tree cell at ``depth``, and the root's ``radius``.

    The root is the square (``axes`` "xy": a quadtree) or cube ("xyz": an octree) around the box's centre with the largest half side. In a cloud without
    extent every cell is 0.
    """
    g = F.broadcast(geometry(header(points, axes) if head is None else head, axes))
    n = 1 << depth
    j = points.crossJoin(g)
    place = lambda v: F.when(F.col("radius") > 0, F.floor((F.col(v) - (F.col(f"c{v}") - F.col("radius"))) / (2 * F.col("radius")) * n)).otherwise(0)
    cells = [F.greatest(F.lit(0), F.least(F.lit(n - 1), place(v))).cast("long") for v in axes]
    return j.select(*points.columns, interleave(*cells, depth=depth).alias("key"), "radius")


def interleave(*cells: Column, depth: int) -> Column:
    """Two or three cell numbers of ``depth`` bits each as one key, the first on the highest bit of each group."""
    if len(cells) == 3:
        return m.morton3(*cells)
    x, y = cells
    if depth <= 16:
        return m.morton2(x, y)
    low = F.lit(0xFFFF)
    return F.shiftleft(m.morton2(F.shiftright(x, 16), F.shiftright(y, 16)), 32).bitwiseOR(m.morton2(x.bitwiseAND(low), y.bitwiseAND(low)))


def depth_for_radius(radius: float, least: float, level: int = 0) -> int:
    """Depth at which half a cell's radius no longer exceeds ``least``; above ``level`` at least if one is given."""
    d, r = 0, f32(radius)
    while r / 2 > least:
        if d == MAX_DEPTH:
            raise ValueError(f"a tree of {MAX_DEPTH} levels over a radius of {radius} has no cells of radius {least}")
        r /= 2
        d += 1
    return max(d, level + 1 if level else 0)


def radius_leaves(points: DataFrame, depth: int, head: DataFrame | None = None, axes: str = "xy") -> DataFrame:
    """Leaves of the least-radius tree: level, key, n, lowest (z, id) and radius of every cell with points at ``depth``."""
    g = _summaries(points, depth, head, axes)
    return g.select(F.lit(depth).alias("level"), "key", "n", "z", number_of("low").alias("id"), (F.col("radius") / float(1 << depth)).alias("radius"))


def _summaries(points: DataFrame, depth: int, head: DataFrame | None, axes: str = "xy") -> DataFrame:
    keyed = with_keys(points.select("id", *"xyz"), depth, head, axes).withColumn("low", order_key("z", "id"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), *lowest("low", "z"), F.first("radius").alias("radius"))


def _up(level: str, key: str, deepest: int, axes: str) -> Column:
    """The key at ``level`` of the node that holds a cell of the deepest level."""
    return F.expr(f"shiftright({key}, {len(axes)} * ({deepest} - {level}))")


def _split(keys: np.ndarray, counts: np.ndarray, at: int, start: int, stop: int, most: int, level: int, wide: int, empty: bool) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Leaves (level, keys, counts) below nodes that split at ``start`` - 1, and what still splits at ``stop`` (keys, counts); sorted distinct ``keys`` are of level ``at``."""
    leaves = []
    for d in range(start, stop + 1):
        node = keys >> (wide * (at - d))
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        ids, n = node[first], np.add.reduceat(counts, first)
        if empty:
            parents = np.unique(ids >> wide)
            missing = np.setdiff1d(((parents << wide)[:, None] + np.arange(1 << wide)).ravel(), ids, assume_unique=True)
            leaves.append((d, missing, np.zeros(len(missing), np.int64)))
        split = (n > most) | (d <= level)
        leaves.append((d, ids[~split], n[~split]))
        if d == stop:
            return leaves, ids[split], n[split]
        keep = np.repeat(split, np.diff(np.concatenate((first, [len(node)]))))
        keys, counts = keys[keep], counts[keep]
        if not len(keys):
            break
    return leaves, np.zeros(0, np.int64), np.zeros(0, np.int64)


def number_leaves(points: DataFrame, most: int, level: int = 0, depth: int = 10, empty: bool = True, head: DataFrame | None = None, deepest: int = 0, axes: str = "xy", bucket: int = 1_000_000, fine: int = 0) -> DataFrame:
    """Leaves (level, key, n, radius) of the tree whose leaves split above ``most`` points, and always down to ``level``.

    ``depth``, or ``deepest`` if that is more, is the deepest level, where a leaf may hold more. With ``empty``, leaves without points are given too:
    all children of a split node exist, four in a quadtree, eight in an octree.

    The tree's top is counted first, by cells of level ``fine``; below cells of more than ``bucket`` points it is counted again, until none is left. What splits there
    is dealt to buckets of like size, in one shuffle of the cloud's cell keys, each task having folded equal ones before; a bucket's subtrees are finished in one task.
    """
    wide, deepest = len(axes), max(depth, deepest)
    keyed = with_keys(points.select(*axes), deepest, head, axes)
    up = lambda d: F.shiftright("key", wide * (deepest - d)) if d < deepest else F.col("key")
    stop = min(deepest, fine or 10 // wide)
    found = keyed.groupBy(up(stop).alias("k")).agg(F.count("*").alias("n"), F.first("radius").alias("radius")).toArrow().sort_by("k")  # cells of one level
    spark, rows = points.sparkSession, "level int, key long, n long"
    if not found.num_rows:
        return spark.createDataFrame([], f"{rows}, radius double")
    k, n = found["k"].to_numpy(), found["n"].to_numpy()
    radius, total = found["radius"][0].as_py(), int(n.sum())
    # as many buckets as a driver can hold, at most
    target = max(min(bucket, max(20_000, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))), total >> 18)
    split = total > most or level >= 0
    if not split or deepest == 0:
        return spark.createDataFrame([(0, 0, total)], rows).withColumn("radius", F.lit(radius))
    leaves, ids, sizes = _split(k, n, stop, 1, stop, most, level, wide, empty)
    roots = []  # (level, key, n): nodes that split, each within one bucket
    while len(ids):
        heavy = (sizes > target) & (stop < deepest)
        roots += zip([stop] * int((~heavy).sum()), ids[~heavy].tolist(), sizes[~heavy].tolist(), strict=True)
        if not heavy.any():
            break
        above, at = F.broadcast(spark.createDataFrame([(v,) for v in ids[heavy].tolist()], "above long")), stop
        stop = min(deepest, stop + max(1, min(10, 20 - int(heavy.sum()).bit_length()) // wide))  # some million cells at most
        more = keyed.select(up(at).alias("above"), up(stop).alias("k")).join(above, "above", "left_semi").groupBy("k").agg(F.count("*").alias("n")).toArrow().sort_by("k")
        below, ids, sizes = _split(more["k"].to_numpy(), more["n"].to_numpy(), stop, at + 1, stop, most, level, wide, empty)
        leaves += below
    if stop == deepest:  # nothing splits there
        leaves.append((deepest, ids, sizes))
        roots = [r for r in roots if r[0] < deepest]
    top = [(d, int(a), int(c)) for d, keys, counts in leaves for a, c in zip(keys, counts, strict=True)]
    got = spark.createDataFrame(top, rows)
    if roots:
        roots.sort(key=lambda r: r[1] << (wide * (deepest - r[0])))
        starts = np.array([r[1] << (wide * (deepest - r[0])) for r in roots])
        ends = np.array([(r[1] + 1) << (wide * (deepest - r[0])) for r in roots])
        levels, bins = np.array([r[0] for r in roots]), np.cumsum([r[2] for r in roots]) // target

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, counts = np.unique(batch["key"].to_numpy(), return_counts=True)
                root = np.searchsorted(starts, own, "right") - 1
                inside = (root >= 0) & (own < ends[root])
                root = root[inside]
                yield pa.RecordBatch.from_arrays([pa.array(bins[root]), pa.array(root), pa.array(own[inside]), pa.array(counts[inside])], ["bucket", "root", "key", "n"])

        def finish(table: pa.Table) -> pa.Table:
            own, where = np.unique(table["key"].to_numpy(), return_inverse=True)
            counts = np.bincount(where, table["n"].to_numpy()).astype(np.int64)
            root = np.searchsorted(starts, own, "right") - 1
            out = []
            for r in np.unique(root):
                mine = root == r
                below, ids, sizes = _split(own[mine], counts[mine], deepest, int(levels[r]) + 1, deepest, most, level, wide, empty)
                out += [*below, (deepest, ids, sizes)]
            columns = [np.concatenate([np.full(len(a), d, np.int32) for d, a, _ in out]), np.concatenate([a for _, a, _ in out]), np.concatenate([c for _, _, c in out])]
            return pa.table([pa.array(c) for c in columns], ["level", "key", "n"])

        cells = keyed.select("key").mapInArrow(fold, "bucket long, root long, key long, n long")
        got = got.unionByName(cells.groupBy("bucket").applyInArrow(finish, rows))
    got = got.select("level", "key", "n", (F.lit(radius) / F.pow(F.lit(2.0), F.col("level"))).alias("radius"))
    return got if empty else got.filter("n > 0")


def leaf_centres(leaves: DataFrame, head: DataFrame) -> DataFrame:
    """``leaves`` of a quadtree (level, key, n, radius) with the centre (x, y) of each cell."""
    g = F.broadcast(geometry(head).select(F.col("radius").alias("_r"), "cx", "cy"))
    low = F.lit(0xFFFFFFFF)
    upper, lower = m.unmorton2(F.shiftrightunsigned("key", 32)), m.unmorton2(F.col("key").bitwiseAND(low))
    cells = [F.shiftleft(a, 16).bitwiseOR(b) for a, b in zip(upper, lower, strict=True)]
    at = lambda c, k: (F.col(c) - F.col("_r") + (2 * k + 1) * F.col("radius")).alias(c[1])
    return leaves.crossJoin(g).select(*leaves.columns, at("cx", cells[0]), at("cy", cells[1]))


def rollup(points: DataFrame, depth: int, head: DataFrame | None = None, axes: str = "xy") -> DataFrame:
    """level, key, n and lowest (z, id) of every node with points; each level from the leaves' summaries."""
    each = _summaries(points, depth, head, axes).select("n", "low", "z", "key", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    each = each.select("level", _up("level", "key", depth, axes).alias("key"), "n", "low", "z")
    got = each.groupBy("level", "key").agg(F.sum("n").alias("n"), *lowest("low", "z"))
    return got.select("level", "key", "n", "z", number_of("low").alias("id"))


def with_morton(points: DataFrame, head: DataFrame | None = None, axes: str = "xy") -> DataFrame:
    """``points`` with their Morton ``code`` in the box: 32 bits in two dimensions, 63 in three."""
    h = F.broadcast(header(points, axes) if head is None else head)
    j = points.crossJoin(h)
    cells = [m.scaled(F.col(a), F.col(f"min{a}"), F.col(f"max{a}"), 16 if axes == "xy" else 21) for a in axes]
    return j.select(*points.columns, (m.morton2 if axes == "xy" else m.morton3)(*cells).alias("code"))


def morton_sorted(points: DataFrame, partitions: int, most: int = 1_000_000) -> DataFrame:
    """``points`` dealt and sorted by (code, id): near points stand together, so files prune by their coordinates' ranges.

    They are dealt to ``partitions``, or to more where these would hold over ``most`` points each on average, as a task sorts one.
    """
    head = materialize(header(points))
    many = max(partitions, -(-head.first().n // most))
    return with_morton(points, head).repartitionByRange(many, "code", "id").sortWithinPartitions("code", "id")


def dense_rank(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``rows`` with their 0-based dense ``rank`` in an ``order``, written.

    They are dealt by ranges of the order, cut at sampled quantiles, and numbered within a range; a range's first rank is the number of rows before it. No task sees all rows, however they
    crowd, and rows that are alike in the order may stand in either order.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt)
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("c"))  # a row for each range
    firsts = counts.select("_part", (F.sum("c").over(Window.orderBy("_part")) - F.col("c")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(F.broadcast(firsts), "_part").select(*rows.columns, (F.col("_before") + within).alias(name))


def ranked(points: DataFrame, head: DataFrame | None = None, axes: str = "xy") -> DataFrame:
    """``points`` with ``code`` and their 0-based ``rank`` by (code, id), dense."""
    return dense_rank(with_morton(points, head, axes), "code", "id")


def shuffled(points: DataFrame, mixed: Column) -> DataFrame:
    """``points`` in a random order: with a 0-based dense ``position`` by ``mixed`` (a hash of the row), ties by id."""
    return dense_rank(points.withColumn("_mixed", mixed), "_mixed", "id", name="position").drop("_mixed")


def gathered(points: DataFrame, index: DataFrame) -> DataFrame:
    """``points`` reordered by ``index`` (position, id): the row with that id at each position; positions without a row are left out."""
    return index.select("position", "id").join(points, "id")


def reversed_order(points: DataFrame, name: str = "reversed") -> DataFrame:
    """``points`` with ids from 1 to n and the ids that they have when the cloud is turned round."""
    return points.crossJoin(F.broadcast(points.agg(F.max("id").alias("_last")))).select(*points.columns, (F.col("_last") - F.col("id") + 1).alias(name))


def subcloud(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``points`` whose id is in ``ids`` (id)."""
    return points.join(ids.select("id"), "id", "left_semi")


def chunks(points: DataFrame, size: int, head: DataFrame | None = None, axes: str = "xy") -> DataFrame:
    """Leaves of ``size`` consecutive ranks: chunk, n, box (xmin, ymin ..., xmax, ymax ...) and lowest (z, id)."""
    g = ranked(points.select("id", *"xyz"), head, axes=axes).withColumn("low", order_key("z", "id")).withColumn("chunk", F.floor(F.col("rank") / size).cast("long")).groupBy("chunk")
    got = g.agg(F.count("*").alias("n"), *[f(a).alias(f"{a}{name}") for name, f in (("min", F.min), ("max", F.max)) for a in axes], *lowest("low", "z"))
    return got.select("chunk", "n", *[f"{a}{name}" for name in ("min", "max") for a in axes], "z", number_of("low").alias("id"))


def chunk_rollup(leaves: DataFrame, levels: int) -> DataFrame:
    """level, node and the merged summary of the hierarchy above chunks: node = chunk shifted right by level."""
    each = leaves.withColumn("low", order_key("z", "id")).select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("node", F.expr("shiftright(chunk, level)"))
    got = each.groupBy("level", "node").agg(F.sum("n").alias("n"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), *lowest("low", "z"))
    return got.select("level", "node", "n", "xmin", "ymin", "xmax", "ymax", "z", number_of("low").alias("id"))


def decimated(points: DataFrame, depth: int, head: DataFrame | None = None) -> DataFrame:
    """The highest and the lowest point of each cell, one row if they are the same."""
    keyed = with_keys(points.select("id", *"xyz"), depth, head)
    g = keyed.groupBy("key").agg(F.min(order_key("z", "id")).alias("a"), F.max(order_key("z", F.negate("id"))).alias("b"))
    ids = g.select(F.explode(F.array_distinct(F.array(number_of("a"), F.negate(number_of("b"))))).alias("id"))
    return points.join(ids, "id", "left_semi")
