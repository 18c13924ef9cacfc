"""Trees as tables: the nodes of a binary radix tree, leaves of one point, and the tree of a part of a cloud."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import lowest, number_of, order_key
from ..lineage import materialize
from .index import MAX_DEPTH, dense_rank, depth_for_radius, geometry, number_leaves, with_keys, with_morton
from .windows import header

#: ranks have room for so many bits
RANK_BITS = 40


def _bits(x: Column) -> Column:
    """How many bits a positive long has."""
    return F.length(F.bin(x))


def _common(a: Column, b: Column, bits: int) -> Column:
    """Leading bits, of ``bits``, that two longs share."""
    return F.when(a == b, bits).otherwise(bits - _bits(a.bitwiseXOR(b)))


def with_neighbours(rows: DataFrame, *names: str) -> DataFrame:
    """Densely ranked ``rows`` with each of the ``names`` of the row before and the row after, as ``before_`` and ``after_``; null at the ends."""
    beside = lambda mark, by: rows.select((F.col("rank") + by).alias("rank"), *[F.col(c).alias(f"{mark}_{c}") for c in names])
    return rows.join(beside("before", 1), "rank", "left").join(beside("after", -1), "rank", "left")


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    """How many bits each non-negative long has."""
    high = v >> 32
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((v & 0xFFFFFFFF).astype(np.float64))[1]).astype(np.int64)


def _shared(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks that have a next one in ``table`` (code, rank), ascending, and how many leading bits they share with it."""
    rank, code = table["rank"].to_numpy(), table["code"].to_numpy()
    order = np.argsort(rank)
    rank, code = rank[order], code[order]
    a, b = rank[:-1], rank[1:]
    return a, np.where(code[:-1] == code[1:], bits + RANK_BITS - _bit_lengths(a ^ b), bits - _bit_lengths(code[:-1] ^ code[1:]))


def _seen(share: np.ndarray) -> np.ndarray:
    """The places that are seen from the right end: each shares less than all that come after it."""
    least = np.minimum.accumulate(share[::-1])[::-1]
    return np.flatnonzero(np.concatenate((share[:-1] < least[1:], [True]))) if len(share) else np.zeros(0, np.int64)


def _nearest_less(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it, and after it, that shares less; -1 and the number of places where none does."""
    before, after = np.empty(len(share), np.int64), np.empty(len(share), np.int64)
    for v in np.unique(share):
        own, less = np.flatnonzero(share == v), np.flatnonzero(share < v)
        at = np.searchsorted(less, own)
        before[own], after[own] = np.concatenate(([-1], less))[at], np.concatenate((less, [len(share)]))[at]
    return before, after


def topology(codes: DataFrame, bits: int = 32, size: int = 1 << 20) -> DataFrame:
    """The inner nodes of the binary radix tree over sorted ``codes`` (code, rank): node, parent, first, last, split, prefix, left_leaf, right_leaf.

    Each pair of neighbours is the split of one node: the node of all codes that share the pair's common leading bits, whose number is ``prefix``. It reaches on either side to the nearest pair
    that shares less, and of these two the one that shares more is the split of its parent. Equal codes are told apart by their ranks' bits, which follow the code's.

    ``size`` consecutive ranks are one task's. From outside it needs only the pairs that are seen from its ends, each sharing less than all between: not more than a code and a rank have bits, however
    many codes there are. A first pass over the codes gives each task's own, which are put together here, and the second makes the nodes; codes and ranks are all that is shuffled.

    Nodes are numbered as the end of their range that faces their sibling: a left child by its last leaf, a right one by its first, the root 0. Children are node or leaf ``split``
    and ``split`` + 1; ``left_leaf`` and ``right_leaf`` tell which. The root's parent is null. Fewer than two codes have no node.
    """
    part, start = F.floor(F.col("rank") / size).cast("long"), F.col("rank") % size == 0
    rows = codes.filter("code IS NOT NULL").select(F.col("code").cast("long").alias("code"), F.col("rank").cast("long").alias("rank"))
    # the first of a part closes the last pair of the part before
    dealt = rows.select("code", "rank", F.explode(F.when(start, F.array(part, part - 1)).otherwise(F.array(part))).alias("part")).groupBy("part")

    def ends(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, share = _shared(table, bits)
        left, right = len(a) - 1 - _seen(share[::-1]), _seen(share)
        at = np.concatenate((left[::-1], right))
        return pa.table({"part": pa.array(np.full(len(at), key[0].as_py())), "right": pa.array(np.arange(len(at)) >= len(left)), "rank": pa.array(a[at]), "share": pa.array(share[at])})

    found = dealt.applyInArrow(ends, "part long, right boolean, rank long, share long").toArrow().sort_by([("part", "ascending"), ("rank", "ascending")])
    parts, right, rank, share = (found[c].to_numpy() for c in ("part", "right", "rank", "share"))
    lowest_rank, highest_rank = (int(rank.min()), int(rank.max()) + 1) if len(rank) else (0, 0)
    names, starts = np.unique(parts, return_index=True)
    whole = [slice(a, b) for a, b in itertools.pairwise([*starts, len(parts)])]
    own = {int(p): [(rank[w][m], share[w][m]) for m in (~right[w], right[w])] for p, w in zip(names, whole, strict=True)}
    before, after, none = {}, {}, (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def seen(r: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = _seen(n)
        return r[kept], n[kept]

    beside = none
    for p, (_, (r, n)) in own.items():
        before[p] = beside
        beside = seen(np.concatenate((beside[0], r)), np.concatenate((beside[1], n)))
    beside = none
    for p, ((r, n), _) in reversed(own.items()):
        after[p] = beside
        beside = tuple(v[::-1] for v in seen(np.concatenate((r, beside[0]))[::-1], np.concatenate((n, beside[1]))[::-1]))
    ranges = {p: (before[p], after[p]) for p in own}

    def nodes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, share = _shared(table, bits)
        (r0, n0), (r1, n1) = ranges.get(key[0].as_py(), (none, none))
        rank, share, mine = np.concatenate((r0, a, r1)), np.concatenate((n0, share, n1)), slice(len(r0), len(r0) + len(a))
        lo, hi = _nearest_less(share)
        first = np.where(lo >= 0, rank[lo] + 1, lowest_rank) if len(rank) else rank
        last = np.where(hi < len(rank), np.append(rank, 0)[hi], highest_rank)
        l, r = np.append(share, -1)[lo], np.append(share, -1)[hi]  # noqa: E741
        root, above = (l < 0) & (r < 0), np.where(l > r, lo, hi)
        node = np.where(root, 0, np.where(l > r, first, last))
        parent = np.append(node, 0)[above]
        first, last, split = first[mine], last[mine], rank[mine]
        cols = [node[mine], pa.array(parent[mine], mask=root[mine]), first, last, split, share[mine].astype(np.int32), first == split, last == split + 1]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=["node", "parent", "first", "last", "split", "prefix", "left_leaf", "right_leaf"])

    return dealt.applyInArrow(nodes, "node long, parent long, first long, last long, split long, prefix int, left_leaf boolean, right_leaf boolean")


def cloud_topology(points: DataFrame) -> DataFrame:
    """The ``topology`` over a cloud's Morton codes, ties by id."""
    return topology(dense_rank(with_morton(points.select("id", *"xy")).select("code", "id"), "code", "id").select("code", "rank"))


def one_point_leaves(points: DataFrame, least: float = 0.10, axes: str = "xyz") -> DataFrame:
    """Leaves (level, key, n, z, id of the lowest point) of the tree that splits any leaf of two points as long as half its radius exceeds ``least``; leaves without points are left out.

    A leaf's level is one more than the longest prefix of its cell's key that either neighbour shares, in the order of the keys: nothing is counted level by level. Points that share a cell of the last level share its leaf.
    """
    head = materialize(header(points, axes))
    box = geometry(head, axes).first()
    if box.radius is None:
        return points.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "z", "id").limit(0)
    deep, wide = depth_for_radius(box.radius, least), len(axes)
    keyed = with_keys(points.select("id", *"xyz"), deep, head, axes).withColumn("low", order_key("z", "id"))
    cells = dense_rank(keyed.groupBy("key").agg(F.count("*").alias("n"), *lowest("low", "z")), "key")
    near = with_neighbours(cells, "key")
    levels = lambda c: F.coalesce(F.floor(_common(F.col("key"), F.col(c), wide * deep) / wide), F.lit(-1))
    level = F.when(F.col("n") > 1, deep).otherwise(F.least(F.lit(deep), F.greatest(levels("before_key"), levels("after_key")) + 1)).cast("int")
    return near.withColumn("level", level).select("level", F.expr(f"shiftright(key, {wide} * ({deep} - level))").alias("key"), "n", "z", number_of("low").alias("id"))


def holding(keys: DataFrame, leaves: DataFrame, deep: int, axes: str = "xy") -> DataFrame:
    """``keys`` (with a ``key`` of level ``deep``) with the leaf (leaf_level, leaf_key) that holds each."""
    each = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("leaf_level"))
    each = each.withColumn("leaf_key", F.expr(f"shiftright(key, {len(axes)} * ({deep} - leaf_level))"))
    return each.join(leaves.select(F.col("level").alias("leaf_level"), F.col("key").alias("leaf_key")), ["leaf_level", "leaf_key"])


def sub_index(points: DataFrame, ids: DataFrame, head: DataFrame, deep: int = MAX_DEPTH, axes: str = "xy") -> DataFrame:
    """The index of a part of a cloud: the ids of ``ids`` alone, each with its cell's ``key`` in the whole cloud's tree."""
    return with_keys(points.select("id", *axes).join(ids.select("id").distinct(), "id", "left_semi"), deep, head, axes).select("id", "key")


def sub_leaves(points: DataFrame, ids: DataFrame, parents: DataFrame, most: int, head: DataFrame, axes: str = "xy") -> DataFrame:
    """Leaves (level, key, n) of the tree of a part of a cloud, with what the cloud's own tree (``parents``: its leaves) holds there: parent_n, parent_leaves.

    Both trees share their root, so a node is the same cell in both; where the part's leaf is the deeper one, its parent leaf stands above it, and parent_leaves is 1 with the n of that leaf.
    """
    part = points.join(ids.select("id").distinct(), "id", "left_semi")
    own = materialize(number_leaves(part, most, 0, MAX_DEPTH, False, head, axes=axes).select("level", "key", "n"))
    wide = len(axes)
    up = lambda df, names: df.select("*", F.explode(F.sequence(F.lit(0), "level")).alias("l")).select(*names, "l", F.expr(f"shiftright(key, {wide} * (level - l))").alias("k"))
    below = up(parents.filter("n > 0"), ["level", "key", "n"]).groupBy("l", "k").agg(F.sum("n").alias("in_n"), F.count("*").alias("in_leaves"))
    above = parents.select(F.col("level").alias("l"), F.col("key").alias("k"), F.col("n").alias("over_n"))
    got = own.join(below.select(F.col("l").alias("level"), F.col("k").alias("key"), "in_n", "in_leaves"), ["level", "key"], "left")
    over = up(own, ["level", "key"]).filter("l < level").join(above, ["l", "k"]).select("level", "key", "over_n")
    got = got.join(over, ["level", "key"], "left")
    return got.select("level", "key", "n", F.coalesce("in_n", "over_n").alias("parent_n"), F.coalesce("in_leaves", F.lit(1)).cast("long").alias("parent_leaves"))


def sub_chunks(points: DataFrame, ids: DataFrame, parents: DataFrame, size: int, head: DataFrame, axes: str = "xy") -> DataFrame:
    """Chunks of ``size`` ids of a part of a cloud, in the order of the whole cloud's cells, then ids: chunk, n, first and last key, and how many of the cloud's leaves (``parents``) it touches."""
    index = dense_rank(sub_index(points, ids, head, MAX_DEPTH, axes), "key", "id")
    held = holding(index, parents, MAX_DEPTH, axes).withColumn("chunk", F.floor(F.col("rank") / size).cast("long"))
    return held.groupBy("chunk").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.countDistinct("leaf_level", "leaf_key").alias("parent_leaves"))
