"""How many points stand in each one's box, without making the pairs, and the pairs themselves: tiles with a rim, each counted by ranks in one task.

A point stands in its own tile, and in the rim of every other tile that its box touches; tiles are eight half sides wide at least, so the rim adds about a half. In a
tile points are sorted by x; a box is then a run of them, and how many of a run lie below a rank in y is found by halving the ranks, for all boxes at once. The
work is n log n, however dense the cloud is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import materialize, small
from .windows import header

#: points of a tile on average, where boxes are small, and the most that a task counts at once
USUAL, MOST = 32_768, 500_000
#: the same in three dimensions
MOST3 = 200_000
#: candidates of the pairs that are made at once; pairs of a tile before its probes are dealt to several tasks; and pairs of a task on average
PAIRS, MOST_PAIRS, TASK_PAIRS = 1_000_000, 1_000_000_000, 50_000_000
#: cells along a tile's side by whose counts its pairs are foreseen, and at most if they seem to be too many
FEW, MANY = 4, 256
#: tiles, or parts of tiles, at most that are dealt to partitions by their numbers and not by a hash
MOST_PARTS = 100_000


@dataclass(frozen=True)
class Within:
    """A condition on a point and another near it: ``holds`` takes the values of both by column, as Spark's columns or, where pairs are made in tiles, as arrays.

    ``columns``: what it reads besides x and y. It does not hold where one of them is null. ``order``: columns in whose order what it leaves out of a point's others
    are a few runs, so that pairs made in tiles are stored small.
    """

    holds: Callable[[dict[str, Any], dict[str, Any]], Any]
    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def __and__(self, more: Within) -> Within:
        return Within(lambda p, t: self.holds(p, t) & more.holds(p, t), *(tuple(dict.fromkeys((*a, *b))) for a, b in ((self.columns, more.columns), (self.order, more.order))))

    def column(self) -> Column:
        """The condition on rows that have the other's columns behind ``t_``."""
        names = dict.fromkeys(("x", "y", *self.columns))
        return self.holds({c: F.col(c) for c in names}, {c: F.col(f"t_{c}") for c in names})


def less(a: Any, b: Any) -> Any:
    """a < b, in arrays too as Spark has it: NaN is above all."""
    return a < b if isinstance(a, Column) else (a < b) | ((b != b) & (a == a))


def differ(a: Any, b: Any) -> Any:
    """a != b, in arrays too as Spark has it: NaN equals itself."""
    return a != b if isinstance(a, Column) else (a != b) & ((a == a) | (b == b))


def counted(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, rx: float, ry: float) -> np.ndarray:
    """How many of the points (x, y) lie in the open box of each (px, py)."""
    order = np.argsort(x, kind="stable")
    xs, ys, by_y = x[order], y[order], np.sort(y)
    lo, low = np.searchsorted(xs, px - rx, "right"), np.searchsorted(by_y, py - ry, "right")
    hi, high = np.maximum(lo, np.searchsorted(xs, px + rx, "left")), np.maximum(low, np.searchsorted(by_y, py + ry, "left"))
    rank = np.empty(len(x), np.int32)
    rank[np.argsort(ys, kind="stable")] = np.arange(len(x), dtype=np.int32)
    ends = np.stack([low, high]).astype(np.int32)
    a, b, below = np.stack([lo, lo]).astype(np.int32), np.stack([hi, hi]).astype(np.int32), np.zeros(ends.shape, np.int32)
    # ranks below an end share its leading bits and have a 0 where it has its next 1: the runs are followed through a stable parting by each bit
    for bit in reversed(range(len(x).bit_length())):
        upper = (rank >> bit & 1).astype(bool)
        lower = np.concatenate(([0], np.cumsum(~upper))).astype(np.int32)
        a0, b0, one = lower[a], lower[b], (ends >> bit & 1).astype(bool)
        below += np.where(one, b0 - a0, 0)
        a, b = np.where(one, lower[-1] + a - a0, a0), np.where(one, lower[-1] + b - b0, b0)
        rank = np.concatenate((rank[~upper], rank[upper]))
    return (below[1] - below[0]).astype(np.int64)


def _runs(codes: np.ndarray) -> list[np.ndarray]:
    """The positions of each code."""
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(codes) else []


def box_counts(points: DataFrame, rx: float, ry: float | None = None, itself: bool = True, apart: str | None = None, most: int = MOST) -> DataFrame:
    """(id, n): how many points are in the open box of half sides rx, ry around each, a row for each row of ``points``; ids are one point's each.

    ``apart``: a column; only points that differ in it count, and nulls differ from nothing. Without ``itself`` a point does not count in its own box. A row whose
    coordinates are null or not finite has 0 and counts nowhere. A tile of more than ``most`` points is dealt to several tasks as parts of its boxes times
    parts of its points, whose counts add up.
    """
    half = {"x": rx, "y": rx if ry is None else ry}
    kind = points.schema["id"].dataType.simpleString()
    rows = points.select("id", *[F.col(a).cast("double").alias(a) for a in half], *([F.col(apart).alias("_g")] if apart else []))
    whole = F.lit(True)
    for a in half:
        whole = whole & F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False))
    good = rows.filter(whole)
    h = header(good).first()
    room = math.sqrt(max(h.maxx - h.minx, 0) * max(h.maxy - h.miny, 0) * USUAL / h.n) if h.n else 1.0
    side = {a: max(8 * abs(r), room) or 1.0 for a, r in half.items()}
    at = {a: F.floor(F.col(a) / side[a]).cast("long") for a in half}
    heavy = good.groupBy(*[t.alias(f"_t{a}") for a, t in at.items()]).agg(F.count("*").alias("c")).filter(F.col("c") > most)
    heavy = materialize(heavy.select("_tx", "_ty", F.ceil(F.col("c") / most).cast("int").alias("_k")))
    tiled = good
    for a, r in half.items():
        near = F.sequence(F.floor((F.col(a) - abs(r)) / side[a]).cast("long"), F.floor((F.col(a) + abs(r)) / side[a]).cast("long"))
        tiled = tiled.select("*", F.explode(near).alias(f"_t{a}"))
    tiled = tiled.withColumn("probe", (F.col("_tx") == at["x"]) & (F.col("_ty") == at["y"])).withColumn("point", F.lit(True))
    keys, parted = ["_tx", "_ty"], not heavy.isEmpty()
    if parted:
        mine = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_k")).cast("int")
        tiled = tiled.join(small(heavy, 100_000), keys, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
        tiled = tiled.withColumn("_i", mine(1)).withColumn("_j", mine(2)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        own = tiled.filter("probe").withColumn("point", F.col("_b") == F.col("_j")).withColumn("_j", F.col("_b"))
        # as a point it is in the parts of all boxes; its own is there already
        far = tiled.filter(~F.col("probe") | (F.col("_b") != F.col("_i"))).withColumn("_i", F.col("_b")).withColumn("probe", F.lit(False))
        tiled, keys = own.unionByName(far).drop("_k", "_b"), [*keys, "_i", "_j"]
    out = pa.schema([("id", good.select("id").limit(0).toArrow().schema.field("id").type), ("n", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        x, y, probe, point = (table[c].to_numpy() for c in ("x", "y", "probe", "point"))
        n = np.zeros(len(x), np.int64)
        if apart:
            code = table["_g"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            p, q = np.flatnonzero(probe & (code >= 0)), point & (code >= 0)
            n[p] = counted(x[q], y[q], x[p], y[p], rx, half["y"])
            for run in _runs(code):
                if code[run[0]] >= 0:
                    p, q = run[probe[run]], run[point[run]]
                    n[p] -= counted(x[q], y[q], x[p], y[p], rx, half["y"])
        else:
            p = np.flatnonzero(probe)
            n[p] = counted(x[point], y[point], x[p], y[p], rx, half["y"])
            if not itself:
                p = p[point[p]]
                n[p] -= (x[p] - rx < x[p]) & (x[p] < x[p] + rx) & (y[p] - half["y"] < y[p]) & (y[p] < y[p] + half["y"])
        return pa.table([table["id"].filter(pa.array(probe)), pa.array(n[probe])], schema=out)

    got = tiled.groupBy(*keys).applyInArrow(count, f"id {kind}, n long")
    if parted:
        got = got.groupBy("id").agg(F.sum("n").alias("n"))
    return got.unionByName(rows.filter(~whole).select("id", F.lit(0).cast("long").alias("n")))


def box_sums(x: np.ndarray, y: np.ndarray, z: np.ndarray, values: np.ndarray, boxes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """How many of the points (x, y, z) lie in each of the open ``boxes`` (in each axis its lower and upper sides), and the sums of the points' ``values`` (a row each).

    By ranks, as in ``counted``: a box is a run in x, whose parts below its ends in y are runs of stable partings by each bit, and in such a run the parts below its ends in z
    likewise, whose sums are differences of running sums.
    """

    def ranks(v: np.ndarray) -> np.ndarray:
        got = np.empty(len(v), np.int32)
        got[np.argsort(v, kind="stable")] = np.arange(len(v), dtype=np.int32)
        return got

    def ends(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        v = np.sort(v)
        lo = np.searchsorted(v, low, "right")
        return np.stack([lo, np.maximum(lo, np.searchsorted(v, high, "left"))]).astype(np.int32)

    order = np.argsort(x, kind="stable")
    (a, b), by_y, by_z = (ends(v, *box) for v, box in zip((x, y, z), boxes, strict=True))
    rank, third, values = ranks(y[order]), ranks(z[order]), np.column_stack([np.ones(len(x)), values])[order]
    a, b, total = np.stack([a, a]), np.stack([b, b]), np.zeros((len(by_y[0]), values.shape[1]))
    bits, sign = len(x).bit_length(), np.array([-1.0, 1.0])

    def below(third: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray, box: np.ndarray, by: np.ndarray) -> None:
        """Adds the sums over the runs a to b of a part whose ranks in z are between the box's ends."""
        live = a < b
        a, b, box, by = a[live], b[live], box[live], by[live]
        if not len(a):
            return
        # a part's own ranks in z, so that few are parted by few bits
        mine = np.sort(third)
        own, upto = np.searchsorted(mine, third).astype(np.int32), np.searchsorted(mine, by_z).astype(np.int32)
        for k in (0, 1):
            lo, hi, end, rank, v = a, b, upto[k][box], own, values
            for bit in reversed(range(len(third).bit_length())):
                upper = (rank >> bit & 1).astype(bool)
                lower = np.concatenate(([0], np.cumsum(~upper))).astype(np.int32)
                rank, v = np.concatenate((rank[~upper], rank[upper])), np.concatenate((v[~upper], v[upper]))
                lo0, hi0, one = lower[lo], lower[hi], (end >> bit & 1).astype(bool)
                add = np.flatnonzero(one & (lo0 < hi0))
                if len(add):
                    upward = np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(v[: lower[-1]], axis=0)))
                    sums = (upward[hi0[add]] - upward[lo0[add]]) * (by[add] * sign[k])[:, None]
                    for c in range(sums.shape[1]):
                        total[:, c] += np.bincount(box[add], sums[:, c], len(total))
                lo, hi = np.where(one, lower[-1] + lo - lo0, lo0), np.where(one, lower[-1] + hi - hi0, hi0)

    which = np.stack([np.arange(len(total))] * 2)
    for bit in reversed(range(bits)):
        upper = (rank >> bit & 1).astype(bool)
        lower = np.concatenate(([0], np.cumsum(~upper))).astype(np.int32)
        rank, third, values = (np.concatenate((v[~upper], v[upper])) for v in (rank, third, values))
        a0, b0, one = lower[a], lower[b], (by_y >> bit & 1).astype(bool)
        n = lower[-1]
        below(third[:n], values[:n], a0[one], b0[one], which[one], np.broadcast_to(sign[:, None], one.shape)[one])
        a, b = np.where(one, n + a - a0, a0), np.where(one, n + b - b0, b0)
    return np.rint(total[:, 0]).astype(np.int64), total[:, 1:]


def box_moments(points: DataFrame, rx: float, ry: float, rz: float, most: int = MOST3) -> DataFrame:
    """(id, n, xx, xy, xz, yy, yz, zz): the number and the population covariances of the points in the open box of half sides rx, ry, rz around each, itself included; ids are one point's each.

    Sums are taken from the tile's centre, and a tile is no wider than 64 half sides, so little is lost where they are subtracted. A tile that with its rim has more than ``most`` points is dealt to
    several tasks, as in ``box_counts``. A row whose coordinates are null or not finite has no row and counts nowhere.
    """
    half, second = {"x": rx, "y": ry, "z": rz}, ["xx", "xy", "xz", "yy", "yz", "zz"]
    sums, keys, kind = [f"_s{c}" for c in [*half, *second]], [f"_t{a}" for a in half], points.schema["id"].dataType.simpleString()
    good = points.select("id", *[F.col(a).cast("double").alias(a) for a in half]).filter(" AND ".join(f"abs({a}) < double('inf')" for a in half))
    h = header(good, "xyz").first()
    room = (math.prod(max(h[f"max{a}"] - h[f"min{a}"], 0) for a in half) * USUAL / h.n) ** (1 / 3) if h.n else 1.0
    side = {a: min(max(8 * abs(r), room), 64 * abs(r)) or 1.0 for a, r in half.items()}
    tiled = good
    for a, r in half.items():
        near = F.sequence(F.floor((F.col(a) - abs(r)) / side[a]).cast("long"), F.floor((F.col(a) + abs(r)) / side[a]).cast("long"))
        tiled = tiled.select("*", F.explode(near).alias(f"_t{a}"))
    own = F.lit(True)
    for a in half:
        own = own & (F.floor(F.col(a) / side[a]).cast("long") == F.col(f"_t{a}"))
    heavy = tiled.groupBy(*keys).agg(F.count("*").alias("c")).filter(F.col("c") > most)
    heavy = materialize(heavy.select(*keys, F.ceil(F.col("c") / most).cast("int").alias("_k")))
    tiled, parted, by = tiled.withColumn("probe", own).withColumn("point", F.lit(True)), not heavy.isEmpty(), keys
    if parted:
        mine = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_k")).cast("int")
        tiled = tiled.join(small(heavy, 100_000), keys, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
        each = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
        probes = tiled.filter("probe").withColumn("point", F.lit(False)).withColumn("_i", mine(1)).withColumn("_j", each)
        tiled, by = tiled.withColumn("probe", F.lit(False)).withColumn("_j", mine(2)).withColumn("_i", each).unionByName(probes).drop("_k"), [*keys, "_i", "_j"]
    out = pa.schema([("id", good.select("id").limit(0).toArrow().schema.field("id").type), ("n", pa.int64()), *[(c, pa.float64()) for c in sums]])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = {a: table[a].to_numpy() for a in half}
        probe, point = table["probe"].to_numpy(), table["point"].to_numpy()
        off = {a: at[a][point] - (key[i].as_py() + 0.5) * side[a] for i, a in enumerate(half)}
        values = np.column_stack([*off.values(), *[off[c[0]] * off[c[1]] for c in second]])
        n, got = box_sums(*[at[a][point] for a in half], values, [(at[a][probe] - r, at[a][probe] + r) for a, r in half.items()])
        return pa.table([table["id"].filter(pa.array(probe)), pa.array(n), *[pa.array(np.ascontiguousarray(c)) for c in got.T]], schema=out)

    got = tiled.groupBy(*by).applyInArrow(add, f"id {kind}, n long, {', '.join(f'{c} double' for c in sums)}")
    if parted:
        got = got.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])
    mean = lambda c: F.col(f"_s{c}") / F.col("n")
    return got.filter("n > 0").select("id", "n", *[(mean(c) - mean(c[0]) * mean(c[1])).alias(c) for c in second])


def _as_alike(x: np.ndarray, y: np.ndarray, rx: float, ry: float, density: float, high: np.ndarray | None = None) -> np.ndarray:
    """The order of a tile's probes in which their pairs are stored small: each follows one with nearly the same others, so a page of Parquet repeats itself.

    Strips are so thin that a step along one changes as many others as one across it. One probe of each cell half a box wide comes before all: with them a file's dictionary knows
    nearly all points, so places in it have one width from then on, which for the usual tile are two whole bytes; repeats that start amid a byte are not found.
    Of a cell these are the highest and the lowest by ``high``, if given.
    """
    thin = math.sqrt(1 / density) or 1.0
    across = np.floor((y - y.min()) / thin)
    order = np.lexsort((x, across))
    cell = np.stack([np.floor((v - v.min()) / (r or 1.0)) for v, r in ((x, rx), (y, ry))], axis=1)
    leads = [order] if high is None else [np.lexsort((x, across, -high)), np.lexsort((x, across, high))]
    # by cells, whose boxes share points: a dictionary is given up if a page's values hardly repeat
    first = np.concatenate([lead[np.unique(cell[lead], axis=0, return_index=True)[1]] for lead in leads])
    first = first[np.sort(np.unique(first, return_index=True)[1])]
    return np.concatenate((first, order[~np.isin(order, first)]))


def box_pairs(points: DataFrame, rx: float, ry: float | None = None, test: Within | None = None, along: tuple[str, ...] = (), numbered: bool = False, most: int = MOST, most_pairs: int = MOST_PAIRS, at_once: int = PAIRS) -> DataFrame:
    """(id, t_id): every point with the others in the open box of half sides rx, ry around it for which ``test`` holds; pairs of the same id are left out.

    ``along``: further columns, of the point by their names, of the other with ``t_`` before. ``numbered``: a point's pairs get a ``number`` from 0 by t_id; ids are one point's each then.
    Pairs are made in the task of the point's tile, some ``at_once``; so points are shuffled and pairs are not. The probes of a tile of more
    than ``most`` points, or of about ``most_pairs`` pairs, are dealt to several tasks, each with all points of the tile. Rows without an id, whose coordinates are null or not finite, or
    that lack a value ``test`` reads, are in no pair.
    """
    half = {"x": rx, "y": rx if ry is None else ry}
    ry = half["y"]
    read = () if test is None else tuple(c for c in test.columns if c not in ("id", "x", "y"))
    of_column = {c: (c, False) if c in points.columns else (c.removeprefix("t_"), True) for c in along}
    extra = sorted({*read, *(c for c, _ in of_column.values())} - {"id"})
    good = points.select("id", *[F.col(a).cast("double").alias(a) for a in half], *[F.col(c).alias(f"v_{c}") for c in extra])
    good = good.filter(" AND ".join(["id IS NOT NULL", *[f"abs({a}) < double('inf')" for a in half], *[f"`v_{c}` IS NOT NULL" for c in read]]))
    h = header(good).first()
    room = math.sqrt(max(h.maxx - h.minx, 0) * max(h.maxy - h.miny, 0) * USUAL / h.n) if h.n else 1.0
    side = {a: max(8 * abs(r), room) or 1.0 for a, r in half.items()}
    at = {a: F.floor(F.col(a) / side[a]).cast("long") for a in half}

    def foreseen(rows: DataFrame, size: dict[str, float]) -> DataFrame:
        """Tiles with their points and about their pairs, at most a few times too many, from the counts of cells."""
        cells = rows.groupBy(*[t.alias(f"_t{a}") for a, t in at.items()], *[F.floor(F.col(a) / size[a]).cast("long") for a in half]).agg(F.count("*").cast("double").alias("c"))
        share = math.prod(max(1.0, 2 * abs(r) / size[a]) for a, r in half.items())
        return cells.groupBy("_tx", "_ty").agg(F.sum("c").alias("c"), (F.sum(F.col("c") * F.col("c")) * share).alias("pairs"))

    tiles = materialize(foreseen(good, {a: side[a] / FEW for a in half}))
    crowded = tiles.filter(F.col("pairs") > most_pairs).select(F.col("_tx").alias("_kx"), F.col("_ty").alias("_ky"))
    if not crowded.isEmpty():  # counted anew by cells as large as the box needs
        there = good.join(small(crowded, 100_000), (at["x"] == F.col("_kx")) & (at["y"] == F.col("_ky")), "left_semi")
        better = materialize(foreseen(there, {a: max(abs(r), side[a] / MANY) for a, r in half.items()}))
        tiles = tiles.join(better.select("_tx", "_ty", F.col("pairs").alias("_p")), ["_tx", "_ty"], "left").withColumn("pairs", F.coalesce("_p", "pairs"))
    tiles = materialize(tiles.select("_tx", "_ty", "pairs", F.ceil(F.greatest(F.col("c") / most, F.least(F.col("pairs") / most_pairs, "c"))).cast("int").alias("_k")))
    tasks = tiles.agg(F.ceil(F.sum("pairs") / TASK_PAIRS), F.sum("_k")).first()
    tiled = good
    for a, r in half.items():
        near = F.sequence(F.floor((F.col(a) - abs(r)) / side[a]).cast("long"), F.floor((F.col(a) + abs(r)) / side[a]).cast("long"))
        tiled = tiled.select("*", F.explode(near).alias(f"_t{a}"))
    tiled, keys, heavy = tiled.withColumn("probe", (F.col("_tx") == at["x"]) & (F.col("_ty") == at["y"])), ["_tx", "_ty"], tiles.filter("_k > 1").select("_tx", "_ty", "_k")
    many, part = min(t or 0 for t in tasks), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i")
    spread = many > good.sparkSession.sparkContext.defaultParallelism  # few bytes can be many pairs, so partitions are not to be joined by their bytes
    numbered_parts = spread and tasks[1] <= MOST_PARTS
    if numbered_parts:  # each to a partition by its number, so no two large tiles share a task, or its file's dictionary, while another has none
        parts = tiles.select("_tx", "_ty", "_k", (F.col("pairs") / F.col("_k")).alias("_p"), part)
        parts = parts.withColumn("_part", F.pmod(F.row_number().over(Window.orderBy(F.desc("_p"), "_tx", "_ty", "_i")), F.lit(many)).cast("int")).drop("_p")
        tiled, keys = tiled.join(small(materialize(parts), MOST_PARTS), keys), [*keys, "_i", "_part"]
    elif not heavy.isEmpty():
        tiled, keys = tiled.join(small(heavy, 100_000), keys, "left").withColumn("_k", F.coalesce("_k", F.lit(1))).select("*", part), [*keys, "_i"]
    if "_i" in keys:
        tiled = tiled.withColumn("probe", F.col("probe") & (F.pmod(F.xxhash64("id"), F.col("_k")) == F.col("_i")))
    if spread:
        tiled = tiled.repartitionById(many, "_part") if numbered_parts else tiled.repartition(many, *keys)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if numbered:
            table = table.take(pc.sort_indices(table["id"]))
        table = table.combine_chunks()
        columns = {c: table[c].combine_chunks() for c in table.column_names}
        x, y, probe = (table[c].to_numpy() for c in ("x", "y", "probe"))
        m, probes = len(x), np.flatnonzero(probe)
        if not len(probes):
            return
        code = columns["id"].dictionary_encode().indices.to_numpy()
        values = {"x": x, "y": y} | {c: table[f"v_{c}"].to_numpy() for c in read} | ({"id": table["id"].to_numpy()} if test and "id" in test.columns else {})
        # points by strips a fourth of a box high, then by x: in each strip a box is a run
        order, low, high = np.argsort(x, kind="stable"), y.min(), max(abs(ry) / 2, (y.max() - y.min()) / 2**20) or 1.0
        strip = lambda v: np.floor((v - low) / high).astype(np.int64)
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        place = strip(y) * (m + 1) + rank
        by_place = np.argsort(place)
        place, xs, ys, by_place = place[by_place], x[order], y[by_place], by_place.astype(np.int32)
        codes = [] if test is None else [values[c] if c in values and values[c].dtype.kind in "iuf" else columns[c if c == "id" else f"v_{c}"].dictionary_encode().indices.to_numpy() for c in test.order]
        density = m / max((x.max() - x.min()) * (y.max() - y.min()), 1e-300)
        probes = probes[_as_alike(x[probes], y[probes], abs(rx), abs(ry), density, codes[-1][probes] if codes else None)]
        lo, hi = np.searchsorted(xs, x[probes] - rx, "right"), np.searchsorted(xs, x[probes] + rx, "left")
        under, over = strip(y[probes] - ry), strip(y[probes] + ry)
        rows = under[:, None] + np.arange(max(0, int((over - under).max())) + 1)
        first = np.searchsorted(place, rows * (m + 1) + lo[:, None])
        size = np.maximum(np.searchsorted(place, rows * (m + 1) + np.maximum(lo, hi)[:, None]) - first, 0) * (rows <= over[:, None])
        first, upto = first.astype(np.int32), np.cumsum(size.sum(axis=1))
        probes, size = probes.astype(np.int32), size.astype(np.int32)
        listed = None  # the places of points in the order in which a probe's others come, if not by strip and x
        if numbered:
            listed = np.arange(m)  # ids ascend
        elif codes:
            listed = np.lexsort((x, strip(y), *reversed(codes)))
        if listed is not None:
            rank[listed] = np.arange(m)
        done = 0
        while done < len(probes):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + at_once, "right")))
            runs, starts = size[done:stop].ravel(), first[done:stop].ravel()
            spot = np.repeat(starts - (np.cumsum(runs, dtype=np.int32) - runs), runs) + np.arange(runs.sum(), dtype=np.int32)
            own = np.repeat(np.arange(done, stop, dtype=np.int32), size[done:stop].sum(axis=1))
            t_y, y_here = ys[spot], y[probes]
            keep = np.flatnonzero((t_y > (y_here - ry)[own]) & (t_y < (y_here + ry)[own]))
            own, there = own[keep], by_place[spot[keep]]
            here = probes[own]
            keep = code[there] != code[here]
            if test is not None:
                with np.errstate(all="ignore"):
                    keep &= test.holds({c: v[here] for c, v in values.items()}, {c: v[there] for c, v in values.items()})
            own, there = own[keep] - done, there[keep]
            if listed is not None:
                there = listed[np.sort(own.astype(np.int64) * m + rank[there]) % m]
            here, many, start = probes[done:stop], np.bincount(own, minlength=stop - done), np.zeros(stop - done, np.int64)
            if numbered:  # first eights, then what is left: numbers are then stored by whole bytes, and a page repeats itself
                left = many % 8
                last = np.arange(len(there)) - (np.cumsum(many) - many)[own] >= (many - left)[own]
                here, there = np.concatenate((here, here)), np.concatenate((there[~last], there[last]))
                many, start = np.concatenate((many - left, left)), np.concatenate((start, many - left))
            here, there, ends = pa.array(here), pa.array(there), pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
            others = pa.StructArray.from_arrays([pc.take(columns[c], there, boundscheck=False) for c in of_other], list(of_other)) if more else pc.take(columns["id"], there, boundscheck=False)
            own = [pc.take(columns[c], here, boundscheck=False) for c in of_own]
            yield pa.RecordBatch.from_arrays([*own, *([pa.array(start.astype(np.int32))] if numbered else []), pa.ListArray.from_arrays(ends, others)], [*of_own, *first_number, "t"])
            done = stop

    # a row for each probe: rows of single pairs cost the JVM ten times as much as the pairs do
    kind = {f.name: f.dataType for f in good.schema}
    named = {c: "id" if base == "id" else f"v_{base}" for c, (base, _) in of_column.items()}
    of_own = tuple(dict.fromkeys(["id", *(named[c] for c, (_, other) in of_column.items() if not other)]))
    of_other = tuple(dict.fromkeys(["id", *(named[c] for c, (_, other) in of_column.items() if other)]))
    more, first_number = len(of_other) > 1, ["_first"] if numbered else []
    item = T.StructType([T.StructField(c, kind[c]) for c in of_other]) if more else kind["id"]
    got = tiled.groupBy(*keys).applyInArrow(pairs, T.StructType([*[T.StructField(c, kind[c]) for c in of_own], *[T.StructField(c, T.IntegerType()) for c in first_number], T.StructField("t", T.ArrayType(item))]))
    got = got.select(*of_own, *first_number, F.posexplode("t").alias("number", "t") if numbered else F.explode("t").alias("t"))
    if numbered:
        got = got.withColumn("number", F.col("number") + F.col("_first"))
    value = lambda c, other: (F.col(f"t.{c}") if more else F.col("t")) if other else F.col(c)
    return got.select("id", value("id", True).alias("t_id"), *[value(named[c], other).alias(c) for c, (_, other) in of_column.items()], *(["number"] if numbered else []))


def numbered_pairs(points: DataFrame, rx: float, ry: float | None = None, most: int = MOST, at_once: int = PAIRS) -> DataFrame:
    """(id, t_id, number): ``box_pairs`` numbered from 0 by t_id; ids are one point's each."""
    return box_pairs(points, rx, ry, numbered=True, most=most, at_once=at_once)
