"""A tree of leaf summaries that is kept up under inserts, deletes and moves: only what a batch touches is written anew.

The tree is two tables, its points and its nodes, both stored by part: a part is a cell of a level near the root. A batch rewrites the parts that hold a point it touches, from their own points; of the nodes,
those of the touched leaves are made from their points, and those on the paths to the root from these leaves and from the stored nodes beside the paths. A leaf's lowest point is found again among the points that are left, so a deleted minimum leaves the next one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import order_key
from ..lineage import materialize, small
from .index import with_keys
from .windows import header

SUMMARY = ("n", "low")
#: changes of a batch, at most, whose ids are broadcast
MOST_IDS = 1_000_000


class Parts:
    """A table stored by ``part``, as several written tables of which each holds some of the parts."""

    def __init__(self, segments: list[tuple[DataFrame, list[int]]]):
        self.segments = segments

    @classmethod
    def of(cls, rows: DataFrame, beside: DataFrame | None = None) -> Parts:
        """A new table of ``rows``, and of those ``beside`` them, which were read from stored parts and are written by the tasks that read them."""
        # a part goes to few tasks, a crowded one is split
        rows = rows.hint("rebalance", "part")
        written = materialize(rows if beside is None else beside.unionByName(rows), "part")
        return cls([(written, sorted(r.part for r in written.select("part").distinct().collect()))])

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows, or those of some parts; other files are not opened."""
        live = [(df, own if parts is None else [p for p in own if p in set(parts)]) for df, own in self.segments]
        frames = [df.filter(F.col("part").isin(own)) for df, own in live if own]
        return reduce(DataFrame.unionByName, frames) if frames else self.segments[0][0].limit(0)

    def replaced(self, fresh: Parts, parts: list[int]) -> Parts:
        """The table with ``parts`` made of those in ``fresh``."""
        gone = set(parts)
        kept = [(df, [p for p in own if p not in gone]) for df, own in self.segments]
        return Parts([s for s in kept if s[1]] + [s for s in fresh.segments if s[1]] or fresh.segments)


@dataclass(frozen=True)
class Tree:
    """``head``: the box that fixes the root (points beyond it go to the cells at its edge); ``depth``: the leaves' level; ``top``: the parts' level."""

    points: Parts
    nodes: Parts
    head: DataFrame
    depth: int
    top: int
    axes: str

    def summaries(self) -> DataFrame:
        """level, key, n and the lowest point (z, id) of every node with points."""
        return self.nodes.read().select("level", "key", "n", F.col("low.v").alias("z"), F.col("low.id").alias("id"))

    def _part(self, level: Column, key: Column) -> Column:
        """The part of a node or a leaf's point."""
        return F.call_function("shiftright", key, (len(self.axes) * (level - self.top)).cast("int")).cast("int")

    def _node_part(self) -> Column:
        """The parts' own nodes and those above are one part more, -1: a node there has children in many parts."""
        return F.when(F.col("level") <= self.top, -1).otherwise(self._part(F.col("level"), F.col("key")))

    def _placed(self, rows: DataFrame) -> DataFrame:
        keyed = with_keys(rows.select("id", *"xyz"), self.depth, self.head, self.axes)
        return keyed.select("id", *"xyz", "key", self._part(F.lit(self.depth), F.col("key")).alias("part"))

    def changed(self, changes: DataFrame) -> Tree:
        """The tree after a batch of ``changes`` (id, op, x, y, z): "insert" puts a point at a place, in place of one with its id; "move" does so if there is one; "delete" removes it if there is one.

        An id stands in a batch once. Changes without an id are left out.
        """
        changes = materialize(changes.filter("id IS NOT NULL").select("id", "op", *"xyz"))
        if not changes.filter("op IS NULL OR op NOT IN ('insert', 'move', 'delete')").isEmpty() or not changes.groupBy("id").count().filter("count > 1").isEmpty():
            raise ValueError("a change is an insert, a move or a delete, one for each id")
        own, row = changes.select("id"), ["id", *"xyz", "key", "part"]
        ids = small(own, MOST_IDS)
        few, told = ids is not own, None
        if few:
            before = materialize(self.points.read().select("id", "key", "part").join(ids, "id", "left_semi"))
        else:  # one shuffle of the points finds those that change, and leaves the others by part
            told = self.points.read().select(*row).join(own.withColumn("hit", F.lit(1)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
            told = materialize(told, "hit", "part")
            before = told.filter("hit = 1").select("id", "key", "part")
        put = changes.filter("op = 'insert'").unionByName(changes.filter("op = 'move'").join(before.select("id"), "id", "left_semi"))
        after = materialize(self._placed(put))
        touched = materialize(before.select("key", "part").union(after.select("key", "part")).distinct())
        parts = sorted(r.part for r in touched.select("part").distinct().collect())  # cells of one level near the root
        if not parts:
            return self
        if few:
            fresh = Parts.of(after, self.points.read(parts).select(*row).join(ids, "id", "left_anti"))
        else:
            fresh = Parts([(told.filter("hit = 0").select(*row), parts), *Parts.of(after).segments])
        points = self.points.replaced(fresh, parts)
        return Tree(points, self._renewed(points, touched, parts), self.head, self.depth, self.top, self.axes)

    def _renewed(self, points: Parts, touched: DataFrame, parts: list[int]) -> Parts:
        """The nodes with the summaries of the touched leaves and of all above them.

        A node on a touched path is made of the touched leaves below it and of the stored nodes that hang on the paths below it: those with a parent on a path that are on none themselves.
        """
        wide, node = len(self.axes), ["level", "key"]
        stored = self.nodes.read([-1, *parts]).select(*node, *SUMMARY)
        path = touched.select("key", F.explode(F.sequence(F.lit(0), F.lit(self.depth))).alias("level"))
        path = materialize(path.select("level", F.expr(f"shiftright(key, {wide} * ({self.depth} - level))").alias("key")).distinct())
        leaves = points.read(parts).join(touched.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.min(order_key("z", "id")).alias("low"))
        off = stored.join(path, node, "left_anti")
        parents = path.select((F.col("level") + 1).alias("level"), F.col("key").alias("parent"))
        hung = off.withColumn("parent", F.shiftright("key", wide)).join(parents, ["level", "parent"], "left_semi")
        # a leaf counts for itself and all above it, what hangs on a path for those above it
        each = leaves.select(F.lit(self.depth).alias("level"), "key", *SUMMARY, F.lit(self.depth).alias("last")).unionByName(hung.select(*node, *SUMMARY, (F.col("level") - 1).alias("last")))
        each = each.select("level", "key", *SUMMARY, F.explode(F.sequence(F.lit(0), "last")).alias("above"))
        each = each.select(F.expr(f"shiftright(key, {wide} * (level - above))").alias("key"), F.col("above").alias("level"), *SUMMARY)
        fresh = each.groupBy(*node).agg(F.sum("n").alias("n"), F.min("low").alias("low"))
        return self.nodes.replaced(Parts.of(off.unionByName(fresh).withColumn("part", self._node_part())), [-1, *parts])


def build(points: DataFrame, depth: int, top: int = 2, axes: str = "xy", head: DataFrame | None = None) -> Tree:
    """The tree of a cloud, or an empty tree over the box of a given ``head``."""
    head = materialize(header(points, axes) if head is None else head)
    empty = Tree(Parts([]), Parts([]), head, depth, min(top, depth), axes)
    stored = Parts.of(empty._placed(points))
    leaves = stored.read().groupBy("key").agg(F.count("*").alias("n"), F.min(order_key("z", "id")).alias("low"))
    each = leaves.select("n", "low", "key", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    each = each.withColumn("key", F.expr(f"shiftright(key, {len(axes)} * ({depth} - level))"))
    nodes = each.groupBy("level", "key").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    return Tree(stored, Parts.of(nodes.withColumn("part", empty._node_part())), head, depth, empty.top, axes)
