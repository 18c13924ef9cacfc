"""Hard-negative mining by a dual-tree search over anchors and candidates.

Candidates are dealt by ranges of (label, cell), a cell being the nearest of some rows of a bounded sample, so what a task holds lies close together. Anchors come in blocks
of bounded size. A task builds a tree over each shard of its candidates, and walks it together with the tree over the block's anchors: both split by label first, then by the widest
dimension at its median. The balls around a pair of nodes give an interval that holds all their inner products; the pair is left, and with it the whole group of anchors, when the
interval lies outside what any anchor of the group can still use. Pairs of leaves that are left are scored exactly, highest bounds first, while they can still beat the group's k-th best.

Two searches follow each other: the best rows of the anchor's own label (positives), then, in the band of scores that each positive allows, the best rows of other labels. Each begins with a
sixteenth of the candidates, whose k-th best is a lower limit for all others. Every task gives its k best for each anchor and band, which are merged exactly.

Inner products are whole numbers: components are multiplied by 256 and rounded down.

Defined cases: rows with a null id, a null label, a vector that is null, empty or holds a null, NaN or infinite component take no part, nor do those of
another length than most have. Products of a component with the factor count as 2**24 beyond it, so scores fit a long up to 30,000 dimensions. Rows that repeat in id, label and vector are
one row; rows of one id that differ in label or vector are different ones, each an anchor of its own if its id is one, but none is a positive or negative of an anchor of the same id. Ties in score go to the
smaller id. An anchor without another row of its label, and a positive without a row in its band, give no rows; so does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, table, union_all
from .vectors import finite, matrix, of_one_length, product, whole

FACTOR, MOST = 256.0, 1 << 24
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: rows of a shard, of its leaves, of the anchors' leaves, and scored at once; cells; one of so many candidates goes first
SHARD, LEAF, GROUP, AT_ONCE, CELLS, FIRST = 16_384, 128, 32, 2048, 64, 16
#: anchors of a block, and bytes of their vectors, at most
BLOCK, BLOCK_BYTES = 8192, 64 << 20
NONE, ALL = -(1 << 62), 1 << 62
FOUND = "anchor int, anchor_id long, band int, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Tree:
    """Nodes over rows of whole numbers: ranges of ``order``, the ball around each, its lowest and highest label, and children (-1: a leaf)."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        order, wide = np.arange(len(x)), x.astype(np.float64)
        start, end, left, right, centres, radii, low, high = [], [], [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            rows = order[a:b]
            c = wide[rows].mean(axis=0)
            start.append(a)
            end.append(b)
            left.append(-1)
            right.append(-1)
            centres.append(c)
            radii.append(float(np.sqrt(((wide[rows] - c) ** 2).sum(axis=1).max())))
            low.append(int(labels[rows].min()))
            high.append(int(labels[rows].max()))
            return len(start) - 1

        todo = [node(0, len(x))]
        while todo:
            k = todo.pop()
            a, b = start[k], end[k]
            if b - a <= leaf:
                continue
            rows = order[a:b]
            if low[k] != high[k]:
                rows = rows[np.argsort(labels[rows], kind="stable")]
                turns = np.flatnonzero(np.diff(labels[rows])) + 1
                cut = int(turns[np.abs(turns - (b - a) // 2).argmin()])
            else:
                own = wide[rows]
                rows = rows[np.argsort(own[:, own.var(axis=0).argmax()], kind="stable")]
                cut = (b - a) // 2
            order[a:b] = rows
            left[k], right[k] = node(a, a + cut), node(a + cut, b)
            todo += [left[k], right[k]]
        self.order, self.start, self.end = order, np.array(start), np.array(end)
        self.left, self.right = np.array(left), np.array(right)
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least of ``values`` (one for each row) in each node."""
        own = values[self.order]
        return np.array([own[a:b].min() for a, b in zip(self.start, self.end, strict=True)])


def _pairs(anchors: Tree, shard: Tree, floor: np.ndarray, ceiling: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs (anchor node, shard node, upper bound) that can hold a score from ``floor`` to ``ceiling`` (for each anchor node), walked down together."""
    dot = anchors.centre @ shard.centre.T
    a, b, out = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        ra, rb = anchors.radius[a], shard.radius[b]
        slack = ra * shard.norm[b] + rb * anchors.norm[a] + ra * rb
        slack = slack + 1e-9 * (slack + anchors.norm[a] * shard.norm[b]) + 1e-6
        high, low = dot[a, b] + slack, dot[a, b] - slack
        apart = (anchors.high[a] < shard.low[b]) | (anchors.low[a] > shard.high[b])
        alike = (anchors.low[a] == anchors.high[a]) & (shard.low[b] == shard.high[b]) & (anchors.low[a] == shard.low[b])
        keep = (high >= floor[a]) & (low <= ceiling[a]) & ~(apart if same else alike)
        a, b, high = a[keep], b[keep], high[keep]
        leaf_a, leaf_b = anchors.left[a] < 0, shard.left[b] < 0
        done = leaf_a & leaf_b
        out.append((a[done], b[done], high[done]))
        a, b, leaf_a, leaf_b = a[~done], b[~done], leaf_a[~done], leaf_b[~done]
        # the larger ball is opened
        open_a = ~leaf_a & (leaf_b | (anchors.radius[a] >= shard.radius[b]))
        a, b = (
            np.concatenate([anchors.left[a[open_a]], anchors.right[a[open_a]], a[~open_a], a[~open_a]]),
            np.concatenate([b[open_a], b[open_a], shard.left[b[~open_a]], shard.right[b[~open_a]]]),
        )
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (a, b, np.zeros(0))


def _merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first along the last axis by falling score, then id."""
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


class Anchors:
    """A block of anchors: ids, labels, vectors, and for each band (n x bands) the lowest and the highest score of interest."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, floor: np.ndarray, ceiling: np.ndarray):
        self.ids, self.labels, self.x, self.floor, self.ceiling = ids, labels, x, floor, ceiling

    def plain(self) -> tuple[np.ndarray, ...]:
        return self.ids, self.labels, self.x, self.floor, self.ceiling

    def search(self, tree: Tree, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(anchor, band, score, id) of the k best of a shard for each anchor and band."""
        n, bands = self.floor.shape
        best, who = np.full((n, bands, k), NONE), np.zeros((n, bands, k), np.int64)
        shard = Tree(x, labels, LEAF)
        wanted = np.where(self.ceiling >= self.floor, self.floor, ALL).min(axis=1)
        a, b, high = _pairs(tree, shard, tree.least(wanted), -tree.least(-np.where(self.ceiling >= self.floor, self.ceiling, NONE).max(axis=1)), same)
        order = np.lexsort((-high, a))
        a, b, high = a[order], b[order], high[order]
        ends = np.flatnonzero(np.diff(a)) + 1
        step = max(1, AT_ONCE // LEAF)
        for first, last in zip([0, *ends], [*ends, len(a)], strict=True) if len(a) else []:
            group = tree.order[tree.start[a[first]] : tree.end[a[first]]]
            own, floor, ceiling = self.x[group], self.floor[group].copy(), self.ceiling[group]
            for at in range(first, last, step):
                # what the group still needs; closed bands need nothing
                if high[at] < np.where(ceiling >= floor, floor, ALL).min():
                    break
                rows = np.concatenate([shard.order[shard.start[c] : shard.end[c]] for c in b[at : min(at + step, last)]])
                rows = rows[np.argsort(ids[rows], kind="stable")]  # the first of equal scores is the smaller id
                score = product(own, x[rows].T)
                fits = (self.labels[group][:, None] == labels[rows]) == same
                score[~(fits & (self.ids[group][:, None] != ids[rows]))] = NONE
                here, line = np.full((len(group), bands, k), NONE), np.arange(len(group))
                chosen = np.zeros((len(group), bands, k), np.int64)
                for p in range(bands):
                    of = np.where((score >= floor[:, p, None]) & (score <= ceiling[:, p, None]), score, NONE)
                    for r in range(min(k, len(rows))):
                        j = of.argmax(axis=1)
                        here[:, p, r], chosen[:, p, r] = of[line, j], ids[rows[j]]
                        if (here[:, p, r] == NONE).all():
                            break
                        of[line, j] = NONE
                best[group], who[group] = _merged(np.concatenate([best[group], here], -1), np.concatenate([who[group], chosen], -1), k)
                floor = np.maximum(floor, best[group][:, :, -1])
        got = np.nonzero(best > NONE)
        return got[0], got[1], best[got], who[got]


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> tuple[DataFrame, int]:
    """id, label, x (whole numbers) of the distinct rows that take part, and the number of dimensions."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    rows, d = of_one_length(rows, "v")
    return rows.select("id", "label", whole(F.col("v"), FACTOR, 0, MOST).alias("x")).distinct(), d


def dealt(rows: DataFrame, d: int, cells: int = CELLS) -> DataFrame:
    """``rows`` in ranges of (label, cell, id), written; a cell is the nearest of at most ``cells`` rows, which only bring near rows together."""
    rows = materialize(rows)
    near = rows.select("x").orderBy(F.xxhash64("id", "x"), "id").limit(cells).toArrow()
    pivots = matrix(near["x"].combine_chunks(), d).astype(np.float64) if near.num_rows else np.zeros((1, d))
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (matrix(batch["x"], d) @ pivots.T - half).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    keyed = rows.mapInArrow(run, "id long, label long, x array<long>, cell int")
    return materialize(keyed.repartitionByRange("label", "cell", "id").sortWithinPartitions("label", "cell", "id"))


def _search(rows: DataFrame, d: int, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """The k best rows of each anchor and band in each shard of ``rows``, written."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Anchors(*sent.value)
        tree = Tree(block.x, block.labels, GROUP)
        held: list[pa.RecordBatch] = []

        def searched() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = matrix(t["x"].combine_chunks(), d)
            anchor, band, score, who = block.search(tree, t["id"].to_numpy(), t["label"].to_numpy(), x, k, same)
            columns = [pa.array(anchor.astype(np.int32)), pa.array(block.ids[anchor]), pa.array(band.astype(np.int32)), pa.array(score), pa.array(who)]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "anchor_id", "band", "score", "id"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD:
                yield searched()
                held = []
        if held:
            yield searched()

    found = materialize(rows.select("id", "label", "x").mapInArrow(run, FOUND))
    sent.unpersist()
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _exact(rows: DataFrame, first: DataFrame, d: int, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """The k best of all rows, with their rank: ``first``, a part of the rows, gives lower limits for the search of all."""
    some = _search(first, d, anchors, k, same)
    at = _best(some, k).filter(F.col("rank") == k).select("anchor", "band", "score").toArrow()  # a row for each anchor and band at most
    anchors.floor[at["anchor"].to_numpy(), at["band"].to_numpy()] = at["score"].to_numpy()
    got = materialize(_best(_search(rows, d, anchors, k, same), k))
    discard(some)
    return got


def mine(vectors: DataFrame, id_col: str, label: Column, vector_col: str, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (``is_anchor`` of ``id``) and each of its positives the first
    negatives whose score is from ``low`` to ``high`` percent of the positive's."""
    spark = vectors.sparkSession
    small_batches(spark, 4096, 16 << 20)
    rows, d = usable(vectors, id_col, label, vector_col)
    if not d:
        return spark.createDataFrame([], RESULT)
    rows = dealt(rows, d)
    first = materialize(rows.filter(F.pmod(F.xxhash64("id"), F.lit(FIRST)) == 0))
    anchors = rows.filter(is_anchor).select("id", "label", "x")
    blocks = -(-anchors.count() // min(block, max(1, BLOCK_BYTES // (8 * max(d, 1)))))
    anchors = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(max(1, blocks))).cast("int")))
    out = []
    for number in range(blocks):
        own = anchors.filter(F.col("block") == number).orderBy("id").toArrow()  # a block: bounded rows and bytes
        if not own.num_rows:
            continue
        ids, labels, x = own["id"].to_numpy(), own["label"].to_numpy(), matrix(own["x"].combine_chunks(), d)
        open_to = lambda v: np.full((len(ids), 1), v)
        near = _exact(rows, first, d, Anchors(ids, labels, x, open_to(NONE + 1), open_to(ALL)), positives, True)
        at = near.select("anchor", "rank", "score").toArrow()
        floor, ceiling = np.full((len(ids), positives), ALL), np.full((len(ids), positives), NONE)
        here = (at["anchor"].to_numpy(), at["rank"].to_numpy() - 1)
        floor[here], ceiling[here] = -(-low * at["score"].to_numpy() // 100), high * at["score"].to_numpy() // 100
        far = _exact(rows, first, d, Anchors(ids, labels, x, floor, ceiling), negatives, False)
        chosen = near.select("anchor", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out.append(far.join(chosen, ["anchor", "band"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return union_all(out) if out else spark.createDataFrame([], RESULT)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``embeddings``; every 50th id is an anchor, the labels of every 7th are shifted."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", F.col("id") % 50 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {
    "op13_hard_negatives": """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(CAST(256 AS DOUBLE) * CAST(c AS DOUBLE))) AS x
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
a AS (SELECT * FROM e WHERE id % 50 = 0),
s AS (SELECT a.id AS anchor, e.id, a.label = e.label AS same, CAST(list_inner_product(a.x, e.x) AS BIGINT) AS score FROM a JOIN e ON e.id <> a.id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
g AS (SELECT p.anchor, p.id AS positive, s.id AS negative, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
 FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INT) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM g WHERE rank <= 3"""
}
