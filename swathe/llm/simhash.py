"""SimHash near-duplicates by a distributed self-join of binary tries.

Fingerprints come from whole texts. Of two that differ in ``budget`` bits at most, one of budget + 1 blocks of their bits is equal: the distinct ones are
dealt by the value of each block, so each pair within the budget meets in a group, and no group holds more than its share. A group that is still large is
dealt again, by blocks of the bits that are left. In a group a binary trie is walked against itself: node pairs are expanded bit by bit, the
differing bits add up and a pair is dropped as soon as they exceed the budget. The tries of many groups are walked at once.
A task returns a spanning forest of its links and never the links themselves, so a group of n copies costs n rows.
Forests are merged by alternating large-star and small-star steps on written tables.

Defined cases: a null or empty text, or one of white space only, has fingerprint 0; such documents link to each other
and to any fingerprint within the budget. Repeated rows each give a row. A null ``doc_id`` is kept, never chosen as the smallest
(``component_id`` is null if a component has no other id). Empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hex16, materialize, small, small_batches, table, union_all

#: a group of more is dealt again; a batch of groups is walked at once from so many fingerprints on
MOST, BATCH = 100_000, 100_000
MASK = (1 << 64) - 1


def fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    """The signed 64-bit SimHash of each text over shingles of ``width`` words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= width:
            out[k] = digest(line, 42)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -width])).tolist()
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):  # bounded: 64 bytes for each shingle of a slice
            ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4) -> Column:
    """A column of fingerprints of ``docs[text]``."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(fingerprints([x if isinstance(x, str) else None for x in s], width), dtype="int64")

    return fp(docs[text])


class _Trie:
    """The nodes of binary tries over sorted distinct fingerprints, as arrays by level; a trie for each run of equal ``groups``."""

    def __init__(self, values: np.ndarray, groups: np.ndarray | None = None) -> None:
        self.values = values
        self.apart = np.zeros(max(0, len(values) - 1), bool) if groups is None else groups[1:] != groups[:-1]
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First positions of the nodes (and the end), and each one's two children at the next level or -1."""
        if depth not in self.levels:
            starts, below = self._starts(depth), self._starts(depth + 1)
            first = np.searchsorted(below[:-1], starts[:-1])
            n = np.diff(np.append(first, len(below) - 1))
            bit = ((self.values[starts[:-1]] >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64) if depth < 64 else np.zeros(len(first), np.int64)
            child = np.full((len(first), 2), -1, np.int32)
            child[np.arange(len(first)), bit] = first
            child[n == 2, 1] = first[n == 2] + 1
            self.levels[depth] = starts, child
        return self.levels[depth]

    def _starts(self, depth: int) -> np.ndarray:
        if depth == 0:
            return np.concatenate(([0], np.flatnonzero(self.apart) + 1, [len(self.values)])).astype(np.int32)
        p = self.values >> np.uint64(64 - min(depth, 64))
        return np.concatenate(([0], np.flatnonzero((p[1:] != p[:-1]) | self.apart) + 1, [len(p)])).astype(np.int32)


def trie_join(a: np.ndarray, b: np.ndarray | None, budget: int, chunk: int = 1 << 16, leaf: int = 24, groups: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs ``a[i]``, ``b[j]`` that differ in ``budget`` bits at most, in batches.

    ``a`` and ``b`` are sorted distinct uint64 arrays; ``b=None`` joins ``a`` with itself (i < j), with ``groups`` only inside its runs of equal
    groups, in each of which it is sorted and distinct. A node pair is expanded until it stands for ``leaf`` value pairs at most; these are compared.
    """
    own = b is None
    ta = _Trie(a, groups)
    tb = ta if own else _Trie(b)
    if not len(a) or not len(tb.values):
        return
    roots = np.arange(len(ta.level(0)[0]) - 1, dtype=np.int32)
    stack = [(0, roots[i : i + chunk], roots[i : i + chunk], np.zeros(len(roots[i : i + chunk]), np.int8)) for i in range(0, len(roots), chunk)]
    while stack:
        depth, x, y, used = stack.pop()
        sa, ca = ta.level(depth)
        sb, cb = tb.level(depth)
        na, nb = sa[x + 1] - sa[x], sb[y + 1] - sb[y]
        done = na.astype(np.int64) * nb <= leaf
        if done.any():
            at, left, right, wide = sa[x[done]], sb[y[done]], na[done], nb[done]
            sizes = right.astype(np.int64) * wide
            ends = np.cumsum(sizes)
            for lo, hi in _slices(ends, 1 << 17):
                n = sizes[lo:hi]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = np.repeat(wide[lo:hi], n)
                i = np.repeat(at[lo:hi], n) + k // w
                j = np.repeat(left[lo:hi], n) + k % w
                near = np.bitwise_count(a[i] ^ tb.values[j]) <= budget
                if own:
                    near &= i < j
                if near.any():
                    yield i[near], j[near]
        go = ~done
        if not go.any():
            continue
        x, y, used = x[go], y[go], used[go]
        same = x == y if own else None
        nx, ny, nu = [], [], []
        for bx in (0, 1):
            for by in (0, 1):
                p, q = ca[x, bx], cb[y, by]
                u = used + np.int8(bx != by)
                ok = (p >= 0) & (q >= 0) & (u <= budget)
                if own and bx > by:
                    ok &= ~same
                nx.append(p[ok])
                ny.append(q[ok])
                nu.append(u[ok])
        x, y, used = np.concatenate(nx), np.concatenate(ny), np.concatenate(nu)
        for i in range(0, len(x), chunk):
            stack.append((depth + 1, x[i : i + chunk], y[i : i + chunk], used[i : i + chunk]))


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield lo, hi
        lo = hi


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j in ``label``, where each entry points to its set's smallest member."""
    while True:
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest(fp: np.ndarray, groups: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): a spanning forest of the links inside the groups, each set's members with its smallest one; by ``groups``, then fingerprint."""
    order = np.lexsort((fp, groups))
    a, groups = fp[order], groups[order]
    label = np.arange(len(a))
    for i, j in trie_join(a, None, budget, leaf=256, groups=groups):
        _merge(label, i, j)
    out = np.flatnonzero(label != np.arange(len(a)))
    return a[out].view(np.int64), a[label[out]].view(np.int64)


def blocks(mask: int, parts: int) -> list[int]:
    """The bits of ``mask`` in ``parts`` blocks of neighbouring bits, as even as may be; none is empty unless there are too few bits."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _dealt(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` (fp, mask, grp) in budget + 1 groups each: by the value of each block of the bits in ``mask``; ``mask`` keeps the bits that are left."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = [r[0] for r in rows.select("mask").distinct().collect()]  # a few: one for each way to this depth
    to = F.lit(None).cast("array<struct<mask:bigint,grp:bigint>>")
    for m in masks:
        cells = [F.struct(F.lit(signed((m & MASK) & ~block)).alias("mask"), F.xxhash64("grp", F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(block)))).alias("grp")) for k, block in enumerate(blocks(m & MASK, budget + 1))]
        to = F.when(F.col("mask") == m, F.array(*cells)).otherwise(to)
    return rows.select("fp", F.explode(to).alias("to")).select("fp", "to.mask", "to.grp")


def links(uniq: DataFrame, budget: int, most: int = MOST, rounds: int = 4) -> DataFrame:
    """A spanning forest (u, v) in each group of the links between distinct fingerprints in ``uniq.fp``, v < u as unsigned numbers.

    A group of more than ``most`` is dealt again, ``rounds`` times at most: then its fingerprints share most of their bits, so there are few of them.
    """
    left, done = uniq.select("fp", F.lit(-1).cast("long").alias("mask"), F.lit(0).cast("long").alias("grp")), []
    for turn in range(rounds):
        dealt = _dealt(left, budget)
        if turn == rounds - 1:
            done.append(dealt.select("fp", "grp"))
            break
        large = small(materialize(dealt.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("grp")), 300_000)
        if large.isEmpty():
            done.append(dealt.select("fp", "grp"))
            break
        done.append(dealt.join(large, "grp", "left_anti").select("fp", "grp"))
        left = materialize(dealt.join(large, "grp", "left_semi"))
    rows = union_all(done)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def forest(fp: np.ndarray, grp: np.ndarray) -> pa.RecordBatch:
            u, v = _forest(fp.view(np.uint64), grp, budget)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= BATCH:
                fp, grp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(grp, grp[-1]))  # the last group may go on
                if cut:
                    yield forest(fp[:cut], grp[:cut])
                held, n = [(fp[cut:], grp[cut:])], len(fp) - cut
        if n:
            yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(walk, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) reaches; by large-star and small-star steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        j = both.join(near, both.u == near.k)
        if large:
            j = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            j = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select(F.col("k").alias("u"), F.col("m").alias("v")))
        return j.filter(F.col("u") > F.col("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = mark(e)
    for _ in range(rounds):
        if not before[0]:
            break
        half = materialize(star(e, True))
        last, e = e, materialize(star(half, False))
        discard(last, half)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, keep: list[Column] | None = None) -> DataFrame:
    """Per row of ``docs``: its id, ``fp`` (long), ``component`` (the smallest id reachable), ``root`` (a fingerprint that names the component) and the ``keep`` columns."""
    small_batches(docs.sparkSession)
    sig = materialize(docs.select(F.col(id_col).alias("id"), with_fingerprint(docs, text_col, width).alias("fp"), *(keep or [])))
    uniq = materialize(sig.groupBy("fp").agg(F.min("id").alias("least")))
    comp = components(links(uniq, budget))
    rooted = uniq.join(comp, uniq.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    roots = materialize(rooted.join(by_root, "root").select("fp", "component", "root"))
    return sig.join(small(roots, 100_000), "fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
