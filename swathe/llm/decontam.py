"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m characters that occurs in a document with at most k = floor(rate * m) edits shares at least
m - q + 1 - k*q character q-grams with the region, and all of them lie on k + 1 neighbouring diagonals (place in the
document minus place in the item). Every shared q-gram is counted, in bands of 2(k + 1) diagonals that overlap by half, so one
band holds all of a match; bands that reach the bound are verified by a banded alignment of the whole item. Nothing that has a
match within the edit budget can be missed. Items of 150 characters or more are searched for in the same way by windows of 100 characters too, one
at every 50th, so a document that holds a part of an item has a row too: any 150 characters of an item hold a whole window. With ``least_window`` under
100, windows are half as long as their item, between that and 100 characters, so parts of shorter items are found too.

Characters are code points, lower-cased one for one, with any ASCII white space read as a space; spans are
code points of the original text, end exclusive.

Defined cases: null or empty texts and items have no match; for short items k is the largest budget whose bound is still 1, and items
of fewer than q characters are searched for exactly. Repeated rows each give their rows; a null doc_id is kept. An empty documents or benchmark
table gives no rows. Windows of one item that touch in a document are one row with the span of them all and the fewest edits of one window; those that touch
a match of the whole item are left out. Overlapping matches of one item in one document count as one, with the fewest edits, the leftmost of equals.
Rows of the benchmark with the same item_id are items of their own, each with its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, row_hash, small, small_batches, table, typed_id

Q, RATE = 10, 0.06
WINDOW = 100
BLOCK_CHARS = 1_000_000  # about 300 MB of index in a worker
SEEN_BITS = 26
BASE = 0x9E3779B97F4A7C15
SLICE = 1 << 20  # postings
SHIFT = 1 << 20  # bands are numbered from here, as diagonals may be negative
SCHEMA = "id string, item_id long, start long, stop long, edits int"


def codes(text: str) -> np.ndarray:
    """Code points, lower-cased and with ASCII white space as a space, one for one."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals have lower cases of two characters; these stay
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 9) & (c <= 13), np.uint32(32), c)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of each q-gram."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h, width, base = c.astype(np.uint64) + np.uint64(1), 1, BASE
    out, have, shift = None, 0, 0
    # powers of two of the width are put together, so that any q costs log q steps
    while True:
        if q & width:
            part = h[shift : shift + len(c) - q + 1]
            out = part.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + part
            have += width
            shift += width
        if have == q:
            return out
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2


def align(item: np.ndarray, region: np.ndarray, k: int, first: int, wide: int) -> tuple[int, int, int] | None:
    """Fewest edits <= k between the whole item and a part of region, and that part, on diagonals first .. first + wide - 1.

    A cell (p, d) of the band stands for item[:p] against region up to first + d + p. The start is kept with each
    cell. Of equal edits the leftmost end counts.
    """
    m, n = len(item), len(region)
    big = k + 1
    at = np.arange(wide)
    end = first + at
    cost = np.where((end >= 0) & (end <= n), 0, big).astype(np.int64)
    start = end.copy()
    padded = np.concatenate((region, [0]))
    for p in range(1, m + 1):
        end = first + at + p
        inside = (end >= 0) & (end <= n)
        here = padded[np.clip(end - 1, 0, n)]
        swap = np.where((end >= 1) & (end <= n), cost + (here != item[p - 1]), big)
        gone = np.append(cost[1:] + 1, big)  # the item's character is missing in the region
        best = np.where(gone < swap, gone, swap)
        begin = np.where(gone < swap, np.append(start[1:], 0), start)
        run = np.minimum.accumulate(best - at)  # extra characters in the region
        with_extra = run + at
        source = np.maximum.accumulate(np.where(best - at == run, at, 0))
        cost = np.where(inside, np.minimum(with_extra, big), big)
        start = begin[source]
        if cost.min() > k:
            return None
    e = int(np.argmin(cost))
    return (int(cost[e]), int(start[e]), int(first + e + m)) if cost[e] <= k else None


def _find(item: np.ndarray, region: np.ndarray) -> int:
    """The first place of the item in the region as it is, or -1."""
    flat, want, at = region.tobytes(), item.tobytes(), -1
    while (at := flat.find(want, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


class Items:
    """The q-gram index of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q, self.rows = q, [(i, t, codes(t)) for i, t in rows if t]
        m = np.array([len(c) for _, _, c in self.rows], np.int64)
        # the largest budget within the rate that the lemma can filter: its bound stays at 1 or more
        self.k = np.maximum(0, np.minimum(np.floor(rate * m + 1e-9).astype(np.int64), (m - q) // q))
        self.least = m - q + 1 - self.k * q
        self.exact = [i for i in range(len(m)) if self.least[i] < 1]
        parts = [(grams(c, q), i) for i, (_, _, c) in enumerate(self.rows) if self.least[i] >= 1]
        h = np.concatenate([g for g, _ in parts] or [np.zeros(0, np.uint64)])
        item = np.concatenate([np.full(len(g), i, np.int32) for g, i in parts] or [np.zeros(0, np.int32)])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g, _ in parts] or [np.zeros(0, np.int32)])
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.bits = min(SEEN_BITS, max(16, int(np.ceil(np.log2(max(1, len(self.keys)) * 64)))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, c: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the q-grams of code points ``c`` that an item has too."""
        if not len(self.keys) or len(c) < self.q:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        places, hashes = [], []
        for lo in range(0, max(1, len(c) - self.q + 1), piece):
            g = grams(c[lo : lo + piece + self.q - 1], self.q)
            hit = np.flatnonzero(self.seen[(g >> np.uint64(64 - self.bits)).astype(np.int64)])
            places.append(hit + lo)
            hashes.append(g[hit])
        kept, g = np.concatenate(places), np.concatenate(hashes)
        true = self.keys[np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)] == g
        return kept[true], g[true]

    def regions(self, kept: np.ndarray, g: np.ndarray) -> np.ndarray:
        """(item, band) pairs whose count of the q-grams ``g`` at ``kept`` reaches the item's bound."""
        if not len(self.keys) or len(kept) < self.least[self.least > 0].min(initial=1 << 40):
            return np.zeros((0, 2), np.int64)
        counted = []
        every = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        true = self.keys[every] == g
        kept, every = kept[true], every[true]
        # postings of some places at a time, by their number: many items may share a q-gram
        ends = np.cumsum(self.count[every])
        a = 0
        while a < len(kept):
            s = slice(a, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right"))))
            a = s.stop
            hit, k = kept[s], every[s]
            n = self.count[k]
            x = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.item[x].astype(np.int64)
            wide = self.k[item] + 1
            band = (np.repeat(hit, n) - self.place[x] + wide * SHIFT) // wide
            counted.append(np.unique((item << 40) | band, return_counts=True))
        if not counted:
            return np.zeros((0, 2), np.int64)
        keys, back = np.unique(np.concatenate([u for u, _ in counted]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([n for _, n in counted])).astype(np.int64)
        # band b of half width w counts with band b + 1: together they are one of the overlapping bands
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        both = sums + np.where(follows, np.append(sums[1:], 0), 0)
        keys = keys[both >= self.least[keys >> 40]]
        return np.stack((keys >> 40, keys & ((1 << 40) - 1)), axis=1)

    def search(self, c: np.ndarray, hits: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, stop, edits) of the matches in the code points of a text; ``hits``: its q-grams, if known."""
        out: list[tuple[int, int, int, int]] = []
        for i in self.exact:
            item_id, _, want = self.rows[i]
            if len(want) and len(c) >= len(want):
                flat, found = c.tobytes(), -4
                while (found := flat.find(want.tobytes(), found + 4)) >= 0:
                    if found % 4 == 0:
                        out.append((item_id, found // 4, found // 4 + len(want), 0))
                        found += 4 * (len(want) - 1)
                    else:
                        found -= found % 4
        near: dict[int, list[tuple[int, int, int]]] = {}
        for i, band in self.regions(*(hits or self.hits(c))).tolist():
            item_id, _, want = self.rows[i]
            k = int(self.k[i])
            first = (band - SHIFT) * (k + 1) - k
            lo, hi = max(0, first), min(len(c), first + 4 * (k + 1) + len(want))
            at = _find(want, c[lo:hi])  # most matches are whole: no alignment is needed for these
            got = (0, at, at + len(want)) if at >= 0 else align(want, c[lo:hi], k, first - lo, 4 * (k + 1))
            if got:
                near.setdefault(i, []).append((got[0], got[1] + lo, got[2] + lo))
        for i, own in near.items():
            taken: list[tuple[int, int]] = []
            for e, a, b in sorted(own):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    out.append((self.rows[i][0], a, b, e))
        return sorted(out, key=lambda r: (r[1], r[0]))


def windows(rows: list[tuple[int, str]], least: int = WINDOW) -> list[tuple[int, str]]:
    """The overlapping windows of the items that are longer than one by half a window at least; shorter ones are searched for as a whole only."""
    out = []
    for i, t in rows:
        wide = min(WINDOW, max(least, len(t or "") // 2))
        step = wide // 2
        if t and len(t) >= wide + step:
            out += [(i, t[a : a + wide]) for a in sorted({*range(0, len(t) - wide, step), len(t) - wide})]
    return out


class Benchmark:
    """A block of benchmark items, with one index of the whole items and one of their windows."""

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float, least_window: int = WINDOW) -> None:
        self.ids = [i for i, _ in rows]
        numbered = [(n, t) for n, (_, t) in enumerate(rows)]  # ids may repeat
        self.items, self.parts = Items(numbered, q, rate), Items(windows(numbered, least_window), q, rate)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, stop, edits) of the whole items and of the parts of items in a text."""
        c = codes(text)
        hits = self.items.hits(c)  # an item has all q-grams of its windows
        whole = self.items.search(c, hits)
        spans: dict[int, list[list[int]]] = {}
        for n, a, b, e in self.parts.search(c, hits):
            own = spans.setdefault(n, [])
            if own and a <= own[-1][1]:
                own[-1][1:] = max(own[-1][1], b), min(own[-1][2], e)
            else:
                own.append([a, b, e])
        parts = [(n, a, b, e) for n, own in spans.items() for a, b, e in own if all(b <= y or a >= z for x, y, z, _ in whole if x == n)]
        return [(self.ids[n], a, b, e) for n, a, b, e in sorted(whole + parts, key=lambda r: (r[1], r[0]))]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, least_window: int = WINDOW) -> DataFrame:
    """(id, item_id, start, stop, edits): each match of a benchmark item in ``docs``.

    Items go to the executors in blocks of about ``block_chars`` characters (one item may be longer), one pass over
    the documents for each block, so what is broadcast is bounded at any size of the benchmark. A worker process indexes a block once, for all its tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    # by hash, so blocks are of like size at any order of the items
    blocks = range(-(-chars // block_chars))
    sized = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, len(blocks)))).cast("int"))
    out = spark.createDataFrame([], SCHEMA)
    for b in blocks:
        block = spark.sparkContext.broadcast({"rows": [(r[0], r[1]) for r in sized.filter(F.col("block") == b).select("item_id", "text").collect()]})

        def find(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            held = block.value  # stays in the worker process from task to task
            if "index" not in held:
                held["index"] = Benchmark(held["rows"], q, rate, least_window)
            for pdf in batches:
                got = [(i, *m) for i, t in zip(pdf.id, pdf.text, strict=True) if isinstance(t, str) and t for m in held["index"].search(t)]
                yield pd.DataFrame(got, columns=["id", "item_id", "start", "stop", "edits"]).assign(item_id=pd.array([m[1] for m in got], "Int64"))

        out = out.unionByName(docs.select(as_text(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(find, SCHEMA))
    return typed_id(out, docs, id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns are kept."""
    from .common import materialize

    keyed = docs.select(row_hash("doc_id", "text").alias("_key"), "text")
    bad = materialize(contaminated(keyed, benchmark, "_key", "text").select(F.col("id").alias("_key")).distinct())
    return docs.join(small(bad, 500_000), row_hash("doc_id", "text") == bad["_key"], "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, stop, edits of every benchmark item found in a document."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "stop", "edits")


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES: dict[str, str] = {}
