"""Near-duplicates by the similarity of texts: Jaccard similarity of their sets of five-word runs, 0.8 or more.

The SimHash operator comes first: fingerprints over five-word runs, joined by its tries at 4 bits; what its spanning forest links is linked here if the
sets are similar. Most copies are found so. For the rest, which differ in more bits, MinHash bands choose the texts that can have a partner: 20 bands of 5 hashes, so two of similarity 0.8 share a band with probability 0.9996, two of 0.9
all but surely. Among these, exactly, two sets can only be similar if they share one of their rarest runs: of a set of n runs the n - ceil(0.8 n) + 1 that stand in the
fewest sets (its prefix); and where the first run that they share stands late in one of the two, what is left of it is too little for the overlap
that 0.8 asks for. Runs of one text only come first, so a text that was changed in many places meets no other, whatever its group holds.
Every pair is verified on the whole sets; a shared band or run alone never links two texts. Texts of the same set are one node from the
start. The members of a run are compared pair by pair where that is few pairs; else with a few hubs first (that with the most partners, and others by hash, new ones in each round),
and only members that are not yet in one component go on. Two sets meet in a run only if the runs before it, of those kept, are not the same one in both: else they have met there. So
copies meet about once for each place in which they differ, and not once for each run that they share. Sets whose sizes alone rule the similarity out are not compared.

Defined cases: texts without a word are copies of each other and of nothing else; a text of five words or fewer is one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small, small_batches
from .simhash import components, fingerprints
from .simhash import links as fingerprint_links

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
STARS, HUBS = 2, 3
_RANDOM = np.random.default_rng(20240229)
MULTIPLY = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
MIX = _RANDOM.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def runs(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of ``width`` words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), 42) for i in range(max(min(len(words), 1), len(words) - width + 1))], np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """The signed keys of a set's bands."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        np.minimum(least, (MULTIPLY[:, None] * own[None, i : i + 4096] + ADD[:, None]).min(axis=1), out=least)
    key = ((least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64)
    key ^= key >> np.uint64(32)
    return (key * MULTIPLY[:BANDS]).view(np.int64)


def _signature(text: Column) -> Column:
    @F.pandas_udf("same long, size int, fp long, bands array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for s in batches:
            texts = [t if isinstance(t, str) else None for t in s]
            sets = [runs(t) for t in texts]
            same = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"same": same, "size": np.array([len(x) for x in sets], np.int32), "fp": fingerprints(texts, WIDTH), "bands": pd.Series([bands(x) for x in sets], dtype=object)})

    return sign(text)


def _runs(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([runs(t if isinstance(t, str) else None).view(np.int64) for t in s], dtype=object)

    return each(text)


def _by_fingerprint(uniq: DataFrame, budget: int = 4) -> DataFrame:
    """(u, v): pairs of sets whose fingerprints are equal or linked in the SimHash operator's forest; a pair for each set at most, and one for each link."""
    lead = materialize(uniq.groupBy("fp").agg(F.min("same").alias("lead")))
    equal = uniq.join(small(lead, 300_000), "fp").filter("same <> lead").select(F.col("same").alias("u"), F.col("lead").alias("v"))
    forest = materialize(fingerprint_links(lead, budget))
    end = lambda c: lead.select(F.col("fp").alias(c), F.col("lead").alias(f"at_{c}"))
    return equal.union(forest.join(end("u"), "u").join(end("v"), "v").select(F.col("at_u").alias("u"), F.col("at_v").alias("v")))


def _prefixes(sets: DataFrame) -> DataFrame:
    """(band, same, size, df, rest): the runs in each set's prefix that another set has too, in how many sets each stands, and how many runs of the set come from it on.

    Any order of all runs would do; by rising frequency they meet least.
    """
    each = sets.select("same", F.explode("own").alias("band"))
    common = each.groupBy("band").agg(F.count("*").alias("df")).filter("df > 1")
    by_set = Window.partitionBy("same")  # a text's own runs
    held = each.join(common, "band").withColumn("rank", F.row_number().over(by_set.orderBy("df", "band"))).withColumn("shared", F.count("*").over(by_set))
    held = held.join(sets.select("same", F.size("own").alias("size")), "same")
    # the prefix begins with the runs that no other set has: size - shared of them
    return held.filter(F.col("rank") <= F.col("shared") + 1 - F.ceil(LEAST * F.col("size") - 1e-9)).select("band", "same", "size", "df", (F.col("shared") - F.col("rank") + 1).cast("int").alias("rest"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (u, v) whose sets are similar."""
    a = sets.select(F.col("same").alias("u"), F.col("own").alias("a"))
    b = sets.select(F.col("same").alias("v"), F.col("own").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").filter(both >= LEAST * (F.size("a") + F.size("b") - both) - 1e-9).select("u", "v")


def _meet(live: DataFrame, other: DataFrame, last: bool) -> DataFrame:
    """The rows of ``live`` with those of ``other`` (b2, s2, z2, e2, b1, r2) of the same run, if they may be similar and are not in one component; in the ``last`` round every pair once a place."""
    near = (F.least("size", "z2") >= LEAST * F.greatest("size", "z2") - 1e-9) & (F.least("rest", "e2") >= LEAST / (1 + LEAST) * (F.col("size") + F.col("z2")) - 1e-9)
    # two that also share the run before have met there, where more is left of both
    once = (F.col("same") < F.col("s2")) & F.coalesce(F.col("before") != F.col("b1"), F.lit(True))
    return live.join(other, (F.col("band") == F.col("b2")) & (F.col("root") != F.col("r2")) & near & (once if last else F.lit(True)))


def similar(docs: DataFrame, key: list[Column]) -> DataFrame:
    """(id, k1, k2, root) of each row of ``docs``: its keys and a number that names its component."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id").alias("id"), key[0].alias("k1"), key[1].alias("k2"), "text")
    found = materialize(named.select("id", "k1", "k2", _signature(F.col("text")).alias("s")).select("id", "k1", "k2", "s.same", "s.size", "s.fp", "s.bands"))
    uniq = materialize(found.groupBy("same").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    each = uniq.select("same", "size", F.explode("bands").alias("band"))
    often = small(materialize(each.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")), 300_000)
    near = materialize(_by_fingerprint(uniq.filter("size > 0")))
    chosen = each.join(often, "band").select("same").union(near.select("u")).union(near.select("v")).distinct()
    need = uniq.join(chosen, "same", "left_semi").select("same", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"))
    need = small(materialize(need), 300_000)
    sets = materialize(named.join(need, ["k1", "k2"]).select("same", "text").withColumn("own", _runs(F.col("text"))).select("same", "own").dropDuplicates(["same"]))
    members = materialize(_prefixes(sets))
    held = members.groupBy("band").agg(F.first("df").alias("df"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("same")).alias("x"), F.bit_xor(F.xxhash64("same", F.lit(1))).alias("y")).filter("n > 1")
    # runs of the same members count once, by the first of them
    shared = small(materialize(held.groupBy("n", "x", "y").agg(F.min(F.struct("df", "band")).alias("first")).select("first.band")), 300_000)
    # before: the run of a set's that comes just before, in the order that all sets share
    before = F.lag("band").over(Window.partitionBy("same").orderBy("df", "band"))
    every, members = members, materialize(members.join(shared, "band").withColumn("before", before))
    discard(every)
    links = materialize(_verified(near, sets))
    comp = materialize(components(links))
    for turn in range(STARS + 1):
        at = members.join(comp, members.same == comp.node, "left")
        at = materialize(at.select("band", "same", "size", "rest", "before", F.coalesce("root", "same").alias("root")))
        per_root = at.groupBy("band", "root").agg(F.count("*").cast("double").alias("n"))
        apart = materialize(per_root.groupBy("band").agg(F.count("*").alias("roots"), F.sum("n").alias("rows"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")).filter("roots > 1"))
        size = apart.agg(F.sum("pairs"), F.sum("rows")).first()
        if not size[0]:
            break
        last = turn == STARS or size[0] <= 4 * size[1]
        live = at.join(small(apart.select("band"), 300_000), "band")
        if not last:
            degree = live.groupBy("same").agg(F.count("*").alias("degree"))
            live = materialize(live.join(degree, "same"))
        hubs = [F.min(F.struct((F.negate("degree") if not k and not last else F.xxhash64("same", F.lit(turn * HUBS + k))).alias("h"), "same", "size", "rest", "before", "root")) for k in range(HUBS)]
        other = live if last else live.groupBy("band").agg(F.array_distinct(F.array(*hubs)).alias("m")).select("band", F.explode("m").alias("m")).select("band", "m.same", "m.size", "m.rest", "m.before", "m.root")
        other = other.select(F.col("band").alias("b2"), F.col("same").alias("s2"), F.col("size").alias("z2"), F.col("rest").alias("e2"), F.col("before").alias("b1"), F.col("root").alias("r2"))
        meet = _meet(live, other, last)
        pairs = materialize(meet.select(F.greatest("same", "s2").alias("u"), F.least("same", "s2").alias("v")).distinct())
        new = materialize(_verified(pairs, sets))
        links = links.unionByName(new)
        comp = materialize(components(links))
        discard(at, pairs)
        if last:
            break
    return found.join(small(comp, 100_000), found.same == comp.node, "left").select("id", "k1", "k2", F.coalesce("root", "same").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (nulls last), then text hash; all columns are kept.

    Texts are joined with the keys of the rows that go, which are broadcast if they are few. Repeated rows that are chosen are
    reduced to one; only these are shuffled with their texts.
    """
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64("text")]
    found = materialize(similar(docs, key))
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k2", "k1")).alias("m")).select("m.k1", "m.k2")
    per_key = found.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    kept = per_key.join(chosen, ["k1", "k2"], "left_semi").select("k1", "k2", F.lit(True).alias("keep"), "n")
    odd = materialize(per_key.join(kept.select("k1", "k2", "keep"), ["k1", "k2"], "left").filter("keep is null or n > 1").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.coalesce("keep", F.lit(False)).alias("_keep")))
    odd = small(odd, 300_000)
    match = (key[0] == F.col("_k1")) & (key[1] == F.col("_k2"))
    single = docs.join(odd, match, "left_anti")
    twice = docs.join(odd.filter("_keep"), match, "left_semi")
    return single.unionByName(twice.dropDuplicates(["doc_id", "text"]))
