"""Trees against builds point by point."""

import math

import numpy as np
import pytest

from swathe.lineage import materialize
from swathe.operators import index as ix
from swathe.operators import trees as tr
from swathe.operators.windows import header

SCHEMA = "id long, x double, y double, z double"


def recursive_nodes(codes, bits):
    """The inner nodes over sorted codes, by splitting ranges where the first bit turns; equal codes by the bits of their places."""
    full = [(c << tr.RANK_BITS) | i for i, c in enumerate(codes)]
    wide, out = bits + tr.RANK_BITS, []

    def walk(first, last, parent, node):
        shared = wide - (full[first] ^ full[last]).bit_length()
        bit = 1 << (wide - shared - 1)
        split = max(i for i in range(first, last) if not full[i] & bit)
        out.append((node, parent, first, last, split, shared, first == split, last == split + 1))
        if first < split:
            walk(first, split, node, split)
        if split + 1 < last:
            walk(split + 1, last, node, split + 1)

    if len(codes) > 1:
        walk(0, len(codes) - 1, None, 0)
    return sorted(out, key=str)


@pytest.mark.parametrize("codes", [[], [5], [5, 5], [0, 0, 0, 0, 0, 7], [1, 2, 4, 5, 5, 5, 19, 24, 25, 30, 30, 31], "random", "crowded"])
def test_topology_by_recursive_split(spark, codes):
    rng = np.random.default_rng(1)
    if codes == "random":
        codes = sorted(rng.integers(0, 1 << 32, 700).tolist())
    elif codes == "crowded":
        codes = sorted([*rng.integers(0, 64, 300).tolist(), *([77] * 200), 1 << 31, (1 << 32) - 1])
    df = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "code long, rank long").repartition(3)
    assert sorted(map(tuple, tr.topology(df).collect()), key=str) == recursive_nodes(codes, 32)


@pytest.mark.parametrize("size, bits", [(1, 32), (7, 32), (64, 63)])
def test_topology_in_parts(spark, size, bits):
    """Nodes that reach over many tasks' ranks, runs of equal codes among them; codes are shuffled, not their prefixes."""
    rng = np.random.default_rng(size)
    codes = sorted([*rng.integers(0, 1 << bits - 1, 60).tolist(), *rng.integers(0, 16, 40).tolist(), *([77] * 45), (1 << bits) - 1])
    df = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "code long, rank long").repartition(3)
    got = tr.topology(df, bits, size)
    assert sorted(map(tuple, got.collect()), key=str) == recursive_nodes(codes, bits)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("axes", ["xy", "xyz"])
def test_one_point_leaves_by_insertion(spark, axes):
    rng = np.random.default_rng(2)
    xyz = [*(rng.random((120, 3)) * 8).tolist(), *(rng.random((30, 3)) * 0.05 + 3).tolist(), *[[1.0, 1.0, 1.0]] * 3, [40.0, 40.0, 40.0]]
    rows = [(i, *map(float, v)) for i, v in enumerate(xyz)]
    n, radius = len(axes), (40 - min(min(r[1 : 1 + len(axes)]) for r in rows)) / 2
    p = spark.createDataFrame(rows, SCHEMA)
    box = ix.geometry(header(p, axes), axes).first()
    radius, centre = box.radius, [box[f"c{a}"] for a in axes]
    out = []

    def insert(own, c, r, level):  # a leaf of two splits while half its radius is above the least
        if len(own) < 2 or not r / 2 > 0.10:
            if own:
                out.append((level, len(own), *min((v[3], v[0]) for v in own)))
            return
        for q in range(1 << n):
            up = [q >> (n - 1 - a) & 1 for a in range(n)]
            insert([v for v in own if all((v[1 + a] >= c[a]) == bool(up[a]) for a in range(n))], [c[a] + (r / 2 if up[a] else -r / 2) for a in range(n)], r / 2, level + 1)

    insert(rows, centre, radius, 0)
    assert sorted((r.level, r.n, r.z, r.id) for r in tr.one_point_leaves(p, axes=axes).collect()) == sorted(out)
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert [(r.level, r.key, r.n) for r in tr.one_point_leaves(one, axes=axes).collect()] == [(0, 0, 1)]
    assert tr.one_point_leaves(p.limit(0), axes=axes).count() == 0


def test_a_sub_clouds_tree_refers_to_the_clouds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, v)) for i, v in enumerate([*rng.random((300, 3)).tolist(), *(rng.random((60, 3)) * 1e-2).tolist()])]
    p = spark.createDataFrame(rows, SCHEMA)
    head = materialize(header(p))
    parents = materialize(ix.number_leaves(p, 8, 0, ix.MAX_DEPTH, head=head).select("level", "key", "n"))
    ids = spark.createDataFrame([(i,) for i in [*range(0, 300, 9), *range(300, 360), 5000] * 2], "id long")
    keys = {r.id: r.key for r in ix.with_keys(p, ix.MAX_DEPTH, head).collect()}
    up = lambda k, d: k >> (2 * (ix.MAX_DEPTH - d))
    own = {i for i in [*range(0, 300, 9), *range(300, 360)]}
    leaves = [(r.level, r.key, r.n) for r in parents.collect()]
    got = tr.sub_leaves(p, ids, parents, 3, head).collect()
    assert sum(r.n for r in got) == len(own)
    for r in got:
        assert r.n == sum(up(keys[i], r.level) == r.key for i in own)
        inside = [n for d, k, n in leaves if d >= r.level and k >> (2 * (d - r.level)) == r.key and n]
        over = [n for d, k, n in leaves if d < r.level and r.key >> (2 * (r.level - d)) == k]
        assert (r.parent_n, r.parent_leaves) == ((sum(inside), len(inside)) if inside else (over[0], 1))
    chunks = tr.sub_chunks(p, ids, parents, 10, head).collect()
    order = sorted((keys[i], i) for i in own)
    leaf = lambda k: next((d, a) for d, a, _ in leaves if up(k, d) == a)
    for r in chunks:
        part = [k for k, _ in order[r.chunk * 10 : r.chunk * 10 + 10]]
        assert (r.n, r.first_key, r.last_key, r.parent_leaves) == (len(part), part[0], part[-1], len({leaf(k) for k in part}))
    assert len(chunks) == math.ceil(len(own) / 10)


def test_ranks_are_dense_over_crowded_rows(spark):
    df = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(1000)], "a long, b long").repartition(7)
    got = ix.dense_rank(df, "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.a, r.b) for r in got)
    assert sorted(r["rank"] for r in got) == list(range(1000))
    assert ix.dense_rank(df.limit(0), "a").count() == 0


def test_morton_sort_is_dealt_by_the_number_of_points(spark):
    """No task sorts more than its share, however many points there are; few points keep the given number of partitions."""
    p = spark.range(1000).selectExpr("id", "CAST(id % 37 AS DOUBLE) AS x", "CAST(id % 41 AS DOUBLE) AS y", "0D AS z")
    got = ix.morton_sorted(p, 4, most=50)
    sizes = [len(part) for part in got.rdd.glom().collect()]
    assert len(sizes) == 20 and sum(sizes) == 1000 and max(sizes) < 150
    rows = [(r.code, r.id) for r in got.collect()]
    assert rows == sorted(rows)
    assert ix.morton_sorted(p, 4).rdd.getNumPartitions() == 4
    assert ix.morton_sorted(p.limit(0), 4).count() == 0
