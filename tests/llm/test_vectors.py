"""Whitening and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathe.llm import hard_negatives, vectors, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
BAD = [(901, None, 1), (902, [], 1), (903, [None, 1.0, 2.0, 3.0, 0.5, 0.25], 1), (904, [float("nan"), 1.0, 2.0, 3.0, 0.5, 0.25], 2), (905, [float("inf"), 1.0, 2.0, 3.0, 0.5, 0.25], 2), (906, [1.0, 2.0], 3)]


def cloud(n, d, seed, spread=1.0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d))
    return [[float(v) for v in np.float32(row)] for row in r.normal(size=(n, d)) @ mix * spread / math.sqrt(d)]


def written(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, EMBEDDINGS)
    if extra:
        for c in ("id", "x", "v", "n", "component", "cell", "block", "score", "rank"):
            df = df.withColumn(c, F.lit("x"))
    df.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


# --- whitening


def brute_whitening(rows, components=16):
    kept = [(i, tuple(math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v)) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({v for _, v in kept}), object)
    n, s = len(x), x.sum(axis=0)
    y = (x * n - s).astype(np.float64) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in kept:
        q = np.array(v, object) * n - s
        out[i, v] = int((q * q).sum()), (q.astype(np.float64) / n) @ axes[:, :components] / np.sqrt(values[:components])
    return n, out, values, axes


@pytest.mark.parametrize("seed", [1, 2])
def test_whitening_by_brute_force(spark, tmp_path, seed):
    data = cloud(300, 20, seed)
    rows = [(i, v, i % 5) for i, v in enumerate(data)] + [(7, data[7], 2), (1000, data[7], 2), (None, data[3], 1), *[b for b in BAD]]
    rows += [(2000 + k, data[5], 1) for k in range(150)]  # one vector for a third of all rows
    got = whitening.op11_whitening(spark, written(spark, rows, tmp_path, extra=True)).collect()
    good = [r for r in rows if r[1] and len(r[1]) == 20]
    n, want, values, _ = brute_whitening(good)
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n} == {300}
    by_component = {}
    by_id = {r[0]: tuple(math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in r[1]) for r in good}
    for r in got:
        deviation, w = want[r.vec_id, by_id[r.vec_id]]
        assert r.deviation == deviation
        by_component.setdefault(r.component, []).append((r.whitened, w[r.component - 1]))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        assert 0 <= r.identity_error < 1e-9
    for pairs in by_component.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_tiles_of_any_width_and_height_give_the_exact_sums(spark):
    x = np.random.default_rng(5).integers(-(1 << 39), 1 << 39, (101, 13))
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(4)
    whole = x.astype(object).T @ x.astype(object)
    for width, height in ((64, 2048), (5, 7), (1, 50), (13, 1)):
        assert (whitening.tile_sums(df, 13, np.zeros(13, np.int64), width=width, height=height) == whole).all()
    assert whitening._sums(df, 13) == (101, [int(v) for v in x.astype(object).sum(axis=0)])


def test_whitening_of_flat_single_and_no_vectors(spark, tmp_path):
    for rows in ([], BAD[:5], [(1, [1.0, 2.0], 0)], [(k, [1.0, 2.0], 0) for k in range(4)]):
        df = spark.createDataFrame(rows, EMBEDDINGS)
        got, model = whitening.whiten(df, "vec_id", "embedding")
        assert got.collect() == [] and model.identity_error == 0.0
        assert [c for c, _ in got.dtypes] == ["id", "component", "deviation", "whitened", "explained"]
    # two of three dimensions vary, one is twice another: components without variance are left out
    flat = [(k, [float(k % 7), 2.0 * (k % 7), float(k * k % 5)], 0) for k in range(35)]
    got, model = whitening.whiten(spark.createDataFrame(flat, EMBEDDINGS), "vec_id", "embedding")
    assert {r.component for r in got.collect()} == {1, 2} and model.identity_error < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(k, [1e30 if k % 3 else -1e30, 1e6 * k, float(k)], 0) for k in range(12)]
    got, model = whitening.whiten(spark.createDataFrame(rows, EMBEDDINGS), "vec_id", "embedding")
    x = {k: [min(max(math.floor(64 * float(np.float32(c))), -(1 << 40)), 1 << 40) + 1_000_000 for c in v] for k, v, _ in rows}
    s = [sum(v[j] for v in x.values()) for j in range(3)]
    assert {r.id: int(r.deviation) for r in got.collect()} == {k: sum((12 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for k, v in x.items()}


# --- hard negatives


def brute_negatives(rows):
    e = {(i, int(lab), tuple(math.floor(256 * np.float64(np.float32(c))) for c in v)) for i, v, lab in rows if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for a in e:
        if a[0] % 50:
            continue
        score = lambda r: sum(p * q for p, q in zip(a[2], r[2], strict=True))  # noqa: E731, B023
        rest = sorted((-score(r), r[0], r[1]) for r in e if r[0] != a[0])
        for s, i, lab in [t for t in rest if t[2] == a[1]][:5]:
            band = [t for t in rest if t[2] != a[1] and 50 * -s <= 100 * -t[0] <= 95 * -s]
            out += [(a[0], i, k, t[1], -s, -t[0]) for k, t in enumerate(band[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, shard, block", [(1, 16_384, 8192), (2, 37, 3), (3, 200, 5)])
def test_negatives_by_brute_force(spark, monkeypatch, seed, shard, block):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "GROUP", 2)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 24)
    r = random.Random(seed)
    centres = cloud(6, 6, seed, 2.0)
    rows = [(i, [c + r.gauss(0, 0.3) for c in centres[i % 6]], r.randint(0, 3)) for i in range(600)]
    rows += [(1000 + k, rows[50][1], rows[50][2]) for k in range(250)]  # one vector many times: ties
    rows += [(2000 + k, rows[50][1], (rows[50][2] + 1) % 4) for k in range(100)]
    rows += [rows[0], rows[100], (100, rows[101][1], rows[100][2]), (150, rows[3][1], 9), (None, rows[1][1], 1), (3000, rows[2][1], None), (3050, [0.0] * 6, 0), *BAD]
    rows += [(3100, [-c for c in rows[100][1]], 77), (3101, [-c for c in rows[100][1]], 77)]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, EMBEDDINGS).repartition(4)
    got = hard_negatives.mine(df, "vec_id", F.col("label"), "embedding", F.col("id") % 50 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == brute_negatives([x for x in rows if x[1] is None or len(x[1]) == 6])


def test_groups_of_anchors_are_pruned_at_once():
    r = np.random.default_rng(0)
    centres = r.integers(-200, 200, (8, 16)) * 4
    x = np.concatenate([c + r.integers(-5, 5, (200, 16)) for c in centres])
    labels = np.repeat(np.arange(8) % 2, 200)
    tree, shard = hard_negatives.Tree(x[::5], labels[::5], 16), hard_negatives.Tree(x, labels, 32)
    score = x[::5] @ x.T
    kth = np.sort(score, axis=1)[:, -20]
    a, b, _ = hard_negatives._pairs(tree, shard, tree.least(kth), np.full(len(tree.start), 1 << 60), True)
    every = (tree.left < 0).sum() * (shard.left < 0).sum()
    assert 0 < len(a) < every / 4
    # nothing that reaches a limit is left out
    for row in range(0, len(score), 37):
        leaf = next(k for k in range(len(tree.start)) if tree.left[k] < 0 and row in tree.order[tree.start[k] : tree.end[k]])
        held = np.concatenate([shard.order[shard.start[k] : shard.end[k]] for k in b[a == leaf]])
        need = np.flatnonzero((score[row] >= kth[row]) & (labels == labels[::5][row]))
        assert set(need) <= set(held)


def test_negatives_of_no_rows(spark, tmp_path):
    got = hard_negatives.op13_hard_negatives(spark, written(spark, BAD[:5], tmp_path))
    assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    lone = [(50, [1.0, 2.0], 1), (51, [1.0, 2.5], 2), (100, [0.5, 0.5], 3)]
    assert hard_negatives.op13_hard_negatives(spark, written(spark, lone, tmp_path, extra=True)).collect() == []


def test_products_are_exact_at_any_size():
    for most in (10, 1 << 30, 1 << 45):
        x = np.random.default_rng(1).integers(-most, most, (7, 9))
        assert (vectors.product(x, x.T) == x.astype(object) @ x.astype(object).T).all()
