"""Embedding whitening by a tiled, exact covariance.

Vectors become whole numbers, and each distinct one counts once (the fit list). The pairs of dimensions are cut into tiles: a tile key is a pair of column
blocks. The fit list is cut into column blocks of row-blocks, which are shuffled by row-block; a task multiplies the tile pairs of each row-block it gets, adds
up a sum per tile, and Spark adds up the tiles of all tasks, entry by entry. What reaches the driver is one number for each pair of dimensions, whatever the number of rows.

Numbers are centred by the rounded mean before they are multiplied; products and sums are exact, and so is what rounding the mean left over. The covariance
is rounded once, to doubles, and then eigendecomposed. The covariance of the whitened fit list is summed the same way, to report how far from the identity it is.

Defined cases: rows whose vector is null, empty, or holds a null, NaN or infinite entry are dropped, as are those of another length than most have. Products of an entry with the
factor count as 2**40 beyond it. Repeated rows each give their rows and count once in the fit. Components without variance (an eigenvalue that is zero but for rounding) are
not given, so vectors that are all equal, a single one and an empty table give no rows. A null id is kept. Equal eigenvalues: any orthonormal
axes of their space, the same for all rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .vectors import finite, matrix, most_of, of_one_length, product, whole

FACTOR, PLUS, MOST = 64.0, 1_000_000, 1 << 40
COMPONENTS, WIDTH, ROWS = 16, 64, 2048
#: an eigenvalue below this share of the first, times the dimensions, is zero but for rounding
FLAT = 2.0**-48
EXACT, FLOATING = "decimal(38,0)", "double"


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors of d dimensions with sums ``centre * n + rest``; axes (d x k) map centred numbers to components; eigenvalues fall."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def numbers(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id and x (whole numbers) of the usable rows, written, and the number of dimensions."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(finite(F.col("v")))
    kept, d = of_one_length(kept, "v")
    return materialize(kept.select("id", whole(F.col("v"), FACTOR, PLUS, MOST).alias("x"))), d


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = matrix(batch["x"], d)
            n += len(x)
            fits = most_of(x) * max(1, len(x)) < 1 << 63
            total += (x if fits else x.astype(object)).sum(axis=0).astype(object)
        values = pa.array([int(v) for v in [n, *total]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d, dtype=np.int32)), values], ["dim", "value"])

    got = rows.select("x").mapInArrow(run, f"dim int, value {EXACT}").groupBy("dim").agg(F.sum("value").alias("value")).collect()
    by = {r.dim: int(r.value) for r in got}
    return by.get(-1, 0), [by.get(k, 0) for k in range(d)]


def tile_sums(rows: DataFrame, d: int, centre: np.ndarray, axes: np.ndarray | None = None, shift: np.ndarray | None = None, width: int = WIDTH, height: int = ROWS) -> np.ndarray:
    """The sum over all rows of y y', by tiles: y = x - centre, exact; with ``axes``, y = (x - centre - shift) @ axes and a 1 behind it, in doubles.

    ``width`` dimensions make a column block, ``height`` rows a row-block; a task holds one row-block and a sum for each tile.
    """
    wide = d if axes is None else axes.shape[1] + 1
    blocks = -(-wide // width)
    kind = EXACT if axes is None else FLOATING

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the row-blocks of a task are numbered in the order of a written table: a retry gives the same
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            every = matrix(batch["x"], d) - centre
            for at in range(0, len(every), height):
                y = every[at : at + height]
                if axes is not None:
                    y = np.hstack([(y - shift) @ axes, np.ones((len(y), 1))])
                else:
                    y = y.astype(np.int16 if most_of(y) < 1 << 15 else np.int32 if most_of(y) < 1 << 31 else np.int64)
                parts = [np.ascontiguousarray(y[:, c : c + width]).tobytes() for c in range(0, wide, width)]
                many = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(many, number)), pa.array(np.arange(many, dtype=np.int32)), pa.array([len(y)] * many, pa.int32()), pa.array([y.dtype.str] * many), pa.array(parts, pa.binary())],
                    ["row_block", "column_block", "n", "kind", "data"],
                )
                number += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        bounds: dict[tuple[int, int], int] = {}

        def given(tile: tuple[int, int], values: np.ndarray) -> pa.RecordBatch:
            if axes is None:
                flat = pa.array([int(v) for v in values.ravel()], pa.decimal128(38, 0))
            else:
                flat = pa.array(values.ravel().astype(np.float64))
            return pa.RecordBatch.from_arrays([pa.array([tile[0]], pa.int32()), pa.array([tile[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), flat)], ["a", "b", "values"])

        def add(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, left in enumerate(own):
                for b in range(a, len(own)):
                    if axes is not None:
                        sums[a, b] = sums.get((a, b), 0.0) + left.T @ own[b]
                        continue
                    got, grow = product(left.T, own[b]), most_of(left) * most_of(own[b]) * len(left)
                    if (a, b) in sums and bounds[a, b] + grow >= 1 << 62:
                        yield given((a, b), sums.pop((a, b)))
                    if grow >= 1 << 62:
                        yield given((a, b), got)
                    elif (a, b) in sums:
                        sums[a, b] += got
                        bounds[a, b] += grow
                    else:
                        sums[a, b], bounds[a, b] = got, grow

        own: list[np.ndarray] = []
        for batch in batches:
            for c, n, kind, data in zip(batch["column_block"].to_pylist(), batch["n"].to_pylist(), batch["kind"].to_pylist(), batch["data"], strict=True):
                x = np.frombuffer(data.as_buffer(), kind).reshape(n, -1)
                own.append(x if axes is not None else x.astype(np.int64))
                if c == blocks - 1:  # sorted: the last column block of a row-block
                    yield from add(own)
                    own = []
        for tile, values in sums.items():
            yield given(tile, values)

    dealt = rows.select("x").mapInArrow(cut, "row_block long, column_block int, n int, kind string, data binary").repartition("row_block").sortWithinPartitions("row_block", "column_block")
    tiles = dealt.mapInArrow(multiply, f"a int, b int, values array<{kind}>").select("a", "b", F.posexplode("values").alias("at", "value"))
    got = tiles.groupBy("a", "b", "at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((wide, wide), object if axes is None else np.float64)
    for a, b, at, value in zip(*[got[c].to_pylist() for c in ("a", "b", "at", "value")], strict=True):
        i, j = a * width + at // min(width, wide - b * width), b * width + at % min(width, wide - b * width)
        total[i, j] = total[j, i] = int(value) if axes is None else value
    return total


def fit(rows: DataFrame, d: int, components: int = COMPONENTS, width: int = WIDTH, height: int = ROWS) -> Whitening:
    """The whitening of the distinct vectors among ``rows`` (x: arrays of ``d`` longs)."""
    listed = materialize(rows.select("x").distinct())
    n, sums = _sums(listed, d) if d else (0, [])
    if not n:
        none = np.zeros(0, np.int64)
        return Whitening(0, none, none, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    centre_at = np.array(centre, np.int64)
    squares = tile_sums(listed, d, centre_at, width=width, height=height)
    # whole numbers until this one rounding
    v = np.array([[(n * int(squares[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > max(values[0], 0.0) * d * FLAT).sum()))
    scaled = axes[:, :k] / np.sqrt(values[:k])
    error = 0.0
    if k:
        whitened = tile_sums(listed, d, centre_at, axes=scaled, shift=np.array([r / n for r in rest]), width=width, height=height) / n
        mean = whitened[:k, k]
        error = float(np.abs(whitened[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(n, centre_at, np.array(rest, np.int64), scaled, values[:k].copy(), float(np.trace(v)), error)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, component (from 1), deviation (exact, decimal), whitened and explained of each of ``rows`` (id, x) in each component."""
    n, centre, rest, axes = model.n, model.centre, model.rest, model.axes
    d, k = len(centre), axes.shape[1]
    explained = model.eigenvalues / model.trace if k else np.zeros(0)
    shift = rest / max(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix(batch["x"], d) - centre
            most = n * most_of(y) + n
            if most < 1 << 31 and most * most * d < 1 << 63:
                q = n * y - rest
                deviation = pa.array((q * q).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                q = y.astype(object) * n - rest.astype(object)
                deviation = pa.array([int(v) for v in (q * q).sum(axis=1)], pa.decimal128(38, 0))
            times = pa.array(np.repeat(np.arange(len(y)), k))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(times), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), deviation.take(times), pa.array(((y - shift) @ axes).ravel()), pa.array(np.tile(explained, len(y)))],
                ["id", "component", "deviation", "whitened", "explained"],
            )

    kind = rows.select("id").schema[0].dataType.simpleString()
    if not k:
        return rows.select("id", F.lit(0).alias("component"), F.lit(0).cast(EXACT).alias("deviation"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained")).limit(0)
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, component int, deviation {EXACT}, whitened double, explained double")


def whiten(vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """The whitened components of every usable row, and the fit."""
    small_batches(vectors.sparkSession, 4096, 16 << 20)
    rows, d = numbers(vectors, id_col, vector_col)
    model = fit(rows, d, components)
    return whitened(rows, model), model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and each of 16 components; a deviation beyond a long is null."""
    got, model = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return got.select(
        F.col("id").alias("vec_id"), "component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", F.lit(model.identity_error).alias("identity_error")
    )


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
