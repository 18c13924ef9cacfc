"""Small matrices as rows of columns, which stay in the JVM, and systems of any size as arrays."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Num, num

Matrix = list[list[Num]]


def _sum(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


def transpose(m: Matrix) -> Matrix:
    return [list(r) for r in zip(*m, strict=True)]


def mat_vec(m: Matrix, v: list[Num]) -> list[Column]:
    return [_sum([num(a) * num(b) for a, b in zip(row, v, strict=True)]) for row in m]


def mat_mat(a: Matrix, b: Matrix) -> list[list[Column]]:
    return [[_sum([num(p) * num(q) for p, q in zip(row, col, strict=True)]) for col in transpose(b)] for row in a]


def outer(u: list[Num], v: list[Num]) -> list[list[Column]]:
    return [[num(a) * num(b) for b in v] for a in u]


def mat_sum(a: Matrix, b: Matrix) -> list[list[Column]]:
    return [[num(p) + num(q) for p, q in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]


def determinant(m: Matrix) -> Column:
    if len(m) == 1:
        return num(m[0][0])
    minor = lambda c: [[x for k, x in enumerate(row) if k != c] for row in m[1:]]
    return _sum([num(x) * determinant(minor(c)) * (-1.0 if c % 2 else 1.0) for c, x in enumerate(m[0])])


def inverse(m: Matrix) -> list[list[Column]]:
    """By cofactors, for up to four rows; null if singular."""
    det = determinant(m)
    n = range(len(m))
    minor = lambda r, c: [[x for k, x in enumerate(row) if k != c] for i, row in enumerate(m) if i != r]
    return [[F.when(det != 0, determinant(minor(c, r)) * (-1.0 if (r + c) % 2 else 1.0) / det) for c in n] for r in n]


def lu(m: Matrix) -> tuple[list[list[Column]], list[list[Column]]]:
    """(L, U) of m = L U with ones on the diagonal of L and rows as they come; null from the first pivot that is 0 on."""
    n = len(m)
    low = [[F.lit(1.0 if r == c else 0.0) for c in range(n)] for r in range(n)]
    up = [[F.lit(0.0)] * n for _ in range(n)]
    for r in range(n):
        for c in range(n):
            done = [low[r][k] * up[k][c] for k in range(min(r, c))]
            rest = num(m[r][c]) - _sum(done) if done else num(m[r][c])
            if c < r:
                low[r][c] = F.when(up[c][c] != 0, rest / up[c][c])
            else:
                up[r][c] = rest
    return low, up


def solved(matrix: Column, right: Column) -> Column:
    """The solution of each row's system: ``matrix`` an array of n * n numbers row by row, ``right`` one of n; null if singular, null or of wrong size."""

    @F.pandas_udf("array<double>")
    def run(ms: pd.Series, vs: pd.Series) -> pd.Series:
        out: list = [None] * len(ms)
        by_size: dict[int, list[int]] = {}
        for k, (a, b) in enumerate(zip(ms, vs, strict=True)):
            if a is not None and b is not None and len(a) == len(b) ** 2 and len(b):
                by_size.setdefault(len(b), []).append(k)
        for n, own in by_size.items():
            a, b = np.array([ms.iloc[k] for k in own], float).reshape(-1, n, n), np.array([vs.iloc[k] for k in own], float)
            good = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
            good[good] = np.linalg.matrix_rank(a[good]) == n
            for k, x in zip(np.array(own)[good].tolist(), np.linalg.solve(a[good], b[good][:, :, None])[:, :, 0], strict=True):
                out[k] = x
        return pd.Series(out, dtype=object)

    return run(matrix, right)
