"""Vector columns as whole numbers, for operators that need exact sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """True for a vector with entries, none of them null, NaN or infinite; else false."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def of_one_length(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the length that most have (the larger of equally common ones), and that length; 0 without rows."""
    common = rows.groupBy(F.size(name).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    return rows.filter(F.size(name) == d), d


def whole(v: Column, factor: float, plus: int, most: int) -> Column:
    """floor(factor * c) + ``plus`` of each entry as long; products beyond ``most`` either way count as ``most``."""
    at = lambda c: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), c.cast("double") * factor))).cast("long") + plus
    return F.transform(v, at)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow column of lists of ``d`` longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def most_of(x: np.ndarray) -> int:
    """The largest absolute value of whole numbers."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exact: in doubles where all sums fit them, else in longs, else in Python's integers."""
    bound = most_of(a) * most_of(b) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b if bound < 1 << 63 else a.astype(object) @ b.astype(object)
