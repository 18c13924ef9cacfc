"""Window minima over a stream of points, kept up to date by Structured Streaming.

An extension: the tiles of points that the same windows hold are reduced by a streaming aggregation (count and lowest point), so state grows with the
area seen, not with the points. The window minima follow from the tiles at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import lowest, number_of
from ..operators import windows as w


def tiles(points: DataFrame, params: DataFrame, s: w.Setting) -> DataFrame:
    """i0, i1, j0, j1, n and the lowest point (key, z, x, y) of each tile; ``points`` may be a stream, ``params`` must not be."""
    return w.tiles(points, params, s)


def minima(tiled: DataFrame, params: DataFrame) -> DataFrame:
    """Window minima of a batch of tiles."""
    i = tiled.select("n", "key", "z", F.explode(F.sequence("i0", "i1")).alias("i"), "j0", "j1").select("n", "key", "z", "i", F.explode(F.sequence("j0", "j1")).alias("j"))
    got = i.groupBy("i", "j").agg(F.sum("n").alias("n"), *lowest("key", "z")).crossJoin(F.broadcast(params.select("minnum"))).filter("n >= minnum")
    return got.select("i", "j", "n", "z", number_of("key").alias("id"))
