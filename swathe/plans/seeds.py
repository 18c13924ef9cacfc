"""Ground seed points: the whole plan of windows, votes and filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize
from ..operators import windows as w


def seed_points(points: DataFrame, setting: w.Setting | None = None, head: DataFrame | None = None, tiled: bool = True) -> DataFrame:
    """id, x, y, z and ``source`` (``window`` or ``grid``) of the seed points.

    The cloud is read for the header, the windows and the grid, once each, and is never joined; a caller that has the header gives it.
    """
    s = setting or w.Setting()
    # both are small, and each is used more than once: settled, so that the cloud is not read again for them
    params = materialize(w.parameters(points, s, head))
    lowest = materialize(w.local_lowest(points, params, s, tiled))
    chosen = lowest.select("id", "x", "y", "z", F.lit("window").alias("source"))
    if s.b:
        chosen = chosen.union(w.fill(points, lowest, params, s).select("id", "x", "y", "z", F.lit("grid").alias("source")))
    return chosen


def summary(points: DataFrame, setting: w.Setting | None = None) -> DataFrame:
    """Numbers of points, seeds and points that are not seeds."""
    seeds = seed_points(points, setting).agg(F.count("*").alias("seeds"))
    return points.agg(F.count("*").alias("n")).crossJoin(seeds).select("n", "seeds", (F.col("n") - F.col("seeds")).alias("reduced"))
