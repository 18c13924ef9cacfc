"""Geometry over groups: segments cut into points, hulls, normals and small linear systems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats as st
from .tiles import box_moments


def discretized(segments: DataFrame, step: float) -> DataFrame:
    """(id, step, x, y): a point at each whole ``step`` along the segments (id, x0, y0, x1, y1)."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = segments.withColumn("size", F.sqrt(dx * dx + dy * dy))
    n = F.floor(F.col("size") / step).cast("long")
    e = s.filter(n >= 1).select("*", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("step"))
    return e.select("id", "step", (F.col("x0") + dx / F.col("size") * F.col("step") * step).alias("x"), (F.col("y0") + dy / F.col("size") * F.col("step") * step).alias("y"))


def hull_of(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost; points on an edge are left out."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(xy)[:-1] + chain(xy[::-1])[:-1])


def convex_hull(points: DataFrame, key: str) -> DataFrame:
    """(key, hull): per group the hull's corners, array<struct<x, y>>.

    Each partition first reduces its groups to the corners of their own hulls, so a group of any size comes to its task as corners.
    """
    kind = points.schema[key].dataType.simpleString()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[object, np.ndarray] = {}
        for pdf in batches:
            for k, g in pdf.groupby("key"):
                xy = g[["x", "y"]].to_numpy()
                kept[k] = hull_of(np.vstack((kept[k], xy)) if k in kept else xy)
        for k, h in kept.items():
            yield pd.DataFrame({"key": k, "x": h[:, 0], "y": h[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: [pdf.key.iloc[0]], "hull": [[{"x": a, "y": b} for a, b in h]]})

    corners = points.select(F.col(key).alias("key"), "x", "y").mapInPandas(part, f"key {kind}, x double, y double")
    return corners.groupBy("key").applyInPandas(whole, f"{key} {kind}, hull array<struct<x:double,y:double>>")


def eigen_normals(points: DataFrame, r: float) -> DataFrame:
    """(id, nx, ny, nz): the upward normal of each point's neighbourhood in the box of half side r, itself included; with n and the neighbourhood's
    covariances xx, xy, xz, yy, yz, zz.

    The sums are found by ranks in tiles, without making pairs (``box_moments``); only six numbers per point go to the eigenvectors, in batches. Under three neighbours there is no row. Ids are one point's each.
    """
    g = box_moments(points, r, r, r).filter("n >= 3")

    def normals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = np.stack([p.xx, p.xy, p.xz, p.xy, p.yy, p.yz, p.xz, p.yz, p.zz], axis=1).reshape(-1, 3, 3)
            v = np.linalg.eigh(m)[1][:, :, 0]
            v = np.where(v[:, 2:] < 0, -v, v)
            yield p.assign(nx=v[:, 0], ny=v[:, 1], nz=v[:, 2])

    return g.mapInPandas(normals, "id long, n long, xx double, xy double, xz double, yy double, yz double, zz double, nx double, ny double, nz double")


def fitted_curve(points: DataFrame, key: str, step: float = 0.5, least: float = 10.0) -> DataFrame:
    """(key, i, x, y, z): points each ``step`` along the parabola fitted to a group's y over x, at the group's mean z.

    The curve spans the group's extent in x; a shorter one than ``least`` is laid about the mean of x.
    """
    fit = st.parabola_fit(points, "x", "y", key)
    g = points.groupBy(key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mx"), F.avg("z").alias("z"))
    n = F.floor((F.col("hi") - F.col("lo")) / step)
    short = n * step < least
    g = g.withColumn("start", F.when(short, F.col("mx") - least / 2).otherwise(F.col("lo"))).withColumn("n", F.when(short, F.lit(int(least / step))).otherwise(n).cast("long"))
    e = g.join(fit, key).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).withColumn("x", F.col("start") + step * F.col("i"))
    return e.select(key, "i", "x", (F.col("a") * F.col("x") * F.col("x") + F.col("b") * F.col("x") + F.col("c")).alias("y"), "z")
