"""Analytics over benchmark tables: best settings, speedups, losses of efficiency, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_config(runs: DataFrame, keys: list[str], settings: list[str], time: str) -> DataFrame:
    """Per key the settings of the least time; of equal times the smallest settings."""
    got = runs.groupBy(*keys).agg(F.min(F.struct(F.col(time).alias("t"), *settings)).alias("m"))
    return got.select(*keys, *[F.col(f"m.{s}").alias(s) for s in settings], F.col("m.t").alias(time))


def best_optimization(runs: DataFrame, name: str, time: str) -> DataFrame:
    """The variant of the least mean time, one row."""
    # decimals, so that the mean does not depend on the order of the sum
    means = runs.groupBy(name).agg(F.avg(F.col(time).cast("decimal(20,10)")).cast("double").alias("mean"))
    return means.agg(F.min(F.struct("mean", name)).alias("m")).select(F.col(f"m.{name}").alias(name), F.col("m.mean").alias("mean"))


def speedup_vs_baseline(runs: DataFrame, baseline: str, name: str, item: str, time: str) -> DataFrame:
    base = runs.filter(F.col(name) == baseline).select(item, F.col(time).alias("_base"))
    return runs.join(base, item).select(name, item, (F.col("_base") / F.col(time)).alias("speedup"))


def speedup_vs_previous(runs: DataFrame, order: str, name: str, item: str, time: str) -> DataFrame:
    before = F.lag(time).over(Window.partitionBy(item).orderBy(order))
    return runs.select(name, item, (before / F.col(time)).alias("speedup"))


def percent_of_max(speedups: DataFrame, order: str, name: str, item: str) -> DataFrame:
    """Each step's share of its item's largest speedup, and how much it adds to the step before."""
    share = F.col("speedup") / F.max("speedup").over(Window.partitionBy(item)) * 100
    df = speedups.withColumn("percent", share)
    before = F.lag("percent").over(Window.partitionBy(item).orderBy(order))
    return df.select(name, item, "percent", (F.col("percent") - F.coalesce(before, F.lit(0.0))).alias("added"))


def efficiency_loss(runs: DataFrame, item: str, setting: str, time: str) -> DataFrame:
    """Best time over a setting's time, per item; then the mean over the items."""
    df = runs.withColumn("efficiency", F.min(time).over(Window.partitionBy(item)) / F.col(time))
    return df.groupBy(setting).agg(F.avg("efficiency").alias("efficiency"))


def cross_host_best(runs: DataFrame, host: str, name: str, time: str, variants: tuple[str, str]) -> DataFrame:
    """Mean time per host and variant, the worse of two given variants left out; of equals the second."""
    means = runs.groupBy(host, name).agg(F.avg(time).alias("mean"))
    pair = means.filter(F.col(name).isin(*variants))
    better = pair.groupBy(host).agg(F.min(F.struct("mean", name)).alias("m")).select(host, F.col(f"m.{name}").alias("_keep"))
    return means.join(better, host, "left").filter(~F.col(name).isin(*variants) | (F.col(name) == F.col("_keep"))).drop("_keep")
