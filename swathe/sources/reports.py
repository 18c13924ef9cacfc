"""Readers of benchmark reports, run logs and tree statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import numbered

REPORT = "ExecName string, InputFile string, NumThreads int, MinRadius double, MaxNumber int, Level int, TreeTime double, OwmTime double, Correctness double"
SUMMARY = "Optimization string, Cloud string, TimeTree double, TimeOWM double, Level int, MinRadMaxNum double"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A space-separated run report."""
    return spark.read.csv(path, sep=" ", header=True, schema=REPORT)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon-separated summary of optimisations."""
    return spark.read.csv(path, sep=";", header=True, schema=SUMMARY)


def read_tokens(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """White-space separated records without a header."""
    t = F.split(F.trim(F.col("value")), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(*[F.get(t, F.lit(i)).alias(n) for i, n in enumerate(names)])


def _carried(lines: DataFrame, mark) -> DataFrame:
    """Each line with the last value of ``mark`` at or before it; a file's lines are one sequence."""
    w = Window.partitionBy("file").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(mark, ignorenulls=True).over(w))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, run, seconds): in a log the line ``Running: <name>`` names the times on the lines after it."""
    lines = numbered(spark, path)
    name = F.regexp_extract("value", r"^Running:\s*(.*\S)\s*$", 1)
    got = _carried(lines, F.when(name != "", name))
    seconds = F.regexp_extract("value", r"([0-9]+(?:\.[0-9]+)?)\s*(?:s|seconds)?\s*$", 1).try_cast("double")
    return got.filter(name == "").filter(seconds.isNotNull() & F.col("section").isNotNull()).select("file", F.col("section").alias("run"), seconds.alias("seconds"))


def read_tree_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, value, leaves): rows of numbers under their section's heading line."""
    lines = numbered(spark, path)
    words = F.split(F.trim(F.col("value")), r"\s+")
    value, leaves = F.get(words, F.lit(0)).try_cast("double"), F.get(words, F.lit(1)).try_cast("long")
    heading = F.when(value.isNull() & (F.trim("value") != ""), F.trim("value"))
    return _carried(lines, heading).filter(value.isNotNull() & leaves.isNotNull()).select("file", "section", value.alias("number"), leaves.alias("leaves"))
