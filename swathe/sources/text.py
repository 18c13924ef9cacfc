"""Text files of points: readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import header as header_of

#: part of the file's name, number of points, minx, maxx, miny, maxy, minz, maxz of clouds without a header record; fixed values, null where not published
CATALOG = [
    ("INAER_2011_Alcoy.xyz", 2772832, 715244.96, 716057.75, 4286623.63, 4287447.70, 836.424, 976.790),
    ("INAER_2011_Alcoy_Core.xyz", 20380212, 714947.98, 716361.06, 4286501.93, 4288406.23, 830.381, 991.516),
    ("INAER_2011_Alcoy_CoreX2.xyz", 40760424, 714947.98, 716361.06, 4286501.93, 4288406.23, 830.381, 991.516),
    ("INAER_2011_Alcoy_CoreX4.xyz", 81520848, 714947.98, 716361.06, 4286501.93, 4288406.23, 830.381, 991.516),
    ("INAER_2011_Alcoy_CoreX6.xyz", 122281272, 714947.98, 716361.06, 4286501.93, 4288406.23, 830.381, 991.516),
    ("INAER_2011_Alcoy_CoreX8.xyz", 163041696, 714947.98, 716361.06, 4286501.93, 4288406.23, 830.381, 991.516),
    ("BABCOCK_2017_Arzua_3B.xyz", 40706503, 568000.00, 568999.99, 4752320.00, 4753319.99, 331.620, 495.630),
    ("V21_group1_densified_point_cloud.xyz", 42384876, 526964.093, 527664.647, 4742610.292, 4743115.738, 38.656, 112.269),
    ("V19_group1_densified_point_cloud.xyz", 48024480, 526955.908, 527686.445, 4742586.025, 4743124.373, 38.150, 119.833),
    ("sample24.xyz", 7492, 513748.12, 513869.97, 5403124.76, 5403197.20, None, None),
]
CATALOG_SCHEMA = "part string, n long, minx double, maxx double, miny double, maxy double, minz double, maxz double"


def _tokens(sep: str) -> Column:
    return F.split(F.trim(F.regexp_replace("value", sep, " ")), " ")


def _double(c: Column) -> Column:
    return c.try_cast("double")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, file and 0-based ``id`` of every line, in the order of file names and of the lines in a file.

    Files are read in blocks; lines are numbered in their block's task, and the blocks' first numbers come from their counts (a row
    for each block).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    counts = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    firsts = counts.select("file", "_block", "_low", (F.sum("_n").over(Window.orderBy("file", "_block")) - F.col("_n")).alias("_before"))
    return lines.join(firsts, ["file", "_block"]).select("value", "file", (F.col("_before") + F.col("_at") - F.col("_low")).alias("id"))


def read_xyz(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """id, x, y, z of a white-space separated file; further columns are ignored and the id is the line's number among the points.

    With ``header`` the first record (n, minx, maxx, miny, maxy) is left out. Lines without three numbers are dropped; ``malformed_lines`` has them.
    """
    return _lines(spark, path, header).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("id", "x", "y", "z")


def malformed_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """id and text of the lines that ``read_xyz`` drops."""
    return _lines(spark, path, header).filter("x IS NULL OR y IS NULL OR z IS NULL").select("id", "value")


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    t = _tokens(r"\s+")
    p = numbered(spark, path).select("id", "value", *[_double(F.get(t, F.lit(i))).alias(n) for i, n in enumerate("xyz")])
    return p.filter("id > 0").withColumn("id", F.col("id") - 1) if header else p


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """n, minx, maxx, miny, maxy of the first record of a file, or of the first file of a folder; only first blocks are read."""
    t = _tokens(r"\s+")
    names = ["n", "minx", "maxx", "miny", "maxy"]
    lines = spark.read.text(path).filter("_metadata.file_block_start = 0").select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    first = lines.orderBy("_file", "_at").limit(1)
    return first.select(F.get(t, F.lit(0)).cast("double").cast("long").alias("n"), *[_double(F.get(t, F.lit(i + 1))).alias(n) for i, n in enumerate(names[1:])])


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, intensity separated by spaces, commas or tabs; rows that lack one are dropped."""
    t = _tokens("[ ,\\t]+")
    names = ["x", "y", "z", "intensity"]
    rows = spark.read.text(path).select(*[_double(F.get(t, F.lit(i))).alias(n) for i, n in enumerate(names)])
    return rows.dropna().withColumn("intensity", F.col("intensity").cast("int"))


def catalog_header(spark: SparkSession, name: str, catalog: list[tuple] | None = None) -> DataFrame:
    """The header of a cloud known by a part of its file's name; no row if it is unknown."""
    c = spark.createDataFrame(catalog or CATALOG, CATALOG_SCHEMA)
    return c.filter(F.lit(name).contains(F.col("part"))).drop("part")


def with_catalog(files: DataFrame, catalog: list[tuple] | None = None) -> DataFrame:
    """``files`` (file) with the catalog's header of each; null for unknown ones."""
    c = files.sparkSession.createDataFrame(catalog or CATALOG, CATALOG_SCHEMA)
    return files.join(F.broadcast(c), F.contains(F.col("file"), F.col("part")), "left").drop("part")  # a catalog is a literal table


def _fixed(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c))


def write_xyz(points: DataFrame, path: str, digits: int = 2, mode: str = "error", header: bool = False) -> None:
    """``x y z`` with fixed decimals; ``mode="append"`` adds to what is there. With ``header`` the first record of the first file is the cloud's header."""
    lines = points.select(F.concat_ws(" ", *[_fixed(c, digits) for c in "xyz"]).alias("value"))
    if header:
        lines = _header_line(header_of(points)).union(lines)
    lines.write.mode(mode).text(path)


def write_full(points: DataFrame, path: str, mode: str = "append") -> None:
    """``x y z`` in full precision, rows without an id left out."""
    points.filter("id IS NOT NULL").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"])).write.mode(mode).text(path)


def write_classified(points: DataFrame, path: str, mode: str = "error") -> None:
    """x, y, z with three decimals, intensity and group, separated by tabs."""
    cells = [*[_fixed(c, 3) for c in "xyz"], F.col("intensity").cast("string"), F.col("g_id").cast("string")]
    points.select(F.concat_ws("\t", *cells)).write.mode(mode).text(path)


def _header_line(head: DataFrame) -> DataFrame:
    cells = [F.col("n").cast("string"), *[_fixed(c, 2) for c in ("minx", "maxx", "miny", "maxy")]]
    return head.select(F.concat_ws(" ", *cells).alias("value"))


def write_header(head: DataFrame, path: str) -> None:
    """A cloud's header as a text record."""
    _header_line(head).coalesce(1).write.text(path)


def write_report(runs: DataFrame, path: str) -> None:
    """Appends runs to a space-separated report; every part file has a header line of its own."""
    runs.write.mode("append").option("sep", " ").option("header", True).csv(path)


def write_histogram(hist: DataFrame, path: str) -> None:
    """A histogram with each value's product with its count."""
    value, count = hist.columns
    hist.select(F.concat_ws(" ", F.col(value).cast("string"), F.col(count).cast("string"), (F.col(value) * F.col(count)).cast("string"))).write.text(path)


def write_statistics(histograms: dict[str, DataFrame], path: str) -> None:
    """A report of histograms in one file: a heading for each, then its values with their counts, in order, then an empty line.

    A histogram has a row for each different value, so the report is small.
    """
    parts = []
    for k, (name, hist) in enumerate(histograms.items()):
        spark = hist.sparkSession
        value, count = hist.columns
        parts.append(spark.range(1).select(F.lit(k).alias("part"), F.lit(0).alias("place"), F.lit(0.0).alias("v"), F.lit(name).alias("value")))
        parts.append(hist.select(F.lit(k), F.lit(1), F.col(value).cast("double"), F.concat_ws(" ", F.col(value).cast("string"), F.col(count).cast("string"))))
        parts.append(spark.range(1).select(F.lit(k), F.lit(2), F.lit(0.0), F.lit("")))
    reduce(DataFrame.union, parts).coalesce(1).sortWithinPartitions("part", "place", "v").select("value").write.text(path)


def write_leaf_centres(leaves: DataFrame, path: str, also_empty: bool = False) -> None:
    """Centre and radius of each tree leaf (x, y, radius, n), separated by tabs, two decimals."""
    kept = leaves if also_empty else leaves.filter("n > 0")
    kept.select(F.concat_ws("\t", *[_fixed(c, 2) for c in ("x", "y", "radius")])).write.text(path)


def write_leaf_points(points: DataFrame, path: str, key: str = "key") -> None:
    """id, x, y, z of points with their leaf's ``key``, a leaf's points together and in order, separated by tabs, two decimals."""
    lines = F.concat_ws("\t", F.col("id").cast("string"), *[_fixed(c, 2) for c in "xyz"])
    points.repartitionByRange(key, "id").sortWithinPartitions(key, "id").select(lines).write.text(path)
