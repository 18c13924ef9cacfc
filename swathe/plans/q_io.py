"""Queries that write files and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import shared_dir
from ..operators import index as ix
from ..operators import stats as st
from ..operators.windows import header
from ..sources import las_source, options, reports, text
from ..sources.cloud import POINTS_SQL, points
from . import q_index, q_stats, q_windows
from .seeds import seed_points


def _xyz(spark, d):
    path = shared_dir(spark)
    text.write_xyz(points(spark, d), path, 2)
    return text.read_xyz(spark, path).select("x", "y", "z")


def _classified(spark, d):
    path = shared_dir(spark)
    text.write_classified(points(spark, d), path)
    t = F.split("value", "\t")
    return spark.read.text(path).select(*[F.get(t, F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate((("x", "double"), ("y", "double"), ("z", "double"), ("intensity", "int"), ("g_id", "int")))])


def _header(spark, d):
    path = shared_dir(spark)
    text.write_header(header(points(spark, d)), path)
    return text.read_header(spark, path)


def _delimited(spark, d):
    path = shared_dir(spark)
    points(spark, d).select(F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"), F.col("z").cast("string"), F.col("intensity").cast("string"))).write.text(path)
    return text.read_delimited(spark, path)


def _report(spark, d):
    path = shared_dir(spark)
    rows = q_stats.runs(spark, d).select(F.col("opt").alias("ExecName"), F.col("cloud").alias("InputFile"), F.col("ord").alias("NumThreads"), F.lit(0.1).alias("MinRadius"), F.lit(32).alias("MaxNumber"), F.lit(5).alias("Level"), F.col("tree").alias("TreeTime"), F.col("owm").alias("OwmTime"), F.lit(100.0).alias("Correctness"))
    text.write_report(rows, path)
    return reports.read_report(spark, path).select(F.col("ExecName").alias("opt"), F.col("InputFile").alias("cloud"), F.col("TreeTime").alias("tree"), F.col("OwmTime").alias("owm"))


def _xyz_header(spark, d):
    path = shared_dir(spark)
    text.write_xyz(points(spark, d), path, 2, header=True)
    got = text.read_xyz(spark, path, header=True)
    return got.select("x", "y", "z").crossJoin(F.broadcast(text.read_header(spark, path).select("n")))


def _full(spark, d):
    """Two writes, the second appended; rows without an id are left out."""
    path = shared_dir(spark)
    p = points(spark, d)
    text.write_full(p.filter("id % 3 <> 0"), path)
    text.write_full(p.withColumn("id", F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, F.col("id")))), path)
    return text.read_xyz(spark, path).select("x", "y", "z")


def _catalog(spark, d):
    """A file for each supplier, one in turn of those that the catalog knows and one that it does not."""
    names = [f"/data/{r[0]}" for r in text.CATALOG] + ["/data/unknown.xyz"]
    suppliers = spark.read.parquet(f"{d}/supplier.parquet")
    files = suppliers.select("s_suppkey", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % len(names) + 1).cast("int")).alias("file"))
    return text.with_catalog(files)


def _malformed(spark, d):
    path = shared_dir(spark)
    xyz = F.concat_ws(" ", *[F.format_string("%.2f", F.col(c)) for c in "xyz"])
    points(spark, d).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("broken "), F.col("id").cast("string"))).otherwise(xyz)).write.text(path)
    return text.malformed_lines(spark, path).select(F.col("value").alias("line"))


def _summary(spark, d):
    path = shared_dir(spark)
    rows = q_stats.runs(spark, d).select(F.col("opt").alias("Optimization"), F.col("cloud").alias("Cloud"), F.col("tree").alias("TimeTree"), F.col("owm").alias("TimeOWM"), F.col("ord").alias("Level"), F.lit(0.5).alias("MinRadMaxNum"))
    rows.write.option("sep", ";").option("header", True).csv(path)
    return reports.read_summary(spark, path).select(F.col("Optimization").alias("opt"), F.col("Cloud").alias("cloud"), F.col("TimeTree").alias("tree"), F.col("TimeOWM").alias("owm"), F.col("Level").alias("ord"))


def _tokens(spark, d):
    path = shared_dir(spark)
    q_stats.sweep(spark, d).select(F.concat_ws("  ", "host", "cloud", F.col("threads").cast("string"), F.col("seconds").cast("string"))).write.text(path)
    got = reports.read_tokens(spark, path, ["host", "cloud", "threads", "seconds"])
    return got.withColumn("threads", F.col("threads").cast("int")).withColumn("seconds", F.col("seconds").cast("double"))


def _log(spark, d):
    """A log with a heading and its times for each setting of the sweep."""
    path = shared_dir(spark)
    s = q_stats.sweep(spark, d)
    name = F.concat_ws(" ", "host", "cloud", F.col("threads").cast("string"), F.col("radius").cast("string"))
    lines = s.select(F.concat(F.lit("Running: "), name, F.lit("\n  Stage1 time elapsed: "), F.col("seconds").cast("string"), F.lit(" s\nnothing here\nTotal KERNEL time: "), (F.col("seconds") * 2).cast("string")))
    lines.write.text(path)
    return reports.read_run_log(spark, path).select("run", "seconds")


def _statistics(spark, d):
    path = shared_dir(spark)
    leaves = q_index.leaves(spark, d)
    text.write_statistics({"Points histogram": st.histogram(leaves, F.col("n"), "n"), "Level histogram": st.histogram(leaves, F.col("level"), "level")}, path)
    return reports.read_tree_statistics(spark, path).select("section", F.col("number").cast("long").alias("number"), "leaves")


def _histogram(spark, d):
    path = shared_dir(spark)
    text.write_histogram(st.histogram(q_index.leaves(spark, d), F.col("n"), "n"), path)
    got = reports.read_tokens(spark, path, ["n", "leaves", "product"])
    return got.select(*[F.col(c).cast("long").alias(c) for c in got.columns])


def _dump_centres(spark, d):
    path = shared_dir(spark)
    p = points(spark, d)
    text.write_leaf_centres(ix.leaf_centres(q_index.leaves(spark, d), header(p)), path)
    got = reports.read_tokens(spark, path, ["x", "y", "radius"])
    return got.select(*[F.col(c).cast("double").alias(c) for c in got.columns])


def _dump_points(spark, d):
    path = shared_dir(spark)
    text.write_leaf_points(ix.with_keys(points(spark, d), 6), path)
    got = reports.read_tokens(spark, path, ["id", "x", "y", "z"])
    return got.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])


def _las(spark, d):
    """Large files, each read by many tasks."""
    path = shared_dir(spark)
    las_source.write_las(points(spark, d).select("x", "y", "z", "intensity", F.col("g_id").alias("classification")), path, most=100_000)
    got = las_source.scan_las(spark, path, ["x", "y", "z", "intensity", "classification"], 10_000)
    return got.select(*[F.round(a, 6).alias(a) for a in "xyz"], "intensity", F.col("classification").alias("g_id"))


def _options(spark, d):
    path = shared_dir(spark)
    s = q_windows.S4
    options.write_options(spark, options.Options({"window-size": s.w, "grid-size": s.b, "overlap": s.o, "exact": s.exact, "verbosity": 1, "octree-min-radius": 0.1}), path)
    return seed_points(points(spark, d), options.read_options(spark, path).setting)


P = f"WITH p AS ({POINTS_SQL})"
QUERIES = {
    "las_roundtrip": _las, "options_roundtrip": _options,
    "xyz_roundtrip": _xyz, "classified_roundtrip": _classified, "header_roundtrip": _header, "delimited_roundtrip": _delimited, "report_roundtrip": _report,
    "xyz_header_roundtrip": _xyz_header, "full_precision_roundtrip": _full, "header_catalog": _catalog, "malformed_lines": _malformed, "summary_roundtrip": _summary, "tokens_roundtrip": _tokens,
    "run_log_roundtrip": _log, "statistics_roundtrip": _statistics, "histogram_roundtrip": _histogram, "leaf_centres_roundtrip": _dump_centres, "leaf_points_roundtrip": _dump_points,
}
ORACLES = {
    "las_roundtrip": P + " SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, intensity, g_id FROM p",
    "options_roundtrip": q_windows.ORACLES["owm_seed_points"],
    "xyz_roundtrip": P + " SELECT x, y, z FROM p",
    "classified_roundtrip": P + " SELECT x, y, z, intensity, g_id FROM p",
    "header_roundtrip": P + " SELECT count(*) AS n, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM p",
    "delimited_roundtrip": P + " SELECT x, y, z, intensity FROM p",
    "report_roundtrip": q_stats.RUNS_SQL + " SELECT opt, cloud, tree, owm FROM r",
    "xyz_header_roundtrip": P + " SELECT x, y, z, (SELECT count(*) FROM p) AS n FROM p",
    "full_precision_roundtrip": P + " SELECT x, y, z FROM p WHERE id % 3 <> 0 UNION ALL SELECT x, y, z FROM p WHERE id % 6 = 0",
    "header_catalog": "SELECT s_suppkey, t.* EXCLUDE (i) FROM supplier JOIN " + q_stats._values([(i, f"/data/{r[0]}", *r[1:]) for i, r in enumerate([*text.CATALOG, ("unknown.xyz", *[None] * 7)])]).replace("None", "NULL") + f" AS t(i, file, n, minx, maxx, miny, maxy, minz, maxz) ON t.i = s_suppkey % {len(text.CATALOG) + 1}",
    "malformed_lines": P + " SELECT 'broken ' || id AS line FROM p WHERE id % 100 = 0",
    "summary_roundtrip": q_stats.RUNS_SQL + " SELECT opt, cloud, tree, owm, ord FROM r",
    "tokens_roundtrip": q_stats.SWEEP_SQL + " SELECT host, cloud, threads, seconds FROM r",
    "run_log_roundtrip": q_stats.SWEEP_SQL + " SELECT host || ' ' || cloud || ' ' || threads || ' ' || CAST(radius AS VARCHAR) AS run, seconds * k AS seconds FROM r, (VALUES (CAST(1 AS DOUBLE)), (CAST(2 AS DOUBLE))) AS t(k)",
    "statistics_roundtrip": q_index._NODES + " SELECT 'Points histogram' AS section, n AS number, count(*) AS leaves FROM lf GROUP BY n UNION ALL SELECT 'Level histogram', level, count(*) FROM lf GROUP BY level",
    "histogram_roundtrip": q_index._NODES + ", h AS (SELECT n, count(*) AS leaves FROM lf GROUP BY n) SELECT n, leaves, n * leaves AS product FROM h",
    "leaf_centres_roundtrip": q_index._NODES + f", k AS (SELECT level, radius, {q_index._unbits('key', 0)} AS kx, {q_index._unbits('key', 1)} AS ky FROM lf WHERE n > 0) SELECT CAST(printf('%.2f', cx - geo.radius + (2 * kx + 1) * k.radius) AS DOUBLE) AS x, CAST(printf('%.2f', cy - geo.radius + (2 * ky + 1) * k.radius) AS DOUBLE) AS y, CAST(printf('%.2f', k.radius) AS DOUBLE) AS radius FROM k, geo",
    "leaf_points_roundtrip": P + " SELECT id, x, y, z FROM p",
}
