"""LAS files by ranges of records, and options files."""

import struct

import pytest
from pyspark.sql import functions as F

from swathe.operators.windows import Setting
from swathe.sources import las, las_source, options


def test_files_are_split_and_columns_chosen(spark, tmp_path):
    path = str(tmp_path / "cloud")
    p = spark.range(25_000).select("id", (F.col("id") / 100 - 50).alias("x"), (F.col("id") % 977 * 0.25).alias("y"), (-F.col("id") * 3.0).alias("z"), (F.col("id") % 65536).cast("int").alias("intensity"), (F.col("id") % 32).cast("int").alias("classification"))
    las_source.write_las(p.coalesce(2), path, most=9_000)
    files = las_source.las_files(*las_source.opened(path))
    heads = [open(f, "rb").read(227) for f in files]
    assert sum(struct.unpack_from("<I", h, 107)[0] for h in heads) == 25_000 and max(struct.unpack_from("<I", h, 107)[0] for h in heads) == 9_000
    df = las_source.scan_las(spark, path, records=1000)
    assert df.rdd.getNumPartitions() >= 25
    got = df.collect()
    assert sorted(r.id for r in got) == list(range(25_000))
    key = lambda r: (round(r.x, 6), round(r.y, 6), round(r.z, 6), r.intensity, r.classification)
    assert sorted(map(key, got)) == sorted(map(key, p.collect()))
    for f, h in zip(files, heads, strict=True):  # the header's box is that of its points
        own = [r for r in got if r.file == f]
        box = struct.unpack_from("<6d", h, 179)
        assert box == pytest.approx((max(r.x for r in own), min(r.x for r in own), max(r.y for r in own), min(r.y for r in own), max(r.z for r in own), min(r.z for r in own)))
    assert las_source.scan_las(spark, path, ["z", "id"], 7000).columns == ["z", "id"]
    assert las_source.scan_las(spark, f"file://{path}", ["z"]).agg(F.sum("z")).first()[0] == pytest.approx(p.agg(F.sum("z")).first()[0])
    one = {(r.x, r.y, r.z, r.intensity) for r in las.read_las(spark, f"{path}/*.las").collect()}  # what Spark alone reads
    assert one == {(r.x, r.y, r.z, r.intensity) for r in got}


def test_las_modes_and_errors(spark, tmp_path):
    path = str(tmp_path / "cloud")
    p = spark.createDataFrame([(1.0, 2.0, 3.0), (1.5, 2.5, 3.5)], "x double, y double, z double")
    las_source.write_las(p, path)
    las_source.write_las(p, path, mode="append")
    assert las_source.scan_las(spark, path).count() == 4
    las_source.write_las(p, path)
    assert las_source.scan_las(spark, path, ["x", "y", "z", "intensity"]).collect() and las_source.scan_las(spark, path).count() == 2
    las_source.write_las(p.limit(0), path)
    assert las_source.scan_las(spark, path).count() == 0
    for bad in ([(1e30, 0.0, 0.0)], [(None, 0.0, 0.0)]):
        with pytest.raises(Exception, match="beyond what a scale"):
            las_source.write_las(spark.createDataFrame(bad, p.schema), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="needs"):
        las_source.write_las(p.drop("z"), str(tmp_path / "bad"))
    (tmp_path / "text.las").write_bytes(b"PDF" * 200)
    with pytest.raises(Exception, match="no LAS file"):
        las_source.scan_las(spark, str(tmp_path / "text.las")).count()


def test_options(spark, tmp_path):
    file = tmp_path / "options.txt"
    file.write_text("# a comment\n\nwindow-size 8 and a comment\noverlap   0.5\ngrid-size 4\nexact true\noutput-dir /tmp/out\nl-pi 3.14\noverlap 0.75\n")
    got = options.read_options(spark, str(file))
    assert got.setting == Setting(w=8, b=4, o=0.75, exact=True) and got.values["output-dir"] == "/tmp/out" and got.values["l-pi"] == 3.14
    options.write_options(spark, got, str(tmp_path / "again"))
    assert options.read_options(spark, str(tmp_path / "again")).values == got.values
    file.write_text("verbosity 1\n")
    assert options.read_options(spark, str(file)).setting == Setting()
    file.write_text("overlap 1.5\nwindow-size ten\nwindow 3\n\ngrid-size\ngrid-size -1\nexact maybe\n")
    with pytest.raises(options.OptionsError) as e:
        options.read_options(spark, str(file))
    assert [n for n, _ in e.value.errors] == [1, 2, 3, 5, 6, 7] and "overlap must be in [0, 1)" in str(e.value)
