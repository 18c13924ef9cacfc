"""Line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathe.llm import lines


def brute(rows, least=10):
    """(id, n_lines, n_dropped, kept text) of each (id, text)."""
    key = lambda line: re.sub("[A-Z]", lambda c: c[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in rows:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= least and i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        keep = [len(key(s)) < least or key(s) not in first or first[key(s)] == i for s in own]
        out.append((i, len(own), len(own) - sum(keep), "\n".join(s for s, k in zip(own, keep, strict=True) if k)))
    return out


def cases(seed):
    r = random.Random(seed)
    common = ["A line that all documents share", "  a line that ALL documents share\t", "short", "", "   ", "zehn Zeichen ä", "\x0cİstanbul is not lower-cased\r", "x" * 9, "y" * 10, " no-break space stays at the ends "]
    rows = []
    for i in range(60):
        own = [r.choice(common) if r.random() < 0.6 else f"line {r.randint(0, 30)} of its own kind" for _ in range(r.randint(1, 12))]
        rows.append((i * 7 % 61, "\n".join(own)))
    rows += [(None, "A line that all documents share\nonly without an id, twice over"), (None, "only without an id, twice over"), (5, None), (6, ""), (7, "\n\n")]
    rows += [(3, "A line that all documents share\nof a repeated id, long enough"), (3, "of a repeated id, long enough"), rows[0], rows[1]]
    rows.append((900, "\n".join(f"a very long document's line {k % 3000}" for k in range(9000))))
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_by_brute_force(spark, parts):
    rows = cases(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # with many ranges, one hash goes over several of them
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit("x")).withColumn("doc", F.lit(1)).withColumn("pos", F.lit(2))
        got = lines.with_keep(df.withColumnRenamed("keep", "n_lines_of").repartition(5))
        found = got.select("doc_id", "n_lines", "n_dropped", lines.kept_text(F.col("text"), F.col("n_lines"), F.col("n_dropped"), F.col("keep")).alias("kept")).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))
        assert [c for c in got.columns if c.startswith("_")] == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_line_in_every_document_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        df = spark.range(3, 4003).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line for all\nown line of number "), "id").alias("text"))
        got = lines.keep_bitmaps(df)
        assert got.columns == ["id", "n_lines", "n_dropped", "keep"]
        n = {r.id: r.n_dropped for r in got.collect()}
        assert n[3] == 0 and sum(n.values()) == 3999 and max(n.values()) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bitmaps_round_trip():
    r = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000):
        lost = np.flatnonzero(r.random(n) < 0.3)
        data = lines.bitmap(n, lost)
        assert (np.flatnonzero(~lines.kept_lines(data, n)) == lost).all()
    assert len(lines.bitmap(100_000, np.zeros(0, np.int64))) < 200


def test_no_documents_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.with_keep(empty).collect() == []
    df = spark.createDataFrame([("b", "the very same line"), ("a", "the very same line")], "name string, body string")
    assert {r.id: r.n_dropped for r in lines.keep_bitmaps(df, "name", "body").collect()} == {"a": 0, "b": 1}


def test_query_digest(spark, tables):
    sf = tables(documents=[(1, "one line for both\nown", "en", "s", 3), (2, "One line for both", "en", "s", 3), (3, None, None, None, None)], extra=True)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.op12_lines(spark, sf).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 0, sha("one line for both\nown")), 2: (1, 1, sha("")), 3: (1, 0, sha(""))}
