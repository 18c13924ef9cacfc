"""Line dedup: repeated lines are told by a range partition of their hashes, and each document gets a compressed bitmap of the lines it keeps.

A text's lines are what stands between its line feeds. A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends and with A-Z lower-cased. Of
a key that counts (``least`` code points or more), the document with the smallest id keeps all its lines, every other document loses them.

Lines are dealt by ranges of (hash, document, position), so a line that stands in a third of all documents is spread over many tasks. A task streams its
sorted rows and knows the first document of each hash but for the one that its range begins with: of that, and of its last one, it
notes the first document it has seen, two rows for each task. The least of those is the first document of a hash that goes over several ranges. What
leaves a task is the position of each repeated line, never its text. Keys are compared by 128 bits of hash.

Bitmaps hold one bit for each line, the first on the highest bit of the first byte, deflated. Documents are told by their id and a hash of their
text: rows that repeat both share their bitmap.

Defined cases: a null or empty text is one empty line. Rows of one id are one document: their lines do not repeat each other. A null id comes after all
others, and rows without an id are one document. Empty input gives no rows. Other columns are kept by ``with_keep`` as they are; names that begin
with ``_ld_`` are the operator's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, small_batches, table

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 10
#: what a task gives for a row: a repeated line, a line whose hash its range begins with, the first document of its first and last hash
REPEATED, OPEN, EDGE = 0, 1, 2


def bitmap(n: int, dropped: np.ndarray) -> bytes:
    """The keep bitmap of ``n`` lines without those at the ``dropped`` positions."""
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_lines(data: bytes, n: int) -> np.ndarray:
    """Which of ``n`` lines a bitmap keeps."""
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def _hash(c: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """h1, h2, doc, own (the text's hash) and pos of each line that counts."""
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(_text(text_col)).alias("own"), F.posexplode(F.split(_text(text_col), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "own", "pos", F.translate(F.btrim("line", F.lit(WHITE)), UPPER, LOWER).alias("key")).filter(F.char_length("key") >= least)
    return keyed.select(*[h.alias(f"h{k}") for k, h in enumerate(_hash(F.col("key")), 1)], "doc", "own", "pos")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted by (h1, h2, doc): repeated lines, open lines, and the two edges."""
    opening = last = None  # (h1, h2), and the last hash with its first document
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = batch["h1"].to_numpy(), batch["h2"].to_numpy(), batch["doc"]
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        starts = np.flatnonzero(new)
        firsts = doc.take(pa.array(starts))
        if last is not None and last[0] == (h1[0], h2[0]):
            firsts = pa.concat_arrays([last[1], firsts.slice(1)])
        if opening is None:
            opening = (h1[0], h2[0])
            yield _rows(EDGE, batch.slice(0, 1))
        first = firsts.take(pa.array(np.cumsum(new) - 1))
        # documents are sorted, nulls last: what is not the first one comes after it
        same = pc.or_kleene(pc.equal(doc, first), pc.and_(pc.is_null(doc), pc.is_null(first)))
        is_open = (h1 == opening[0]) & (h2 == opening[1])
        again = ~same.fill_null(False).to_numpy(zero_copy_only=False)
        for kind, mask in ((OPEN, is_open), (REPEATED, again & ~is_open)):
            if mask.any():
                yield _rows(kind, batch.filter(pa.array(mask)))
        last = ((h1[-1], h2[-1]), firsts.slice(len(firsts) - 1))
    if last is not None and last[0] != opening:
        one = pa.RecordBatch.from_arrays([pa.array([last[0][0]]), pa.array([last[0][1]]), last[1], pa.array([0], pa.int64()), pa.array([0], pa.int32())], ["h1", "h2", "doc", "own", "pos"])
        yield _rows(EDGE, one)


def _rows(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, kind, np.int8)), *batch.columns], ["kind", *batch.schema.names])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc, own, pos of every line that its document loses; a row for each copy of a document's row."""
    keys = materialize(line_keys(docs, id_col, text_col, least))
    order = [F.asc("h1"), F.asc("h2"), F.asc_nulls_last("doc"), F.asc("own"), F.asc("pos")]
    kind = keys.select("doc").schema[0].dataType.simpleString()
    seen = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, f"kind byte, h1 long, h2 long, doc {kind}, own long, pos int")
    seen = materialize(seen)
    # two rows for each range at most; a hash whose documents are all without an id has a null first
    edges = seen.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    later = F.col("first").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("first")))
    opened = seen.filter(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).filter(later)
    return seen.filter(F.col("kind") == REPEATED).select("doc", "own", "pos").unionByName(opened.select("doc", "own", "pos"))


def with_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with n_lines, n_dropped (longs) and ``keep``, the bitmap of each row's lines."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def bitmaps(n: pd.Series, dropped: pd.Series) -> pd.Series:
        none = np.zeros(0, np.int64)
        return pd.Series([bitmap(int(k), none if d is None else np.asarray(d, np.int64)) for k, d in zip(n, dropped, strict=True)], dtype=object)

    lost = repeated_lines(docs, id_col, text_col, least).groupBy("doc", "own").agg(F.collect_set("pos").alias("_ld_lost"))
    lost = small(materialize(lost.select(F.col("doc").alias("_ld_doc"), F.col("own").alias("_ld_of"), "_ld_lost")), 1_000_000)
    own = docs.select("*", F.xxhash64(_text(text_col)).alias("_ld_own"), F.size(F.split(_text(text_col), "\n", -1)).alias("_ld_n"))
    got = own.join(lost, F.col(id_col).eqNullSafe(F.col("_ld_doc")) & (F.col("_ld_own") == F.col("_ld_of")), "left")
    dropped = F.coalesce(F.size("_ld_lost"), F.lit(0)).cast("long")
    return got.select(*docs.columns, F.col("_ld_n").cast("long").alias("n_lines"), F.when(F.col("_ld_lost").isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"), bitmaps("_ld_n", "_ld_lost").alias("keep"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_lines, n_dropped and ``keep`` of each row; no text is shuffled."""
    got = with_keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", least)
    return got.select("id", "n_lines", "n_dropped", "keep")


def kept_text(text: Column, n_lines: Column, n_dropped: Column, keep: Column) -> Column:
    """The text without the lines that its bitmap drops; only texts that lose a line go through Python."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, n: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else "\n".join(np.asarray(t.split("\n"), object)[kept_lines(d, int(k))]) for t, k, d in zip(text, n, data, strict=True)], dtype=object)

    loses = n_dropped > 0
    return F.when(loses, cut(F.when(loses, text), n_lines, keep)).otherwise(F.coalesce(text, F.lit("")))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    got = with_keep(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = kept_text(F.col("text"), F.col("n_lines"), F.col("n_dropped"), F.col("keep"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


QUERIES = {"op12_lines": op12_lines}
ORACLES = {
    "op12_lines": f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT uid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {LEAST} GROUP BY key),
m AS (SELECT k.*, f.first IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id > f.first) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY uid"""
}
