"""Language identification by Bayesian fusion of text and address evidence.

For each row: log P(text | language) from hashed byte trigrams (naive Bayes, fitted on a bounded sample of rows with a declared
language, tempered so that a text counts as ``EVIDENCE`` trigrams at most), plus log P(declared markup language | language), plus
log P(language | host). The host prior is smoothed by its address suffix, and that by the corpus. All three tables are grouped counts
over every row, made from the rows whose text alone is decisive. Missing evidence counts as none. A row's own declared language never
shapes its text evidence: there are two sets of trigram counts, of two halves of the rows by hash, and each half is judged by the other's.

The suffix of a host is what follows its last dot; bare names without one (``src12``) are grouped by what is left without the digits at their end.

A row is rejected if it has no letters or its best language has a posterior under ``least``.

Defined cases: a null or empty text has no text evidence and is rejected; null or empty declared languages and hosts give no evidence. Repeated rows
each give a row and count each; null ids are kept. Languages declared in less than ``SUPPORT`` of the sample are one class, ``other``, so the
tables are bounded at any number of declared values (a value still gives its own evidence); rows of that class are not rejected for it. Of equal posteriors the alphabetically first language wins. Without any row with a declared
language nothing can be told and all rows are rejected. Empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, materialize, row_hash, small, small_batches, table

SAMPLE_ROWS = 4000
SUPPORT = 0.005  # of the sample's rows; at most 200 languages can have it
OTHER = "other"
BINS = 1 << 16
EVIDENCE = 60
SCHEMA = "key long, id string, declared string, host string, suffix string, loglik array<double>, letters long"


def trigrams(text: str) -> np.ndarray:
    """Bin numbers of the byte trigrams of a lower-cased text with its non-letters as spaces."""
    b = np.frombuffer(b"  " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    b = np.where((b >= 97) & (b <= 122) | (b >= 128), b, np.uint8(32)).astype(np.uint32)
    # a trigram of spaces says nothing
    g = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    return ((g ^ (g >> np.uint32(15))) & np.uint32(BINS - 1))[(b[:-2] != 32) | (b[1:-1] != 32)]


def _hash(text: Column, order: Column) -> Column:
    return F.xxhash64(order.cast("string"), text)


def fit(docs: DataFrame, text: Column, declared: Column, order: Column, sample_rows: int = SAMPLE_ROWS, support: float = SUPPORT) -> tuple[list[str], np.ndarray]:
    """Languages and a (2, bins, languages) table of log probabilities, one for each half of the rows, from the ``sample_rows`` rows of least hash (and those of the same hash as the last).

    Trigrams are counted where the texts are; only sums by half, language and bin come to the driver. Languages below ``support`` of the sample are counted as ``OTHER``.
    """
    small_batches(docs.sparkSession)
    known = docs.select(text.alias("text"), declared.alias("lang"), _hash(text, order).alias("h")).filter("lang is not null and lang <> '' and text is not null")
    first = known.select("h", "lang").orderBy("h", "lang").limit(sample_rows).groupBy("lang").agg(F.count("*").alias("n"), F.max("h").alias("last")).collect()
    last, total = max((r.last for r in first), default=0), sum(r.n for r in first)
    frequent = [r.lang for r in first if r.n >= support * total]  # 1 / support at most
    lang = F.when(F.col("lang").isin(frequent), F.col("lang")).otherwise(OTHER)
    sample = known.filter(F.col("h") <= F.lit(last)).select("text", lang.alias("lang"), F.col("h").bitwiseAND(F.lit(1)).cast("int").alias("half"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (lang, half), own in pdf.groupby(["lang", "half"]).text:
                sums = np.zeros(BINS)
                for t in own:
                    sums += np.bincount(trigrams(t), minlength=BINS) / max(1.0, len(t) / 2000)
                bins = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "half": half, "bin": bins.astype(np.int32), "n": sums[bins]})

    got = sample.mapInPandas(count, "lang string, half int, bin int, n double").groupBy("lang", "half", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got.lang.unique())
    counts = np.full((2, BINS, max(1, len(langs))), 0.1)
    counts[got.half, got.bin, np.searchsorted(langs, got.lang) if langs else got.bin] += got.n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def suffix_of(host: Column) -> Column:
    """The group of a host: its last label, or a bare name without the digits at its end; null without a host."""
    bare = F.regexp_replace(host, "[0-9]+$", "")
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).when(bare != "", bare)


def text_evidence(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: dict[str, Column], key: Column) -> DataFrame:
    """One slim row per row of ``docs``: key, id, declared, host, suffix, tempered log likelihoods, number of letter trigrams."""
    langs, logs = model
    small_batches(docs.sparkSession)
    half = _hash(columns["text"], columns["id"]).bitwiseAND(F.lit(1)).cast("int")
    base = docs.select(key.alias("key"), as_text(columns["id"]).alias("id"), columns["declared"].alias("declared"), columns["host"].alias("host"), columns["text"].alias("text"), half.alias("half"))
    base = base.withColumn("suffix", suffix_of(F.col("host")))
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = shared.value
        for pdf in batches:
            loglik, letters = [], []
            for t, h in zip(pdf.text, pdf.half, strict=True):
                logp = both[1 - h]  # counted on the other half
                g = trigrams(t) if isinstance(t, str) else np.zeros(0, np.uint32)
                total = np.zeros(logp.shape[1])
                for i in range(0, len(g), 1 << 16):
                    total += logp[g[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
                total *= min(1.0, EVIDENCE / max(1, len(g)))
                loglik.append(total - total.max())
                letters.append(len(g))
            yield pd.DataFrame({"key": pdf.key, "id": pdf.id, "declared": pdf.declared, "host": pdf.host, "suffix": pdf.suffix, "loglik": loglik, "letters": letters})

    kind = docs.select(columns["id"].alias("id")).schema[0].dataType
    return base.mapInPandas(run, SCHEMA).withColumn("id", F.col("id").cast(kind))


def fuse(rows: DataFrame, langs: list[str], alpha: float = 20.0, beta: float = 20.0, gamma: float = 10.0, decisive: float = 3.0, least: float = 0.5) -> DataFrame:
    """``rows`` of ``text_evidence`` with ``text_lang``, ``lang``, ``posterior`` and ``rejected``."""
    if not langs:
        return rows.select("key", "id", "declared", "host", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(True).alias("rejected"))
    n = len(langs)
    best = F.when(F.col("letters") > 0, F.array_position("loglik", F.array_max("loglik")).cast("int") - 1)
    # the best leads the second by ``decisive``
    sure = F.element_at(F.array_sort("loglik"), -2) < -decisive if n > 1 else F.lit(True)
    rows = rows.withColumn("best", best).withColumn("sure", sure & best.isNotNull())
    cells = materialize(rows.filter("sure").groupBy("host", "suffix", "declared", "best").agg(F.count("*").alias("n")))
    sums = [F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(n)]
    total = cells.agg(*sums).first()
    overall = [((total[i] or 0) + 1) / (sum(x or 0 for x in total) + n) for i in range(n)]

    def smooth(prefix: str, prior: list[Column], strength: float) -> list[Column]:
        every = reduce(Column.__add__, [F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) for i in range(n)])
        return [(F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) + strength * prior[i]) / (every + strength) for i in range(n)]

    rename = lambda df, to: df.select(*[F.col(c).alias(f"{to}{c[1:]}" if c[0] == "n" and c[1:].isdigit() else f"{to}_key") for c in df.columns])
    by_suffix = rename(cells.filter("suffix is not null").groupBy("suffix").agg(*sums), "s")
    by_host = materialize(cells.filter("host is not null").groupBy("host", "suffix").agg(*sums).join(small(materialize(by_suffix), 50_000), F.col("suffix") == F.col("s_key"), "left").select(F.col("host").alias("h_key"), *[F.log(c).alias(f"h{i}") for i, c in enumerate(smooth("n", smooth("s", [F.lit(p) for p in overall], beta), alpha))]))
    by_declared = materialize(rename(cells.filter("declared is not null and declared <> ''").groupBy("declared").agg(*sums), "d"))
    kinds = max(1, by_declared.count())
    tallied = by_declared.agg(*[F.sum(f"d{i}").alias(f"t{i}") for i in range(n)]).first()
    # P(declared | language)
    by_declared = by_declared.select("d_key", *[F.log((F.col(f"d{i}") + gamma / kinds) / ((tallied[i] or 0.0) + gamma)).alias(f"e{i}") for i in range(n)])
    joined = rows.join(small(by_host, 100_000), F.col("host") == F.col("h_key"), "left").join(small(by_declared, 50_000), F.col("declared") == F.col("d_key"), "left")
    logs = [F.when(F.col("letters") > 0, F.element_at("loglik", i + 1)).otherwise(0.0) + F.coalesce(F.col(f"h{i}"), F.lit(float(np.log(overall[i])))) + F.coalesce(F.col(f"e{i}"), F.lit(0.0)) for i in range(n)]
    joined = joined.withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    joined = joined.withColumn("posterior", F.round(1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))), 6))
    name = F.array(*[F.lit(x) for x in langs])
    chosen = F.element_at(name, F.array_position("logs", F.col("top")).cast("int"))
    rejected = (F.col("letters") == 0) | (F.col("posterior") < least)
    return joined.select("key", "id", "declared", "host", F.when(F.col("best").isNotNull(), F.element_at(name, F.col("best") + 1)).alias("text_lang"), F.when(~rejected, chosen).alias("lang"), "posterior", rejected.alias("rejected"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, key: Column | None = None) -> DataFrame:
    """key, id, declared, host, text_lang, lang, posterior, rejected of every row."""
    declared = F.col("lang") if declared is None else declared
    host = F.col("source") if host is None else host
    model = fit(docs, F.col(text_col), declared, F.col(id_col))
    rows = materialize(text_evidence(docs, model, {"id": F.col(id_col), "text": F.col(text_col), "declared": declared, "host": host}, F.lit(0).cast("long") if key is None else key))
    return fuse(rows, model[0])


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language can't be told; all columns are kept."""
    key = row_hash("doc_id", "text", "lang", "source")
    bad = materialize(identify(docs, key=key).filter("rejected").select(F.col("key").alias("_key")).distinct())
    return docs.join(small(bad, 500_000), key == bad["_key"], "left_anti")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, declared, text_lang, lang, posterior, rejected of every document."""
    got = identify(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "declared", "text_lang", "lang", "posterior", "rejected")


QUERIES = {"op8_language": op8_language}
ORACLES: dict[str, str] = {}
