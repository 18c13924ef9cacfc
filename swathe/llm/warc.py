"""WARC archives and transaction assembly.

Writing: each capture gives a request, a response or revisit, and a metadata record; request and metadata name
the payload record in WARC-Concurrent-To. Records are composed by SQL functions and written by the text sink, whose line end is the
CRLF CRLF that ends a WARC record, so payload bytes go out unchanged, gzipped, with Spark's commit protocol.
Reading: files come as binary rows and are parsed by Content-Length, a record at a time. Transactions: the secondary
records are aggregated by the identifier they are concurrent to, and joined to the payload records: one
nested row per capture. Secondaries that point to another secondary are first moved on to what that one points to.

Record ids come from the row, so captures with the same page_id, repeated rows among them, have records of their own.

Defined cases: a null html is an empty payload; a null url gives no target URI; a null page_id stays null and counts as
smaller than any id; equal payloads of which none has an id are all responses. Rows with the same page_id and payload as the largest are all responses, and the first of them is referred to. If a capture has several requests or
metadata records, the one with the smallest record id is nested and all are counted. Secondaries whose
target is absent give a row without payload. Empty input gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small, table

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 1000
PIECE = 1 << 16  # of a gzip member, read at once
FILE_BYTES = 64 << 20
CLASS_BYTES = 16 << 10  # of the payloads of the smallest class
RECORDS = "record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}/"), key))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the CRLF CRLF at its end; headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), v) for name, v in headers]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(captures: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes the captures as gzipped WARC files below ``path``, each of about ``file_bytes`` before compression or one capture.

    Of captures with equal payloads of ``least_bytes`` or more, that with the largest id is a response, the others are
    revisits of it. Payloads are told apart by their digests, in a table without payloads. The captures of each size class, by powers of 16, are written by
    themselves, as the text sink bounds its files by rows.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    # a row's number comes from its place in the scan: the same in each pass over the same files
    base = captures.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    size_class = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest("bytes", F.lit(1)) / CLASS_BYTES))).cast("int")
    slim = materialize(base.select("uid", "id", "digest", "bytes", size_class.alias("size")))
    equal = slim.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.max_by(F.negate("uid"), F.struct("id", F.negate("uid"))).alias("lead"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    later = slim.select("uid", "id", "digest").join(equal, "digest").filter("id IS NULL OR id < first")
    later = small(materialize(later.select("uid", "first", F.negate("lead").alias("lead"))), 200_000)
    rows = base.join(later, "uid", "left")
    again = F.col("first").isNotNull()
    key = lambda uid, number: F.concat(uid.cast("string"), F.lit("/"), F.coalesce(number.cast("string"), F.lit("none")), F.lit("/"), F.col("digest"))
    own = key(F.col("uid"), F.col("id"))
    rows = rows.select("*", again.alias("again"), _urn("payload", own).alias("rid"), F.regexp_replace("url", "[\\x00-\\x20]", "%20").alias("uri"), own.alias("key"))
    uri = ("WARC-Target-URI", F.col("uri"))
    to = ("WARC-Concurrent-To", F.col("rid"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    main = _record(
        F.when(F.col("again"), "revisit").otherwise("response"),
        F.col("rid"),
        [
            uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(F.col("again"), _urn("payload", key(F.col("lead"), F.col("first"))))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html"))),
    )
    request = F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    asked = _record("request", _urn("request", F.col("key")), [uri, to, ("Content-Type", F.lit("application/http; msgtype=request"))], request)
    facts = F.concat_ws(CRLF, F.concat(F.lit("capture-id: "), F.col("id").cast("string")), F.concat(F.lit("payload-length: "), F.col("bytes").cast("string")), F.concat(F.lit("refers-to-capture: "), F.when(F.col("again"), F.col("first").cast("string"))))
    noted = _record("metadata", _urn("metadata", F.col("key")), [uri, to, ("Content-Type", F.lit("application/warc-fields"))], facts)
    sizes = [r[0] for r in slim.select("size").distinct().orderBy("size").collect()]  # six at most: a payload has less than 2^31 bytes
    for size in sizes or [0]:
        lines = rows.filter(size_class == size) if len(sizes) > 1 else rows
        most = max(1, file_bytes // (CLASS_BYTES * 16**size + 2048))
        lines.select(F.concat_ws("\r\n\r\n", asked, main, noted).alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _unzipped(data: memoryview) -> Iterator[bytes]:
    """The plain bytes of gzip members, piece by piece: what a member leaves unread is never copied with the rest of the file."""
    at = 0
    while at < len(data):
        if not data[at]:  # members may be padded with zeros
            at += 1
            continue
        z = zlib.decompressobj(31)
        while not z.eof and at < len(data):
            piece = data[at : at + PIECE]
            yield z.decompress(piece)
            at += len(piece) - len(z.unused_data)
        yield z.flush()


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive's bytes, gzipped (one member or many) or plain."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_unzipped(memoryview(data)))
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        head: dict[str, list[str]] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        one = {k: v[0] for k, v in head.items()}
        size = int(one["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        kind, payload, fields = one.get("warc-type"), block, None
        if one.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        if one.get("content-type", "").startswith("application/warc-fields"):
            pairs = [x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x]
            fields = {a.strip(): b.strip() for a, _, b in pairs}
        yield one.get("warc-record-id"), kind, head.get("warc-concurrent-to", []), one.get("warc-target-uri"), one.get("warc-refers-to"), one.get("warc-payload-digest"), len(payload), hashlib.sha1(payload).hexdigest(), fields, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files below ``path``; ``payload`` is null without ``payloads``. A file is parsed as a whole."""
    names = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf.content:
                rows = [r if payloads else (*r[:-1], None) for r in parse(bytes(data))]
                for i in range(0, len(rows), 500):
                    yield pd.DataFrame(rows[i : i + 500], columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(records, RECORDS)


def assemble(records: DataFrame, hops: int = 1) -> DataFrame:
    """One row per capture: ``record`` (response, revisit or resource), nested ``request`` and ``metadata``, and their numbers.

    ``hops``: how often a secondary that points to another secondary is moved on.
    """
    first = records.filter(F.col("type").isin("response", "revisit", "resource"))
    other = records.filter(F.col("type").isin("request", "metadata"))
    pointed = other.select("type", "record_id", "target_uri", "fields", F.explode("concurrent_to").alias("to"))
    # a payload record may also name its secondaries
    named = first.select(F.col("record_id").alias("to"), F.explode("concurrent_to").alias("record_id"))
    named = other.select("type", "record_id", "target_uri", "fields").join(named, "record_id").select("type", "record_id", "target_uri", "fields", "to")
    pointed = pointed.union(named)
    for _ in range(hops):
        onward = pointed.select(F.col("record_id").alias("via"), F.col("to").alias("onward")).distinct()
        pointed = pointed.join(onward, F.col("to") == F.col("via"), "left").select("type", "record_id", "target_uri", "fields", F.coalesce("onward", "to").alias("to"))
    body = F.struct("record_id", "target_uri", F.to_json("fields").alias("fields"))
    pick = lambda kind: F.min(F.when(F.col("type") == kind, body))
    count = lambda kind: F.count_distinct(F.when(F.col("type") == kind, F.col("record_id")))
    sides = pointed.groupBy("to").agg(pick("request").alias("request"), pick("metadata").alias("metadata"), count("request").alias("n_requests"), count("metadata").alias("n_metadata"))
    back = F.col("metadata").withField("fields", F.from_json("metadata.fields", "map<string,string>"))
    joined = first.select(F.struct(*[F.col(c) for c in first.columns]).alias("record"), F.col("record_id").alias("key")).join(sides, F.col("key") == F.col("to"), "full")
    return joined.select("record", "request", F.when(F.col("metadata").isNotNull(), back).alias("metadata"), F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, read back from its archives."""
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    got = assemble(materialize(read_archives(spark, path, payloads=False)))
    facts = F.col("metadata.fields")
    again = F.col("record.type") == "revisit"
    return got.filter(F.col("record").isNotNull()).select(
        facts["capture-id"].cast("long").alias("page_id"),
        F.when(again, facts["payload-length"].cast("long")).otherwise(F.col("record.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("record.digest", "^sha1:", "")).otherwise(F.col("record.payload_digest")).alias("payload_digest"),
        F.col("record.type").alias("record_type"),
        facts["refers-to-capture"].cast("long").alias("refers_to"),
        (F.col("n_requests") == 1).alias("has_request"),
        (F.regexp_replace("record.digest", "^sha1:", "") == F.when(again, F.regexp_replace("record.digest", "^sha1:", "")).otherwise(F.col("record.payload_digest"))).alias("digest_ok"),
    )


QUERIES = {"op1_warc": op1_warc}
ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id < first THEN first END AS refers_to,
       true AS has_request, true AS digest_ok
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest
"""
}
