"""Secret scans with corpus-wide ownership counts, in DataFrame functions only.

Spans come from regular expressions: each match is put between two marker characters and the text is split there, so that places
are sums of lengths. The values of all candidates are hashed and counted by distinct repositories and owners over the whole corpus: a
value that many owners hold is a copied example, one of few owners looks live. Bare key-like tokens (letters of both cases and digits,
outside the other spans) that are held by one owner alone are added as spans of kind ``bare``.

Kinds: ``assign``, ``access``, ``hex`` (the base) and ``bare``. Places are code points, end exclusive.

Defined cases: null texts count as empty and have no span. Repeated rows each give a row. Null owners and repositories count as one value each.
Spans of different kinds may overlap. Empty input gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, table

# two private characters; where a text has them they are replaced, which no pattern can see and no place moves by
OPEN, SHUT, OTHER = "", "", "�"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs of the required length: the same matches as all runs, of which the short ones are dropped
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "bare"]
COPIED_OWNERS = 3
BLOCK_PARTS = 256  # even


def _possible(text: Column, kind: int) -> Column:
    """Whether a text can have a match: cheap tests that hold for every text with one."""
    if kind == 0:
        low = F.lower(text)
        return F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key"))
    if kind == 1:
        return F.contains(text, F.lit("AKIA"))
    # a bare token has a digit beside another sign of a token
    return text.rlike(HEX if kind == 2 else "[0-9](?:(?<=[A-Za-z+/_=-][0-9])|(?=[A-Za-z+/_=-]))")


def _spans(text: Column, kind: int, pattern: str) -> Column:
    """array<struct<start, kind, stop, value>> of a pattern's matches."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{SHUT}"), f"[{OPEN}{SHUT}]", -1)
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")

    # matches are the second, fourth ... part
    def take(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.char_length(x)
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x.alias("value"))
        return F.struct(stop.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    # parts are read in blocks, as an array that grows by one span is copied each time; a block begins outside a match
    def block(acc: Column, k: Column, own: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), F.lit(False).alias("inside"), none.alias("found"))
        got = F.aggregate(F.slice(own, k * BLOCK_PARTS + 1, BLOCK_PARTS), zero, take)
        return F.transform(F.array(got), lambda g: F.struct(g["at"].alias("at"), F.concat(acc["found"], F.array(g["found"])).alias("found")))[0]

    def every(own: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK_PARTS).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,stop:int,value:string>>>").alias("found"))
        return F.aggregate(blocks, start, lambda acc, k: block(acc, k, own), lambda acc: F.flatten(acc["found"]))

    # a column inside a lambda is evaluated for each element: the parts are made an element themselves, and so read once
    return F.when(_possible(text, kind), F.transform(F.array(parts), every)[0]).otherwise(none)


def candidates(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The ``columns`` and ``spans`` (array<struct<start, kind, stop, value>>) of every row, bare candidates included."""
    text = F.replace(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(OPEN), F.lit(OTHER)), F.lit(SHUT), F.lit(OTHER))
    base = docs.select(*[c.alias(n) for n, c in columns.items()], text.alias("_text"))
    # of an assignment the value is what counts: its group 2
    base = base.withColumn("_assign", F.filter(F.transform(_spans(F.col("_text"), 0, ASSIGN), lambda s: s.withField("value", F.regexp_extract(s["value"], f"^(?:{ASSIGN})", 1))), lambda s: F.char_length(s["value"]) >= 12))
    base = base.withColumn("_base", F.concat(F.col("_assign"), _spans(F.col("_text"), 1, ACCESS), _spans(F.col("_text"), 2, HEX)))
    base = base.withColumn("_bare", F.filter(_spans(F.col("_text"), 3, BARE), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")))
    outside = F.filter("_bare", lambda s: ~F.exists("_base", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"])))
    return base.select(*columns, F.concat("_base", outside).alias("spans"))


def classify(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per row of ``found`` (uid, owner, repo, spans): ``uid`` and its ``spans`` with ``owners``, ``repos`` and ``live``; rows without candidates are left out.

    A value's owners and repositories are counted from distinct (value, owner, repository) triples, which are combined
    before each shuffle; a value that stands in a third of all rows makes a row per task and triple. Bare spans stay if one owner holds them.
    """
    each = found.select("uid", "owner", "repo", F.explode("spans").alias("s")).select("uid", "owner", "repo", "s", F.sha2("s.value", 256).alias("h"))
    triples = each.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = triples.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    held = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    joined = each.join(small(materialize(held), 100_000), "h").filter((F.col("s.kind") < 3) | (F.col("owners") == 1))
    live = (F.col("owners") < copied_owners).alias("live")
    one = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.stop").alias("stop"), "owners", "repos", live)
    return joined.groupBy("uid").agg(F.array_sort(F.collect_list(one)).alias("spans"))  # a row's own spans: bounded by its text


def scan(docs: DataFrame, id_col: str = "doc_id", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """``id`` and ``spans`` (array<struct<start, kind, stop, owners, repos, live>>, by start, then kind) of every row."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    found = materialize(candidates(docs, {"uid": F.monotonically_increasing_id(), "id": F.col(id_col), "owner": owner, "repo": repo}))
    some = materialize(classify(found.filter(F.size("spans") > 0)))
    none = F.array().cast(some.schema["spans"].dataType)
    return found.select("uid", "id").join(small(some, 100_000), "uid", "left").select("id", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking span of ``text`` replaced by ``mark`` and ``n_chars`` counted anew; copied examples stay."""
    found = materialize(candidates(docs, {"uid": F.monotonically_increasing_id(), "key": F.md5(F.coalesce("text", F.lit("")).cast("binary")), "owner": F.col("source"), "repo": F.concat_ws("/", "source", "lang")}).filter(F.size("spans") > 0))
    spans = classify(found).withColumn("spans", F.filter("spans", lambda s: s["live"])).filter(F.size("spans") > 0)
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["stop"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))),
    )
    cuts = spans.join(found.select("uid", "key"), "uid").select(F.col("key").alias("_key"), merged.alias("_cuts"))
    cuts = small(materialize(cuts.groupBy("_key").agg(F.first("_cuts").alias("_cuts"))), 100_000)
    joined = docs.join(cuts, F.md5(F.coalesce("text", F.lit("")).cast("binary")) == F.col("_key"), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda c: c["stop"]))
    stops = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.char_length("text")))
    clean = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda z: F.substring(F.col("text"), z["a"] + 1, z["b"] - z["a"])), mark)
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(clean)
    return joined.withColumn("text", text).withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*[F.col(c) for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document, with n_live, n_copied and n_added."""
    got = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = lambda test: F.size(F.filter("spans", test)).cast("long")
    of = lambda k: n(lambda s: s["kind"] == k)
    return got.select(
        F.col("id").alias("doc_id"),
        *[of(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"),
        n(lambda s: ~s["live"]).alias("n_copied"),
        of(3).alias("n_added"),
    )


def _sql() -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    # RE2 has no look-behind; runs are matched from their first sign on all the same
    patterns = [ASSIGN, ACCESS, HEX, BARE[BARE.index(")") + 1 :]]
    split = lambda p: f"string_split_regex(regexp_replace(t, {quote(f'({p})')}, '{OPEN}\\1{SHUT}', 'g'), '[{OPEN}{SHUT}]')"
    kinds = " UNION ALL ".join(f"SELECT uid, owner, repo, {k} AS kind, {split(p)} AS parts FROM d" for k, p in enumerate(patterns))
    name = "['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS owner, replace(replace(coalesce(text, ''), '{OPEN}', '{OTHER}'), '{SHUT}', '{OTHER}') AS t, 0 AS repo FROM documents),
m AS (SELECT *, list_transform(parts, lambda x: length(x)) AS lens FROM ({kinds}) WHERE len(parts) > 1),
i AS (SELECT *, unnest(range(1, len(parts) // 2 + 1)) AS i FROM m),
s AS (SELECT uid, owner, kind, CAST(list_sum(lens[1 : 2 * i - 1]) AS BIGINT) AS start, CAST(list_sum(lens[1 : 2 * i]) AS BIGINT) AS stop, parts[2 * i] AS found FROM i),
v AS (SELECT uid, owner, kind, start, stop, CASE WHEN kind = 0 THEN regexp_extract(found, {quote(f'^(?:{ASSIGN})')}, 1) ELSE found END AS value FROM s),
b AS (SELECT * FROM v WHERE kind IN (1, 2) OR kind = 0 AND length(value) >= 12),
c AS (SELECT * FROM b UNION ALL SELECT * FROM v WHERE kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
 AND NOT EXISTS (SELECT 1 FROM b WHERE b.uid = v.uid AND v.start < b.stop AND b.start < v.stop)),
h AS (SELECT value, count(DISTINCT owner) AS owners FROM c GROUP BY value),
f AS (SELECT c.*, owners FROM c JOIN h ON h.value = c.value WHERE kind < 3 OR owners = 1),
g AS (SELECT uid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 string_agg({name}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({name}, ',' ORDER BY start, kind) AS spans,
 count(*) FILTER (owners < {COPIED_OWNERS}) AS n_live, count(*) FILTER (owners >= {COPIED_OWNERS}) AS n_copied, count(*) FILTER (kind = 3) AS n_added FROM f GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_added, 0) AS n_added FROM d LEFT JOIN g ON g.uid = d.uid"""


QUERIES = {"op6_secrets": op6_secrets}
ORACLES = {"op6_secrets": _sql()}
