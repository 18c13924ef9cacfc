"""URL filters: fixed host and path rules, and association rules mined from labels by Spark's FP-growth.

A URL becomes a set of tokens (host parts, scheme, path words, query names). FP-growth mines the token sets that go with the label
``block`` in labelled rows. A rule needs its support, a confidence of ``lift`` times the share of blocked rows at least, and a lower confidence limit (Wilson's,
95 % one-sided) above that share, so that few rows make no rule by chance; rules that a shorter one of no less confidence
covers are pruned too. Tokens that stand in the very same labelled rows are one, and those in all of them none, before mining: else the token sets would
multiply without telling more. The rest are matched through an inverted index: each rule stands under its rarest token, a page's tokens look up their rules
and a rule fires if the page holds all its tokens. Only DataFrame and SQL functions are used.

Fixed rules: a rule fits its host and all subdomains, if the path starts with the rule's; the longest wins, then
allow over block. A page that no fixed rule fits gets the mined verdict: block if a mined rule fires, else allow.

Defined cases: a null url, or one without ``://``, has an empty host and path, no token and the verdict allow. Repeated rows each give
a row. With fewer than 5 blocked rows among the labelled ones no rule is mined. Empty input gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, table

LABEL = "\x00block"
#: (verdict, host, path) of the fixed rules
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, words of host labels, path words (digits as one), query names."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    named = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(host, r"[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))
    parts = F.transform(F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    return F.when(host != "", F.array_distinct(F.concat(named, words, parts, names, scheme))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float, confidence: float = 0.0, lift: float = 1.5, least_rows: int = 5, z: float = 1.645) -> DataFrame:
    """(rule, tokens, n_tokens, confidence, support, lift) from rows (tokens, blocked), materialized.

    An item set needs ``support`` of the rows and ``least_rows`` of them. With fewer than ``least_rows`` blocked rows nothing is mined.
    """
    spark = labelled.sparkSession
    labelled = materialize(labelled.select(F.monotonically_increasing_id().alias("uid"), "tokens", "blocked"))
    schema = "rule long, tokens array<string>, n_tokens int, confidence double, support double, lift double"
    blocked, total = labelled.agg(F.count(F.when(F.col("blocked"), 1)), F.count("*")).first()
    if blocked < least_rows:
        return spark.createDataFrame([], schema)
    support, base = max(support, least_rows / total), blocked / total
    each = labelled.select("uid", F.explode("tokens").alias("token"))
    # tokens of the same rows have the same count and the same two sums of hashes; the first by name stands for them
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("a"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("b"))
    own = materialize(seen.filter((F.col("n") >= support * total - 1e-9) & (F.col("n") < total)).groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token"))
    held = each.join(small(own, 100_000), "token").groupBy("uid").agg(F.collect_list("token").alias("own"))  # bounded by a URL's tokens
    items = F.coalesce("own", F.array().cast("array<string>"))
    baskets = labelled.join(held, "uid", "left").select(F.when(F.col("blocked"), F.concat(items, F.array(F.lit(LABEL)))).otherwise(items).alias("items"))
    least = max(confidence, min(1.0, lift * base))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=least).fit(baskets)
    n = F.col("support") * total / F.col("confidence")  # rows that hold the tokens
    p = F.col("confidence")
    low = (p + z * z / (2 * n) - z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n)))) / (1 + z * z / n)
    mined = model.associationRules.filter((F.element_at("consequent", 1) == LABEL) & (low > base))
    mined = materialize(mined.select(F.sort_array("antecedent").alias("tokens"), F.size("antecedent").alias("n_tokens"), "confidence", "support", "lift"))
    # a rule is pruned if the rule without one of its tokens has no less confidence; such rules are looked up by their tokens
    shorter = mined.select(F.col("tokens").alias("t2"), F.col("confidence").alias("c2"))
    wider = mined.select("tokens", "n_tokens", "confidence", F.explode("tokens").alias("gone")).filter("n_tokens > 1")
    beaten = wider.select("tokens", "confidence", F.array_remove("tokens", F.col("gone")).alias("t2")).join(shorter, "t2").filter(F.col("c2") >= F.col("confidence")).select(F.col("tokens").alias("t2"))
    kept = mined.join(beaten.distinct(), F.col("tokens") == F.col("t2"), "left_anti")
    return materialize(kept.select(F.xxhash64("tokens").alias("rule"), "tokens", "n_tokens", "confidence", "support", "lift"))


def fire(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, best): the best rule (confidence, need, support, lift) of each row of ``pages`` (uid, tokens) for which one fires, by an inverted index.

    A rule is indexed under its rarest token among the rules' tokens as counted over the pages. Of equal confidences the last by tokens is the best.
    """
    held = rules.select("rule", "tokens", "confidence", "support", "lift", F.explode("tokens").alias("token"))
    wanted = small(materialize(held.select("token").distinct()), 100_000)
    each = pages.select("uid", "tokens", F.explode("tokens").alias("token")).join(wanted, "token")
    counts = each.groupBy("token").count()
    facts = F.struct("confidence", F.array_join("tokens", " ").alias("need"), "support", "lift")
    index = held.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("k"), F.first("tokens").alias("all"), F.first(facts).alias("facts"))
    index = small(materialize(index.select(F.col("k.token").alias("token"), "all", "facts")), 100_000)
    fired = each.join(index, "token").filter(F.size(F.array_except("all", "tokens")) == 0)
    return fired.groupBy("uid").agg(F.max("facts").alias("best"))


def fixed_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits, null without one."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    rule = verdict = None
    for kind, h, p in order:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, support: float = 0.002, lift: float = 1.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and the best mined rule's confidence, support, lift and tokens, of every page.

    ``labels``: rows (id, blocked) that mark pages.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = materialize(parts.select(F.monotonically_increasing_id().alias("uid"), "id", "host", "path", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")))
    known = labels.filter("id is not null and blocked is not null").groupBy("id").agg(F.max("blocked").alias("blocked"))
    mined = mine(rows.join(known, "id").select("tokens", "blocked"), support, lift=lift)
    best = fire(rows, mined)
    rule, verdict = fixed_verdict(F.col("host"), F.col("path"), rules)
    return rows.join(best, "uid", "left").select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.col("best.confidence").alias("confidence"), F.col("best.support").alias("support"), F.col("best.lift").alias("lift"), F.col("best.need").alias("mined_rule"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, support, lift, mined_rule of every page; labelled pages of low quality or toxic ones are the blocked."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return judge(table(spark, sf_dir, "pages"), labels).withColumnRenamed("id", "page_id")


QUERIES = {"op7_url_rules": op7_url_rules}
ORACLES: dict[str, str] = {}
