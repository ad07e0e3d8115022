"""URL rules by hashed host-suffix and path-prefix expressions, DataFrame functions only.

Each distinct URL is expanded into ``host suffix + path prefix`` expressions, for just those
numbers of host labels and path lengths that the rules have.  Expressions meet rules in an
equi-join on a short hash prefix; the full SHA-256 digest then confirms the match, and the
longest rule wins (then block over allow, then the greater rule string).

URLs are made distinct before they are expanded, so a hot host or URL is expanded once per
partition.  The rules are broadcast while they are at most ``BROADCAST_RULES`` (checked by a count);
beyond that the join shuffles both sides.

Defined cases: a null URL, or one without ``://``, has an empty host and path; a page that no
rule fits is allowed; repeated rows are judged alike; null ids stay; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import checkpointed

PREFIX_HEX = 8
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hashed(rules: DataFrame) -> DataFrame:
    """``rules`` (host, path, verdict) with digests; of two alike rules, block stays."""
    digest = F.sha2(F.concat("host", "path"), 256)
    return rules.groupBy(F.concat("host", "path").alias("_rule")).agg(
        F.max("verdict").alias("_verdict"),
        F.first(digest).alias("_digest"),
        F.first(digest.substr(1, PREFIX_HEX)).alias("_prefix"),
        F.first(F.size(F.split("host", r"\."))).alias("_labels"),
        F.first(F.length("path")).alias("_path"),
    )


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    n_labels = F.size(F.split(host, r"\."))
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= n_labels),
        lambda n: F.call_function("substring_index", host, F.lit("."), -n),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
        lambda n: path.substr(F.lit(1), n),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, verdict`` of each distinct URL that a rule fits."""
    hashed = checkpointed(_hashed(rules))
    sizes = hashed.agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("_labels")).alias("l"), F.sort_array(F.collect_set("_path")).alias("p")
    ).first()
    right = hashed.select("_rule", "_verdict", "_digest", "_prefix")
    if sizes["n"] <= BROADCAST_RULES:
        right = F.broadcast(right)
    split = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    expanded = split.select("url", F.explode(_expressions(F.col("h"), F.col("p"), sizes["l"], sizes["p"])).alias("e"))
    digested = expanded.select("url", F.sha2("e", 256).alias("d")).withColumn("_prefix", F.col("d").substr(1, PREFIX_HEX))
    confirmed = digested.join(right, "_prefix").where("d = _digest")
    best = confirmed.groupBy("url").agg(
        F.max(F.struct(F.length("_rule").alias("n"), (F.col("_verdict") == "block").alias("b"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("m")
    )
    return best.select("url", "m.rule", "m.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each page; ``rules`` has host, path, verdict."""
    pages = pages.select("page_id", "url")
    found = match_rules(pages, rules).select(F.col("url").alias("_url"), "rule", "verdict")
    return pages.join(found, F.col("url").eqNullSafe(F.col("_url")), "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )
