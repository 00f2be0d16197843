"""URL rules: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, then full digests.

A rule is a host, a path and an action (``block`` or ``allow``). It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's path. The longest fitting rule wins; of equally long ones
``block`` goes before ``allow``.

Every distinct URL is expanded into the expressions that some rule could equal: each suffix of the host that starts
at a label, with each prefix of the path that has the length of some rule's path. Expressions meet rules on the first
32 bits of their SHA-256, the rest of the digest confirms, and the best rule of each URL is one aggregation with
partial sums on the map side. So no key holds more than the distinct URLs: a frequent URL is judged once.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule (an empty host has no
suffix); a null host, path or action in the rules drops that rule; an empty rule table gives every URL the default;
repeated rules count once; repeated rows of pages stay repeated; very long URLs are judged whole; other columns are
kept, those with the names of results replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, written

#: Rules, or URLs that some rule fits, up to this many are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 50_000
SALTS = 1024


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Each label suffix of the host joined with each prefix of the path that has one of the lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with the columns host, path, rule (host and path of the winning rule, else null) and verdict.

    ``rules`` has host, path and action. Columns of ``pages`` by the added names are replaced.
    """
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "action")
        .dropna()
        .filter((F.col("host") != "") & F.col("action").isin("allow", "block"))
        .distinct()
    )
    facts = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    known = rules.select(
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"),
        # the larger of these is the winner: longer first, block before allow, then by name
        F.struct(
            F.length(F.concat("host", "path")).alias("size"),
            (F.col("action") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            F.col("action"),
        ).alias("found"),
    ).withColumn("prefix", F.substring("digest", 1, 8))
    if facts.n <= broadcast_rules:
        known = F.broadcast(known)
    urls = pages.select(F.col(url_col).alias("_bw_url")).filter("_bw_url IS NOT NULL").distinct()
    asked = urls.select("_bw_url", F.explode(_expressions(host_of(F.col("_bw_url")), path_of(F.col("_bw_url")), sorted(facts.lengths))).alias("expression")).select(
        "_bw_url", F.sha2("expression", 256).alias("digest")
    )
    hits = asked.withColumn("prefix", F.substring("digest", 1, 8)).join(known, "prefix").where(asked["digest"] == known["digest"])
    best = written(hits.groupBy("_bw_url").agg(F.max("found").alias("_bw_found")).withColumn("_bw_salt", F.lit(0)), "url-verdicts")
    if best.count() <= broadcast_rules:
        best = F.broadcast(best)
    # NULL meets nothing; salted, such rows don't gather in one task
    salt = F.when(F.col(url_col).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    judged = pages.withColumns({"_bw_url": F.col(url_col), "_bw_salt": salt}).join(best, ["_bw_url", "_bw_salt"], "left")
    return judged.withColumns(
        {
            "host": host_of(F.col("_bw_url")),
            "path": path_of(F.col("_bw_url")),
            "rule": F.col("_bw_found.rule"),
            "verdict": F.coalesce("_bw_found.action", F.lit(default)),
        }
    ).drop("_bw_url", "_bw_salt", "_bw_found")
