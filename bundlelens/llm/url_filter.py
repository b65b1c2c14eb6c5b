"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import ascii_lower, carried, col

PREFIX = 8
"""Hex digits of the short hash that the join compares."""
RESULTS = ("host", "path", "rule", "verdict")
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def host_of(url):
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules from (host, path, verdict) tuples."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(host, path):
    # A host has no "/" and a folder is empty or starts with one, so the text stands for one pair only.
    return F.sha2(F.concat(host, path), 256)


def _folder(path):
    """The path up to its last ``/``: what a rule is indexed by."""
    return F.regexp_extract(path, r"^(?s:(.*/))", 1)


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules with the digest of their host and folder. Rules without a host or verdict fit nothing."""
    host, path = ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))
    digest = _digest(host, _folder(path))
    return rules.filter("host is not null and host <> '' and verdict is not null").select(
        F.substring(digest, 1, PREFIX).alias("_prefix"), digest.alias("_rule_digest"),
        path.alias("_rule_path"), host.alias("_rule_host"), F.col("verdict").alias("_verdict"))


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per url and expression (host suffix, folder prefix), with its digest.

    Suffixes and prefixes that have more parts than any rule cannot meet one and are not made; the
    two depths are one row computed from the rules, whatever the number of rules.
    """
    labels = F.size(F.split("host", r"\."))
    folders = F.length(F.regexp_replace(F.coalesce("path", F.lit("")), "[^/]", ""))
    depth = rules.agg(F.coalesce(F.max(labels), F.lit(0)).alias("labels"),
                      F.coalesce(F.max(folders), F.lit(0)).alias("folders"))
    label_depth, folder_depth = depth.select("labels").scalar(), depth.select("folders").scalar()
    parts, steps = F.split("host", r"\."), F.split("path", "/")
    n_labels = F.least(F.size("_parts"), F.col("_label_depth"))
    n_folders = F.least(F.size("_steps") - 1, F.col("_folder_depth"))
    spread = urls.filter("host <> ''").select(
        "_url", "host", "path", parts.alias("_parts"), steps.alias("_steps"),
        label_depth.alias("_label_depth"), folder_depth.alias("_folder_depth"),
    ).select(
        "_url", "path",
        F.when(n_labels > 0, F.transform(F.sequence(F.lit(1), n_labels), lambda i: F.array_join(
            F.slice("_parts", F.size("_parts") - i + 1, i), "."))).alias("_suffixes"),
        F.transform(F.sequence(F.lit(0), n_folders), lambda i: F.when(i == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice("_steps", F.lit(1), i), "/"), F.lit("/")))).alias("_prefixes"))
    pairs = spread.select("_url", "path", F.explode("_suffixes").alias("_suffix"), "_prefixes").select(
        "_url", "path", "_suffix", F.explode("_prefixes").alias("_folder"))
    return pairs.select("_url", "path", _digest(F.col("_suffix"), F.col("_folder")).alias("_digest")).withColumn(
        "_prefix", F.substring("_digest", 1, PREFIX))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", carry=None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    A rule fits its host and all subdomains when the path starts with the rule's. The longest rule
    wins; of equally long ones that with the longer host, then one that blocks. ``rule`` is null and
    the verdict ``default`` where none fits.

    Each distinct url is expanded once, so repeated urls cost nothing. The short prefix of the digest
    is the join key; equal full digests and the rest of the rule's path confirm a candidate. A common
    expression (a top-level domain) makes a hot key only when the rules are too many to broadcast;
    AQE then splits it, as neither side of the join needs its key in one place.

    Null urls and urls without ``://`` have empty host and path and fit no rule. Repeated pages are
    judged alike, an empty table gives an empty one. Input columns named like a result give way.
    """
    keep = carried(pages, carry, RESULTS)
    urls = pages.select(col(url).alias("_url")).filter("_url is not null").distinct().select(
        "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    found = expressions(urls, rules).join(keyed_rules(rules), "_prefix").filter(
        (F.col("_digest") == F.col("_rule_digest")) & F.col("path").startswith(F.col("_rule_path")))
    best = found.groupBy("_url").agg(F.max(F.struct(
        (F.length("_rule_host") + F.length("_rule_path")).alias("length"), F.length("_rule_host").alias("host_length"),
        (F.col("_verdict") == "block").alias("blocks"), F.concat("_rule_host", "_rule_path").alias("rule"),
        F.col("_verdict").alias("verdict"))).alias("_best"))
    rows = pages.select(F.struct(*[col(c) for c in keep], F.lit(0).alias("_")).alias("_row"), col(url).alias("_page_url"))
    judged = rows.join(best, F.col("_page_url") == F.col("_url"), "left")
    return judged.select(
        *[F.col("_row")[c].alias(c) for c in keep], host_of(F.col("_page_url")).alias("host"),
        path_of(F.col("_page_url")).alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
