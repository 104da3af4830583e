"""URL rules by host suffix and path prefix, matched on short hashes and confirmed on full digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinetra.llm.common import ascii_lower, free_name, quoted, require

#: First group: host, up to the path, query or fragment. Second: path, up to the query or fragment.
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SHORT = 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows; verdict is allow or block."""
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`.

    A rule fits its host and the subdomains of it where the path starts with the rule's path. The longest
    rule (host and path together, then the longer host) wins; of equal rules with different verdicts, block.
    Each distinct (host, path) is expanded into the host suffixes and path prefixes that rules may have, joined
    to the rules on the first 32 bits of SHA-256 and confirmed on all 256. Which suffix and prefix lengths occur
    is asked of the rules once: at most 127 label counts and as many path lengths as a URL has characters,
    whatever the number of rules.

    Null or a text without `://`: host and path are empty. No rule: rule is null, the verdict is `default`.
    Rules with a null part are left out. Repeated rows are judged one by one. Columns of `pages` of the names
    host, path, rule or verdict are replaced. No rows in, no rows out.
    """
    require(pages, url)
    require(rules, "host", "path", "verdict")
    out = ("host", "path", "rule", "verdict")
    rules = (rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "verdict")
             .dropna().groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
             .withColumn("rule", F.concat("r_host", "r_path"))
             .withColumn("r_digest", F.sha2("rule", 256)).withColumn("r_short", F.substring("r_digest", 1, _SHORT)))
    shapes = rules.select(F.size(_labels(F.col("r_host"))).alias("labels"), F.length("r_path").alias("chars")).distinct().collect()
    labels = sorted({r["labels"] for r in shapes})
    chars = sorted({r["chars"] for r in shapes})

    base = pages.drop(*[c for c in pages.columns if c.lower() in out and c != url])
    h, p = free_name(base, "host"), free_name(base, "path")
    base = base.withColumn(h, host_of(quoted(url))).withColumn(p, path_of(quoted(url)))
    urls = base.select(F.col(h).alias("host"), F.col(p).alias("path")).distinct()

    parts, path = _labels(F.col("host")), F.col("path")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]) if labels else F.array().cast("array<int>"), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in chars]) if chars else F.array().cast("array<int>"), lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n))
    tries = (urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
             .withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256))
             .select("host", "path", "digest", F.substring("digest", 1, _SHORT).alias("short")))
    fits = tries.join(rules, F.col("short") == F.col("r_short")).where(F.col("digest") == F.col("r_digest"))
    best = (fits.groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule"), F.length("r_host"), "rule", "r_verdict")).alias("best"))
            .select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("best.rule").alias("b_rule"),
                    F.col("best.r_verdict").alias("b_verdict")))
    keep = [quoted(c) for c in base.columns if c not in (h, p) and c.lower() not in out]
    return (base.join(best, (F.col(h) == F.col("b_host")) & (F.col(p) == F.col("b_path")), "left")
            .select(*keep, F.col(h).alias("host"), F.col(p).alias("path"), F.col("b_rule").alias("rule"),
                    F.coalesce("b_verdict", F.lit(default)).alias("verdict")))
