"""URL rules and empirical-Bayes host reputation, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlab.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`verdict` for the pages of `host` and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty if there is none or the url is null."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(text, verdict); null if none fits."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits = inside & F.startswith(path, F.lit(rule.path))
        value = F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value).otherwise(out)
    return out


def suffix_of(host: Column, long_suffixes: tuple[str, ...] = ()) -> Column:
    """The public suffix: the longest listed one that fits, else the last label."""
    out = F.substring_index(host, ".", -1)
    for suffix in sorted(long_suffixes, key=len):
        inside = (host == suffix) | F.endswith(host, F.lit("." + suffix))
        out = F.when(inside, F.lit(suffix)).otherwise(out)
    return out


def domain_of(host: Column, long_suffixes: tuple[str, ...] = ()) -> Column:
    """The registered domain: the suffix and the label before it."""
    out = F.substring_index(host, ".", -2)
    for suffix in sorted(long_suffixes, key=len):
        inside = (host == suffix) | F.endswith(host, F.lit("." + suffix))
        labels = F.substring_index(host, ".", -(suffix.count(".") + 2))
        out = F.when(inside, labels).otherwise(out)
    return out


def shrunk(groups: DataFrame, prior: Column, least: float, most: float) -> DataFrame:
    """Add `a` and `b`, the beta posterior of each group's share of bad pages.

    All groups of a level share one prior strength. It follows from how much further their
    rates scatter around the prior means than binomial counts would: with G groups and N
    pages, the intra-group correlation is (S - G) / (N - G), S being the sum of
    n (rate - prior)^2 / (prior (1 - prior)), held between `least` and `most`; the strength is
    1 / correlation - 1. One row of sums comes to the driver.
    """
    rate = F.col("bad") / F.col("n")
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior))
    sums = groups.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(rate - p, 2) / (p * (1 - p))).alias("s"),
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
    )
    s, g, n = sums.first()
    correlation = (s - g) / (n - g) if n and n > g else most
    strength = 1 / min(max(correlation, least), most) - 1
    return groups.withColumn("a", strength * p + F.col("bad")).withColumn(
        "b", strength * (1 - p) + F.col("n") - F.col("bad")
    )


def host_reputation(
    outcomes: DataFrame,
    *,
    long_suffixes: tuple[str, ...] = (),
    deviations: float = 1.645,
    least: float = 0.01,
    most: float = 0.9,
) -> DataFrame:
    """Posterior share of bad pages per host, from columns `host` and `bad` (0, 1 or null).

    The overall rate is the prior of the suffixes, a suffix's posterior mean that of its
    registered domains, a domain's that of its hosts; a host without labelled pages has its
    domain's. Returns `host`, `n` (labelled pages), `n_bad`, `mean`, `low` and `high`:
    mean -/+ `deviations` standard deviations of the posterior. Counts per host are combined
    map-side and written once; every level above sums the level below. No labelled page at
    all: every host has the even prior of mean one half.
    """
    hosts = cut_lineage(
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", domain_of(F.col("host"), long_suffixes))
        .withColumn("suffix", suffix_of(F.col("host"), long_suffixes))
    )
    up = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*up)
    suffixes = domains.groupBy("suffix").agg(*up)
    n, bad = suffixes.agg(*up).first()
    overall = F.lit(bad / n if n else 0.5)
    mean = F.col("a") / (F.col("a") + F.col("b"))

    suffixes = shrunk(suffixes, overall, least, most).select("suffix", mean.alias("prior"))
    domains = shrunk(domains.join(suffixes, "suffix"), F.col("prior"), least, most)
    domains = domains.select("domain", "suffix", mean.alias("prior"))
    hosts = shrunk(hosts.join(domains, ["domain", "suffix"]), F.col("prior"), least, most)
    size = F.col("a") + F.col("b")
    spread = deviations * F.sqrt(mean * (1 - mean) / (size + 1))
    return hosts.select(
        "host", "n", F.col("bad").alias("n_bad"), mean.alias("mean"),
        (mean - spread).alias("low"), (mean + spread).alias("high"),
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    *,
    threshold: float = 0.5,
    long_suffixes: tuple[str, ...] = (),
) -> DataFrame:
    """A verdict for every page: that of the longest fitting rule, else by its host's record.

    `outcomes` has `url` and `bad` (0, 1 or null). A host is blocked only where the lower
    posterior bound of its share of bad pages is over `threshold`, so few or no labels never
    suffice alone. Returns `key`, `host`, `path`, `rule` (null if none fits), `verdict`, and
    the host's `n_labelled`, `n_bad`, `mean` and `low`. `rules` is a list that becomes part of the
    plan. A null url, or one without `://`, has an empty host and path, which are judged like
    any other host. Repeated pages and null keys are judged row by row; no pages: no
    verdicts. Other columns are not read.
    """
    rows = pages.select(
        F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    labelled = outcomes.select(host_of(F.col("url")).alias("host"), F.col("bad").cast("int").alias("bad"))
    unknown = rows.select("host", F.lit(None).cast("int").alias("bad"))
    known = host_reputation(labelled.unionByName(unknown), long_suffixes=long_suffixes)
    found = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("low") > threshold, "block").otherwise("allow")
    return rows.join(known, "host").withColumn("found", found).select(
        F.col("key").alias(key), "host", "path", F.col("found.text").alias("rule"),
        F.coalesce("found.verdict", by_host).alias("verdict"),
        F.col("n").alias("n_labelled"), "n_bad", "mean", "low",
    )
