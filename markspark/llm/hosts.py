"""URL filters: rules first, then the reputation of hosts by empirical Bayes.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's rate of bad
pages is shrunk towards the level above it by a beta prior whose strength comes from how much the
groups of that level differ (moments of the beta-binomial). A host is blocked when the lower
posterior bound of its rate is above a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import join_groups
from markspark.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_RHO, MOST_RHO = 0.001, 0.999


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class Reputation:
    """Limits of the method: block when the lower bound is above `most_bad`."""

    most_bad: float = 0.5
    deviations: float = 1.64


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def matching_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits; rules are a short list of settings."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):  # the longest outermost
        fits = (host == rule.host) | host.endswith("." + rule.host)
        fits = fits & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _level(groups: DataFrame, above: DataFrame, key: str, parent: str) -> DataFrame:
    """Adds the posterior `a, b` of each group; `above` has the parents' `rate`."""
    rows = groups.join(above.select(parent, F.col("rate").alias("m")), parent)
    spread = F.col("m") * (1 - F.col("m"))
    off = F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) * F.col("n") - spread
    rho = rows.filter("n > 0").agg(
        (F.sum(off) / F.sum(spread * (F.col("n") - 1))).alias("raw")
    )  # one row
    bounded = F.least(F.greatest(F.coalesce("raw", F.lit(0.0)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    rows = rows.crossJoin(F.broadcast(rho.select(((1 - bounded) / bounded).alias("strength"))))
    a = F.col("m") * F.col("strength") + F.col("bad")
    b = (1 - F.col("m")) * F.col("strength") + F.col("n") - F.col("bad")
    return rows.select(*groups.columns, a.alias("a"), b.alias("b"), (a / (a + b)).alias("rate"))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """`host, n, bad` (labelled pages and bad ones) with `rate, low`: posterior mean and bound."""
    named = hosts.select(
        "*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")
    )
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = named.groupBy("domain", "suffix").agg(*total)
    suffixes = named.groupBy("suffix").agg(*total).withColumn("all", F.lit(0))
    # one success and one failure more keep the top rate off 0 and 1
    top = named.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("rate"))
    top = top.withColumn("all", F.lit(0))
    suffixes = _level(suffixes, top, "suffix", "all")
    domains = _level(domains, suffixes, "domain", "suffix")
    scored = _level(named.drop("suffix"), domains, "host", "domain")
    return scored


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    reputation: Reputation = Reputation(),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: `id_col, host, path, rule, verdict, bad_rate, bad_low`.

    `outcomes` has `id_col` and `bad` (0 or 1, null is no label); a page with several outcomes is
    bad if one of them is. The longest fitting rule decides; else the host's reputation does.

    A null url, or one without `://`, has empty host and path; the empty host has a reputation
    like any other. Null ids have no outcome. Repeated pages are judged, and counted, row by row.
    Other columns are ignored; empty tables give empty results.
    """
    url = F.col(url_col)
    parsed = pages.select(
        F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    parsed = materialize(parsed, "urls")
    labels = (
        outcomes.select(F.col(id_col).alias("id"), F.col("bad").cast("long").alias("bad"))
        .dropna()
        .groupBy("id")
        .agg(F.max("bad").alias("bad"))
    )
    hosts = (
        parsed.select("id", "host")
        .join(labels, "id", "left")
        .groupBy("host")
        .agg(
            F.count("*").alias("pages"),
            F.count("bad").alias("n"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        )
    )
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("t")).first().t
    scored = host_reputation(hosts)
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    low = F.greatest(F.lit(0.0), F.col("rate") - reputation.deviations * deviation)
    scored = scored.select("host", "pages", "rate", low.alias("low"))
    judged = join_groups(parsed, scored, ["host"], "pages", total)
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("low") > reputation.most_bad, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, method).alias("verdict"),
        F.col("rate").alias("bad_rate"),
        F.col("low").alias("bad_low"),
    )
