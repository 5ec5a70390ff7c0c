"""URL filtering by the shrunken reputation of hosts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import ascii_lower
from upswell.session import materialize

#: Last two labels that count as one suffix: a generic second level below a country.
_SUFFIX = r"(?:(?:com|co|org|net|gov|edu|ac)\.[a-z]{2}|[^.]+)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix of a host name; empty for addresses and empty hosts."""
    name = _name(host)
    return F.when(_is_address(name), F.lit("")).otherwise(
        F.regexp_extract(name, rf"(?:^|\.)({_SUFFIX})$", 1)
    )


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more. A host without one is its own."""
    name = _name(host)
    found = F.regexp_extract(name, rf"([^.]+\.{_SUFFIX})$", 1)
    return F.when(_is_address(name) | (found == ""), name).otherwise(found)


def _name(host: Column) -> Column:
    return F.regexp_replace(host, r":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9.]+$|^\[")


def rule_for(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), NULL if none fits.

    A rule is ``host/path`` and fits the host, its subdomains, and paths that start with
    its path. ``rules`` is a list written by people, so it goes into the plan.
    """
    fits = []
    for rule, verdict in sorted(set(rules), key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        of_host = (host == name) | host.endswith("." + name)
        fits.append(
            F.when(
                of_host & path.startswith(slash + start),
                F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")),
            )
        )
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, nothing)


def _concentration(level: DataFrame) -> float:
    """How many outcomes the prior of a level is worth, by the method of moments.

    ``level`` has n outcomes, k good ones and the mean m above it. For a beta-binomial
    group E[n (k/n - m)^2] = m (1 - m) (1 + (n - 1) r); r follows from the sums.
    """
    spread = F.col("m") * (1 - F.col("m"))
    row = (
        level.where("n > 0")
        .agg(
            F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("m")) ** 2).alias("seen"),
            F.sum(spread).alias("base"),
            F.sum(spread * (F.col("n") - 1)).alias("slope"),
        )
        .first()
    )
    r = (row["seen"] - row["base"]) / row["slope"] if row["slope"] else 0.5
    r = min(max(r, 0.001), 0.9)
    return (1 - r) / r


def reputations(outcomes: DataFrame, z: float = 1.64) -> DataFrame:
    """(host, n, k, mean, low, high): the posterior share of good pages for every host.

    ``outcomes`` has a row per page: host and good (true, false, or NULL for a page that
    nobody labelled). Three beta-binomial levels, each with the posterior mean of the one
    above as its prior mean: all pages to suffix, suffix to registered domain, domain to
    host. low and high are the mean less and plus ``z`` posterior standard deviations.

    Counts fold in the map tasks, one row per host moves. A host without labels has what
    its domain tells. Without any label every mean is 0.5.
    """
    per_host = materialize(
        outcomes.groupBy("host")
        .agg(
            F.count("good").alias("n"),
            F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k"),
        )
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    total = per_host.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    top = total["k"] / total["n"] if total["n"] else 0.5

    def counted(*by: str) -> DataFrame:
        return per_host.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrunk(level: DataFrame) -> tuple[DataFrame, float]:
        c = _concentration(level)
        return level.withColumn("mean", (F.col("k") + c * F.col("m")) / (F.col("n") + c)), c

    suffixes, _ = shrunk(counted("suffix").withColumn("m", F.lit(top)))
    suffixes = suffixes.select("suffix", F.col("mean").alias("m"))
    domains, _ = shrunk(counted("suffix", "domain").join(suffixes, "suffix"))
    domains = domains.select("suffix", "domain", F.col("mean").alias("m"))
    hosts, c = shrunk(per_host.join(domains, ["suffix", "domain"]))
    mean = F.col("mean")
    deviation = F.sqrt(mean * (1 - mean) / (F.col("n") + c + 1))
    return hosts.select(
        "host", "n", "k", "mean", (mean - z * deviation).alias("low"), (mean + z * deviation).alias("high")
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Iterable[tuple[str, str]] = (),
    good_share: float = 0.5,
    z: float = 1.64,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation) for every row of ``pages``.

    A rule decides where one fits. Else a page is blocked if even the upper posterior
    bound of its host's share of good pages is below ``good_share``.

    ``labels`` has page_id and good; rows with a NULL in either are no label, repeated
    ones for a page count as one, good only if all are. NULL urls and urls without
    ``://`` share the empty host. Rows of ``pages`` that repeat are judged each. Other
    columns are not read. An empty table gives no rows.
    """
    url = F.col("url")
    judged = pages.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
    )
    outcome = (
        labels.where("page_id is not null and good is not null")
        .groupBy(F.col("page_id"))
        .agg(F.min("good").alias("good"))
    )
    outcomes = judged.join(outcome, "page_id", "left").select("host", "good")
    known = reputations(outcomes, z).select("host", F.col("mean").alias("_mean"), F.col("high").alias("_high"))
    found = rule_for(F.col("host"), F.col("path"), rules)
    return (
        judged.withColumn("_rule", found)
        .join(known, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(
                F.col("_rule.verdict"),
                F.when(F.col("_high") < good_share, F.lit("block")).otherwise(F.lit("allow")),
            ).alias("verdict"),
            F.round("_mean", 6).alias("reputation"),
        )
    )
