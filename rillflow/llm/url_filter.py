"""URL filter by empirical-Bayes reputation of hosts.

Labelled pages give every host a number of good pages out of all its labelled ones. Rates are
shrunk along suffix -> registered domain -> host: at each level the children of one parent
get a beta prior whose mean is the parent's posterior mean and whose strength is fitted to
all children of that level by moments (beta-binomial). Hosts without labels inherit. A host
is blocked when even the upper bound of its posterior (mean plus ``Z`` standard deviations)
lies below ``LEAST_RATE``: it takes evidence to block, none to pass.

Fixed rules ``(host, path)`` come first; the longest one that fits decides.

Labels are counted per host before anything moves; pages meet the reputation table in a join
of thin rows on the host, which Spark broadcasts if small and splits if a host is hot.

NULL url or no ``://``: host and path empty; such pages share the root prior. Urls of any length
are read whole. A NULL ``page_id`` has no label. Repeated pages are judged one by one and alike; each
repeated page and each repeated label counts as evidence. Only ``page_id`` and ``url`` are read and
returned, so other columns may have any name. An empty table gives an empty result; without
labels the root prior is uniform and nothing is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import ascii_lower
from rillflow.scratch import store

Z = 1.645
LEAST_RATE = 0.6
MOST_STRENGTH = 1000.0
#: Suffixes of two labels; all others have one.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn")
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, else NULL."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    labels = F.split(host, r"\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    size = F.when((F.size(labels) >= 2) & two.isin(*LONG_SUFFIXES), 2).otherwise(1)
    tail = lambda n: F.when(F.size(labels) <= n, host).otherwise(F.concat_ws(".", F.slice(labels, -n, n)))
    return F.when(size == 2, tail(2)).otherwise(tail(1)), F.when(size == 2, tail(3)).otherwise(tail(2))


def _strength(counts: DataFrame, parent_mean: str) -> Column:
    """Moment estimate of the prior strength s over children with means ``parent_mean``.

    For n trials, E[(x - n m)^2] = n m (1-m) (1 + (n-1) r) with r = 1/(s+1); r is the slope of
    the excess over the binomial part, summed over all children.
    """
    v = F.col("n") * F.col(parent_mean) * (1 - F.col(parent_mean))
    off = F.col("good") - F.col("n") * F.col(parent_mean)
    r = F.try_divide(F.sum(off * off - v), F.sum(v * (F.col("n") - 1)))
    r = F.least(F.lit(1.0), F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(1 / (MOST_STRENGTH + 1))))
    return (1 / r - 1).alias("strength")


def _posterior(children: DataFrame, parents: DataFrame, parent: str, label: str) -> DataFrame:
    """Adds ``mean`` and ``weight`` (all pseudo-counts) of every child; ``parents``: parent, mean.

    The level is stored, so that the next one does not plan it again; its strength, one number
    for all children of the level, is read on the driver.
    """
    joined = store(children.join(parents.select(parent, F.col("mean").alias("prior_mean")), parent), label)
    strength = F.lit(joined.agg(_strength(joined, "prior_mean")).first()["strength"])
    a = F.col("good") + F.col("prior_mean") * strength
    weight = F.col("n") + strength
    return joined.withColumns({"mean": a / F.greatest(weight, F.lit(1e-9)), "weight": weight})


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n, good, mean, upper`` of every host of ``pages``.

    ``pages``: ``page_id, url``. ``outcomes``: ``page_id, good`` (0/1), any number of rows a page.
    """
    host, _ = host_and_path(F.col("url"))
    ids = pages.select("page_id", host.alias("host"))
    # pages meet labels in an inner join, which NULL ids never enter; every host comes from the pages alone
    labelled = ids.join(outcomes.select("page_id", "good"), "page_id").select("host", F.col("good").cast("int").alias("good"))
    hosts = ids.select("host", F.lit(None).cast("int").alias("good")).unionAll(labelled).groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = store(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("root", F.lit(0))
    root = suffixes.groupBy("root").agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("mean"))
    at_suffix = _posterior(suffixes, root, "root", "reputation-suffix")
    at_domain = _posterior(domains, at_suffix, "suffix", "reputation-domain")
    at_host = _posterior(hosts.drop("suffix"), at_domain.select("domain", "mean"), "domain", "reputation-host")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return at_host.select("host", "n", "good", "mean", (F.col("mean") + Z * spread).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, reputation``, one row per page."""
    host, path = host_and_path(F.col("url"))
    known = reputation(pages, outcomes).select("host", F.col("mean").alias("reputation"), "upper")
    out = pages.select("page_id", host.alias("host"), path.alias("path")).join(known, "host", "left")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < LEAST_RATE, "block").otherwise("allow")
    return out.withColumn("fit", fit).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "reputation"
    )


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labelled pages: those whose id carries labels; good is good quality and not toxic."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    return labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))
