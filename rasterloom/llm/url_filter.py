"""URL filters: rules first, else an empirical-Bayes reputation of the host, in DataFrame functions only.

Labelled page outcomes (good or bad) are summed by host. A host's share of good pages has a beta prior whose mean is that of its
registered domain, the domain's that of its suffix, and the suffix's that of all pages; the strength of each prior comes
from the spread among its children by the moments of the beta-binomial law. A page is allowed if the lower posterior
bound of its host's share reaches a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Scratch, per
from rasterloom.llm.decontam import LOWER, UPPER

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules are a configured list; each is a branch of one expression.
MAX_RULES = 500
#: Suffixes of two labels under which domains are registered; others have one.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.in", "com.br", "com.cn", "co.za")
#: Lower bound: so many deviations below the posterior mean; what it must reach; and the pages that a prior counts for.
DEVIATIONS, THRESHOLD, LEAST_PRIOR, MOST_PRIOR = 1.645, 0.5, 1.0, 1000.0
#: Hosts whose verdicts may be broadcast (some 60 bytes each), and labelled pages (some 40).
BROADCAST_HOSTS, BROADCAST_LABELS = 500_000, 500_000


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; both null if none fits. Of equally long rules the first fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def name_of(host: Column) -> Column:
    """A host without a user's name and a port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def domain_of(name: Column, two_labels=TWO_LABELS) -> Column:
    """The registered domain: a label and the suffix; the name itself if it has no more."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*two_labels), F.substring_index(name, ".", -3)).otherwise(two)


def suffix_of(name: Column, two_labels=TWO_LABELS) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(name, ".", -1))


def strength(children: DataFrame) -> float:
    """What the prior counts for, from children with n and good pages and the mean m of their parent: one number."""
    seen = children.filter("n > 0")
    s = seen.agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("m")) ** 2).alias("spread"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.count("*").cast("double").alias("c"),
        (F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))) / F.sum("n")).alias("v"),
    )
    rho = F.try_divide(F.col("spread") - (F.col("c") - 1) * F.col("v"), (F.col("n") - F.try_divide(F.col("n2"), F.col("n")) - (F.col("c") - 1)) * F.col("v"))
    bounded = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1 / (MOST_PRIOR + 1))), F.lit(1 / (LEAST_PRIOR + 1)))
    return s.select((1 / bounded - 1).alias("k")).first().k


def reputations(outcomes: DataFrame, scratch: Scratch, two_labels=TWO_LABELS) -> DataFrame:
    """(host, pages, mean, low) from (host, pages, n, good), one row for each host: the posterior mean and the lower bound."""
    name = name_of(F.col("host"))
    hosts = outcomes.withColumn("domain", domain_of(name, two_labels)).withColumn("suffix", suffix_of(name, two_labels))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    mean = hosts.agg(*sums).select(((F.coalesce("good", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("m")).first().m
    by_domain = scratch.save(hosts.groupBy("domain", "suffix").agg(*sums), "domains", per(hosts.count(), 1_000_000))

    def shrunk(k: float) -> Column:
        return (F.col("good") + F.lit(k) * F.col("m")) / (F.col("n") + F.lit(k))

    by_suffix = by_domain.groupBy("suffix").agg(*sums).withColumn("m", F.lit(mean))
    suffixes = by_suffix.select("suffix", shrunk(strength(by_suffix)).alias("m"))
    domains = by_domain.join(suffixes, "suffix")
    domains = domains.select("domain", shrunk(strength(domains)).alias("m"))
    own = hosts.join(domains, "domain")
    k = F.lit(strength(own))
    a, b = k * F.col("m") + F.col("good"), k * (1 - F.col("m")) + F.col("n") - F.col("good")
    mean = a / (a + b)
    return own.select("host", "pages", mean.alias("mean"), (mean - DEVIATIONS * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))).alias("low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", outcome_key: str = "doc_id", good: str = "quality", rules=RULES, two_labels=TWO_LABELS) -> DataFrame:
    """key, host, path, rule, verdict and low (the host's lower bound) for each page.

    outcomes has labelled pages: outcome_key and good (1 or 0); nulls are left out, of contradictory labels the larger counts.
    A null url, or one without "://", has an empty host and path and is judged by the reputation of the empty host. A user's
    name and a port belong to the host, not to its domain. Very long urls are read whole. Of equally long rules that fit the
    first counts. A page with a null key has no label. Repeated pages count as often. Without outcomes every host has the mean
    1/2 and is blocked. Other columns aren't read. An empty table gives an empty result. two_labels are the suffixes
    of two labels that are known.
    """
    own = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scratch = Scratch(pages.sparkSession)
    labelled = outcomes.filter(F.col(outcome_key).isNotNull() & F.col(good).isNotNull()).groupBy(F.col(outcome_key).alias("key")).agg(F.max((F.col(good) > 0).cast("int")).alias("good"))
    labelled = scratch.save(labelled, "labels")
    labelled = F.broadcast(labelled) if labelled.count() <= BROADCAST_LABELS else labelled
    counts = own.select("key", "host").join(labelled, "key", "left").groupBy("host").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    counts = scratch.save(counts, "hosts")
    size = counts.agg(F.count("*").alias("hosts"), F.sum("pages").alias("pages")).first()
    known = scratch.save(reputations(counts, scratch, two_labels), "reputations")
    scratch.leave(known)
    if size.hosts <= BROADCAST_HOSTS:
        judged = own.join(F.broadcast(known), "host")
    else:  # hosts that have at least one page in BROADCAST_HOSTS are no more than that many, and none of the others is hot
        hot = F.col("pages") >= size.pages / BROADCAST_HOSTS
        judged = own.join(F.broadcast(known.filter(hot)), "host").unionByName(own.join(known.filter(~hot), "host"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("low") >= THRESHOLD, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(F.col("key").alias(key), "host", "path", name.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "low")
