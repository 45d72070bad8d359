"""Block lists and empirical-Bayes reputation of hosts.

A url is first held against rules; where none fits, the reputation of its host
decides. Labelled page outcomes are counted by host, registered domain and
suffix. Each level's rate of bad pages is a beta-binomial whose prior mean is
the posterior mean of the level above and whose strength is fitted by moments
from the spread of its children. A host is blocked where the lower bound of its
posterior bad rate exceeds a limit; unlabelled hosts take their domain's, then
their suffix's posterior.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import written
from .common import packed, unpacked

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ADDED = ["host", "path", "rule", "verdict", "bad_bound"]
# Suffixes of several labels under which names are registered; any other last
# label is a suffix as it is. Give the table of your own registry for more.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au",
    "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk",
    "ne.jp", "net.au", "or.jp", "org.au", "org.uk", "blogspot.com", "github.io",
)
# The parent of all hosts that are addresses.
ADDRESSES = "[ip]"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def bare(host: Column) -> Column:
    """A host without user part, port and final dots."""
    return F.rtrim(F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*\\z", ""), F.lit("."))


def is_address(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[0-9a-f:.]*\])\z"))


def registered(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain of a host and its suffix.

    The domain is the longest listed suffix, or else the last label, and one label
    more. An address is a domain as a whole; addresses share one suffix."""
    name = bare(host)
    domain, suffix = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(name, ".", -k)
        listed = end.isin(*[s for s in suffixes if s.count(".") + 1 == k])
        domain = F.when(listed, F.substring_index(name, ".", -k - 1)).otherwise(domain)
        suffix = F.when(listed, end).otherwise(suffix)
    return (
        F.when(is_address(name), name).otherwise(domain),
        F.when(is_address(name), F.lit(ADDRESSES)).otherwise(suffix),
    )


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as (rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(
            path, F.lit(r.path)
        )
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def shrunk(
    level: DataFrame, above: DataFrame, key: str, parent: str, default: float
) -> DataFrame:
    """Posterior mean and strength of each ``key`` under its ``parent``.

    ``level`` has (key, parent, n, bad); ``above`` has (parent, mean, strength).
    The prior strength follows by moments from the spread of the rates around
    their parents' means: M = m(1 - m)/v - 1 with the sampling variance taken
    off, kept within 1 and 1,000. Without spread to measure it is ``default``.
    """
    rows = level.join(above.select(parent, F.col("mean").alias("_m")), parent)
    m, n, bad = F.col("_m"), F.col("n"), F.col("bad")
    sampling = F.sum(m * (1 - m))
    binomial = F.sum(n * m * (1 - m))
    excess = F.sum(n * F.pow(bad / n - m, 2)) - sampling
    # the expected excess is (binomial - sampling) / (M + 1)
    ratio = (binomial - sampling) / F.greatest(excess, F.lit(1e-12)) - 1
    prior = rows.agg(
        F.coalesce(
            F.when(binomial - sampling > 1e-9, F.least(F.greatest(ratio, F.lit(1.0)), F.lit(1000.0))),
            F.lit(default),
        )
    ).scalar()
    return rows.withColumn("_prior", prior).select(
        key,
        ((F.col("_prior") * m + bad) / (F.col("_prior") + n)).alias("mean"),
        (F.col("_prior") + n).alias("strength"),
    )


def reputation(
    outcomes: DataFrame, default_strength: float = 10.0, suffixes: Sequence[str] = SUFFIXES
) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Posterior tables by host, domain and suffix, and the overall mean.

    ``outcomes`` has one row per labelled page: host and bad (0 or 1). The counts
    and posteriors of each level are written once, for the levels below read them.
    """
    hosts = (
        written(
            outcomes.groupBy("host").agg(
                F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")
            ),
            "host-counts",
        )
        .withColumns(dict(zip(("domain", "suffix"), registered(F.col("host"), suffixes))))
    )
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = written(hosts.groupBy("domain", "suffix").agg(*sums), "domain-counts")
    tops = written(domains.groupBy("suffix").agg(*sums), "suffix-counts")
    # one good and one bad page more than were seen
    mean = tops.agg(
        (F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)
    ).scalar()
    top = tops.select("suffix", mean.alias("mean"))
    by_suffix = written(shrunk(tops, top, "suffix", "suffix", default_strength), "suffix-rates")
    by_domain = written(
        shrunk(domains, by_suffix, "domain", "suffix", default_strength), "domain-rates"
    )
    by_host = shrunk(hosts, by_domain, "host", "domain", default_strength)
    return by_host, by_domain, by_suffix, mean


def lower_bound(mean: Column, strength: Column, z: float) -> Column:
    """Normal lower bound of a Beta(mean * strength, (1 - mean) * strength)."""
    return mean - z * F.sqrt(mean * (1 - mean) / (strength + 1))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    limit: float = 0.5,
    z: float = 1.645,
    default_strength: float = 10.0,
    url: str = "url",
    page: str = "page_id",
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """Each page with host, path, the fitting rule and a verdict.

    Rules and hosts take a url's authority as it is; reputation is shared by
    registered domain, found without user part, port and final dots. Names with
    nothing left (``.``) share one domain, addresses are domains of their own.

    ``outcomes`` has (page key, bad); a page labelled more than once counts
    each time, a null label not at all. Added columns replace input columns of
    their names. A null url, or one without ``://``, has an empty host and
    path, fits no rule, and takes the overall rate like any unknown host.
    """
    rows = pages.select(
        packed(pages),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.col(page).alias("_page"),
    )
    labelled = rows.select("_page", "host").join(
        outcomes.where("bad is not null").select(F.col(page).alias("_page"), "bad"), "_page"
    )
    by_host, by_domain, by_suffix, overall = reputation(
        labelled.select("host", "bad"), default_strength, suffixes
    )

    def bound(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key, lower_bound(F.col("mean"), F.col("strength"), z).alias(name))

    overall_bound = lower_bound(overall, F.lit(default_strength), z)
    # one row per host, then to the pages: reputations grow with hosts, not pages
    hosts = written(
        rows.select("host")
        .distinct()
        .withColumns(dict(zip(("domain", "suffix"), registered(F.col("host"), suffixes))))
        .join(bound(by_host, "host", "_h"), "host", "left")
        .join(bound(by_domain, "domain", "_d"), "domain", "left")
        .join(bound(by_suffix, "suffix", "_s"), "suffix", "left")
        .select("host", F.coalesce("_h", "_d", "_s", overall_bound).alias("bad_bound")),
        "host-bounds",
    )
    method = F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    ruled = rows.join(hosts, "host").withColumn(
        "_rule", fitting_rule(F.col("host"), F.col("path"), rules)
    )
    return ruled.select(
        *unpacked(pages.columns, ADDED),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), method).alias("verdict"),
        "bad_bound",
    )
