"""URL filter by Empirical-Bayes host reputation.

Explicit rules decide first. Every other host is judged by the share of its labelled pages with a bad outcome, shrunk
through beta-binomial priors: all pages -> public suffix -> registered domain -> host. Each level's prior strength comes
from the overdispersion of the children around their parents (method of moments), so a level that varies little pulls
its children hard. A host is blocked when the lower bound of its posterior bad share exceeds the limit.

Only DataFrame functions are used. Counts are pre-aggregated to hosts before anything else is joined; urls carry no page
text through a shuffle; the join of verdicts back to a hot host is a sort-merge join that adaptive execution may split.

Defined results: a null url, or one without "://", has an empty host and path and is judged as the host "" (an own
group below the suffix ""). Outcomes that are null count as not labelled. Repeated rows count each time. An empty
outcome table leaves the prior mean 1/10 (half a bad page in five) with the default strength, which blocks no host. An
empty table of pages gives an empty result. A carried column named like an output is left out. Of rules of equal length
that fit (they then differ), the last in order of their text wins.

The posterior's lower bound is the mean less z standard deviations, a normal approximation to the beta quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.shared import carried, lower_ascii, written

#: Public suffixes of two labels that the default list knows.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
    "com.sg", "com.tr", "com.tw", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix: the last two labels where the list has them, else the last label."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    last2 = F.substring_index(bare, ".", -2)
    return F.when(last2.isin(*two_label), last2).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: the public suffix and one label before it."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    return F.when(
        F.substring_index(bare, ".", -2).isin(*two_label), F.substring_index(bare, ".", -3)
    ).otherwise(F.substring_index(bare, ".", -2))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null without one. rules: (allow or block, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        own, slash, below = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, parent: str, low: float, high: float, default: float) -> DataFrame:
    """One row (m): the prior strength 1/rho - 1 of children (n, k) around their parents' pooled shares."""
    pooled = children.filter("n > 0").groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.count("*").alias("pm"))
    p = F.col("pk") / F.col("pn")
    terms = (
        children.filter("n > 0")
        .join(pooled, parent)
        .groupBy(parent)
        .agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, F.lit(2))).alias("s"),
            F.sum((1 - F.col("n") / F.col("pn")) * (F.col("n") - 1)).alias("d"),
            F.first(p * (1 - p)).alias("pq"),
            F.first("pm").alias("pm"),
        )
    )
    rho = F.try_divide(F.sum(F.col("s") - F.col("pq") * (F.col("pm") - 1)), F.sum(F.col("pq") * F.col("d")))
    m = F.when(rho.isNull(), F.lit(default)).when(rho <= 0, F.lit(high)).otherwise(1 / rho - 1)
    return terms.agg(F.greatest(F.lit(low), F.least(F.lit(high), m)).alias("m"))


def reputation(
    outcomes: DataFrame,
    hosts: DataFrame,
    *,
    two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES,
    max_bad: float = 0.2,
    z: float = 1.6448536269514722,
    strength: tuple[float, float, float] = (1.0, 1000.0, 10.0),
) -> DataFrame:
    """Each host of hosts(host) with (n_labelled, n_bad, bad_share, bad_bound, verdict).

    outcomes: (host, bad) with bad 0 or 1. strength: least, most and default prior strength. bad_bound is the posterior
    mean less z posterior standard deviations.
    """
    low, high, default = strength
    counted = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("k"))
    level = (
        hosts.select("host")
        .union(outcomes.select("host"))
        .distinct()
        .join(counted, "host", "left")
        .select(
            "host",
            F.lit(1).alias("root"),
            domain_of(F.col("host"), two_label).alias("domain"),
            suffix_of(F.col("host"), two_label).alias("suffix"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("k", F.lit(0)).alias("k"),
        )
    )
    level = written(level, "hosts")  # read by every level's strength and mean below
    totals = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = level.groupBy("domain", "suffix", "root").agg(*totals)
    suffixes = domains.groupBy("suffix", "root").agg(*totals)
    # One-row results, read as scalar subqueries.
    mean = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 5)).alias("p")).scalar()
    ms, md, mh = (_strength(df, parent, low, high, default).scalar() for df, parent in ((suffixes, "root"), (domains, "suffix"), (level, "domain")))
    suffix_means = suffixes.withColumns({"ms": ms, "p": mean}).select("suffix", ((F.col("k") + F.col("ms") * F.col("p")) / (F.col("n") + F.col("ms"))).alias("suffix_mean"))
    means = domains.join(suffix_means, "suffix").withColumns({"md": md, "mh": mh}).select("domain", "mh", ((F.col("k") + F.col("md") * F.col("suffix_mean")) / (F.col("n") + F.col("md"))).alias("domain_mean"))
    a, b = F.col("k") + F.col("mh") * F.col("domain_mean"), F.col("n") - F.col("k") + F.col("mh") * (1 - F.col("domain_mean"))
    share = F.col("a") / (F.col("a") + F.col("b"))
    bound = share - z * F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    return (
        level.join(means, "domain")
        .select("host", "n", "k", a.alias("a"), b.alias("b"))
        .select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), share.alias("bad_share"), bound.alias("bad_bound"))
        .withColumn("verdict", F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow"))
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", carry: tuple[str, ...] = ("page_id",), **options) -> DataFrame:
    """Each row of pages: (*carry, host, path, rule, verdict, bad_bound). options: see reputation."""
    carry = carried(carry, "host", "path", "rule", "verdict", "bad_bound")
    split = pages.select(*carry, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = reputation(outcomes, split.select("host").distinct(), **options).select("host", F.col("verdict").alias("by_host"), "bad_bound")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return split.join(known, "host", "left").select(*carry, "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host").alias("verdict"), F.round("bad_bound", 6).alias("bad_bound"))
