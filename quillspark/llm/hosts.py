"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted per host. Beta-binomial priors hand evidence
down: the suffix shrinks to the whole table, the registered domain to its
suffix, the host to its registered domain. How much a level lends to the one
below it is estimated from the counts: the more the shares of good pages below
differ beyond chance, the less. A host is blocked where the upper quantile of
its posterior share of good pages stays under a threshold. Everything is
DataFrame expressions; counts are aggregated before anything is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common two-label public suffixes; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")


@dataclass(frozen=True)
class Reputation:
    """Parameters of the method."""

    prior_good: float = 0.5  #: share of good pages before any label
    prior_pages: float = 8.0  #: pages that this share counts as, for the whole table
    unknown: float = 8.0  #: pages that a level lends where the counts tell nothing about it
    least: float = 1.0  #: pages that a level lends at least
    most: float = 10_000.0  #: and at most, where what is below differs by chance alone
    bound: float = 0.95  #: the posterior's quantile
    block_below: float = 0.5  #: block where it is lower


#: Points at which a posterior is summed, and the pages beyond which it is as good as normal.
POINTS, NORMAL = 256, 1000.0
#: The normal quantile at ``Reputation.bound``.
Z = 1.6448536269514722


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://`` or url."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' without ``://`` or url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def lent_pages(below: DataFrame, above: list[str], settings: Reputation) -> DataFrame:
    """One row, ``lent``: the concentration of the beta prior that the groups ``above`` hand to the rows ``below`` (n, good), by moments.

    Within a group of k rows with N pages and share p, the sum of n (share - p)^2
    is expected to be p (1 - p) ((k - 1) (1 - r) + r (N - sum of n^2 / N)), r being
    the correlation of two pages of one row. Summed over all groups this gives r,
    and (1 - r) / r the pages lent.
    """
    used = below.filter("n > 0")
    sums = used.groupBy(*above).agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("good").alias("G"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"))
    n, p = F.col("N"), F.col("G") / F.col("N")
    spread = F.col("gg") - F.col("G") * p
    chance = p * (1 - p) * (F.col("k") - 1)
    reach = p * (1 - p) * (n - F.col("nn") / n - (F.col("k") - 1))
    whole = sums.agg(F.sum(spread).alias("spread"), F.sum(chance).alias("chance"), F.sum(reach).alias("reach"))
    r = F.when(F.col("reach") > 1e-9, (F.col("spread") - F.col("chance")) / F.col("reach"))
    lent = F.when(r.isNull(), settings.unknown).when(r <= 1 / (1 + settings.most), settings.most).otherwise(F.greatest(F.lit(settings.least), (1 - r) / r))
    return whole.select(lent.alias("lent"))


def upper_quantile(a: Column, b: Column) -> Column:
    """The quantile at ``Reputation.bound``, 0.95, of a beta distribution with both parameters one half at least.

    With t = sin(x)^2 the density over x is bounded; it is summed at POINTS
    midpoints. Of NORMAL pages and more the normal approximation is taken.
    """
    xs = [(i + 0.5) * math.pi / 2 / POINTS for i in range(POINTS)]
    points = F.array(*(F.struct(F.lit(math.log(math.sin(x))).alias("s"), F.lit(math.log(math.cos(x))).alias("c")) for x in xs))
    logs = F.transform(points, lambda p: (2 * a - 1) * p["s"] + (2 * b - 1) * p["c"])
    shifted = F.transform(F.array(logs), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))[0]
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"))

    def reached(weights: Column) -> Column:
        target = Reputation.bound * F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)

        def step(state: Column, numbered: Column) -> Column:
            upto = state["sum"] + numbered["w"]
            here = (state["at"] < 0) & (upto >= target)
            return F.struct(upto.alias("sum"), F.when(here, numbered["i"] + (target - state["sum"]) / numbered["w"]).otherwise(state["at"]).alias("at"))

        found = F.aggregate(F.transform(weights, lambda w, i: F.struct(w.alias("w"), i.cast("double").alias("i"))), start, step, lambda state: state["at"])
        return F.pow(F.sin(F.when(found < 0, float(POINTS)).otherwise(found) * (math.pi / 2 / POINTS)), 2)

    mean = a / (a + b)
    normal = F.least(F.lit(1.0), mean + Z * F.sqrt(mean * (1 - mean) / (a + b + 1)))
    return F.when(a + b >= NORMAL, normal).otherwise(F.transform(F.array(shifted), reached)[0])


def reputations(outcomes: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """Posterior per host from rows (host, good), good being 1, 0 or null (no label).

    Columns: host, domain, suffix, n, n_good, post_mean, upper_bound. Every
    host of the input is there; one without labels has its domain's posterior.
    Three numbers, what each level lends, are aggregated from the counts.
    """
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    def shrunk(df: DataFrame, prior: str, lent: DataFrame, kept: list[str], mean: str) -> DataFrame:
        # one row, so the product is no larger than the level
        joined = df.crossJoin(F.broadcast(lent))
        return joined.select(*kept, ((F.col("good") + F.col("lent") * F.col(prior)) / (F.col("n") + F.col("lent"))).alias(mean))

    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    all_mean = (F.coalesce("good", F.lit(0)) + settings.prior_pages * settings.prior_good) / (F.coalesce("n", F.lit(0)) + settings.prior_pages)
    suffix_means = shrunk(suffixes.crossJoin(F.broadcast(whole.select(all_mean.alias("a_mean")))), "a_mean", lent_pages(suffixes, [], settings), ["suffix"], "s_mean")
    domain_means = shrunk(domains.join(suffix_means, "suffix"), "s_mean", lent_pages(domains, ["suffix"], settings), ["suffix", "domain"], "d_mean")
    lent = lent_pages(hosts, ["suffix", "domain"], settings)
    posterior = hosts.join(domain_means, ["suffix", "domain"]).crossJoin(F.broadcast(lent))
    a = F.greatest(F.lit(0.5), F.col("good") + F.col("lent") * F.col("d_mean"))
    b = F.greatest(F.lit(0.5), F.col("n") - F.col("good") + F.col("lent") * (1 - F.col("d_mean")))
    posterior = posterior.select("host", "domain", "suffix", "n", F.col("good").alias("n_good"), a.alias("a"), b.alias("b"))
    return posterior.select("host", "domain", "suffix", "n", "n_good", (F.col("a") / (F.col("a") + F.col("b"))).alias("post_mean"), upper_quantile(F.col("a"), F.col("b")).alias("upper_bound"))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (verdict, host, path) that fit, else nulls.

    A rule fits its host and all subdomains if the path starts with the
    rule's. The list is a parameter; a long one belongs in a joined table.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], settings: Reputation = Reputation()) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, and the host's n, n_good, upper_bound.

    ``labels`` is (doc_id, quality, toxic); a page's outcome is the label of
    the document whose id its url names (the first number that follows a
    slash in its path): good if quality is 1 and toxic is not 1. Several labels of
    a document count by their worst. Pages without url have host '' and path ''
    and are judged like any other host; repeated rows stay; a null page_id
    stays null. The verdict is the rule's where one fits, else ``block`` if the
    host's upper bound is under ``settings.block_below``, else ``allow``.

    Labels meet pages on the document id (one row per id on the label side) and
    are counted per host before the host table, which has a row per host, joins
    back; a host with a third of all pages is pre-aggregated in every task.
    """
    url = F.col("url")
    located = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    named = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint)")
    good = F.when((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)), 1).otherwise(0)
    outcome = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("named")).agg(F.min(good).alias("good"))
    outcomes = located.select("host", named.alias("named")).join(outcome, "named", "left").select("host", "good")
    known = reputations(outcomes, settings).select("host", "n", "n_good", "upper_bound")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper_bound") < settings.block_below, "block").otherwise("allow")
    return located.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n", "n_good", F.round("upper_bound", 6).alias("upper_bound"))
