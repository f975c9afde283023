"""URL verdicts: explicit host and path rules first, else the reputation of the host.

Reputation is empirical Bayes over labelled page outcomes: the bad share of a suffix is shrunk
to the overall share, that of a registered domain to its suffix, that of a host to its domain, each
through a beta-binomial prior. What a level's prior is worth in pages is estimated from the level's
own spread: the moments of its counts say by how much groups differ beyond chance. Where groups don't
differ the prior weighs much and no host stands out by luck; where they do, it weighs little and
hosts are known by a few pages. A url is blocked if the lower quantile of its host's beta posterior
is above `limit`; by default that is the overall bad share (costs at which the average page is just
worth keeping), so that hosts are blocked which are credibly worse than the average page. Hosts without
labelled pages have their nearest labelled ancestor's mean and the prior's worth.

Counts are aggregated per host before anything else, so a hot host is one row after the map
side. Levels above are sums over hosts. Everything is DataFrame expressions, without Python.

Defined results: a null url or one without :// has an empty host and path, no rule, and the
verdict of the overall share; repeated rows are each judged, and each counts as a page; empty tables
give empty results (no labelled pages: everything that no rule blocks is allowed); further
columns are not carried, so clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which registrations of country suffixes are made.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    return F.coalesce(found, F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where a country suffix has registrations below a second level."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.when(two, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it."""
    labels = F.split(host, r"\.")
    keep = F.size(F.split(suffix_of(host), r"\.")) + 1
    n = F.size(labels)
    return F.when(n > keep, F.array_join(F.slice(labels, n - keep + 1, keep), ".")).otherwise(host)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, host/path) and its verdict, as columns.

    A list of rules is a parameter of the job; it becomes one CASE, longest first, and of
    equally long rules the one with the longer host.
    """
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in reversed(order):
        at, slash, below = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


#: Pages that a level's prior may be worth, least and most; without groups of two pages it is worth the geometric middle.
WORTH = (2.0, 2_000.0)


def worth(counted: DataFrame, mean: str, n: str, bad: str, name: str) -> DataFrame:
    """One row: what the prior of a level is worth, from its groups' counts and their parents' means.

    For counts of a beta-binomial with worth s, E (b - n m)^2 = n m (1 - m) (1 + (n - 1) / (s + 1)).
    """
    m, k, b = F.col(mean), F.col(n), F.col(bad)
    chance = k * m * (1 - m)
    spread = F.try_divide(F.sum((b - k * m) * (b - k * m) - chance), F.sum(chance * (k - 1)))
    low, high = (1 / (w + 1) for w in reversed(WORTH))
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), spread))
    return counted.agg(F.coalesce(1 / bounded - 1, F.lit(math.sqrt(WORTH[0] * WORTH[1]))).alias(name))


def beta_quantile(a: Column, b: Column, z: float) -> Column:
    """The quantile of Beta(a, b) that lies z standard deviations of a normal below the middle (Abramowitz and Stegun 26.5.22).

    It is 0 for a below 1, whose density is greatest at 0; b counts as 1 at least, which lowers the quantile.
    """
    p, q = 1 / (2 * a - 1), 1 / (2 * F.greatest(b, F.lit(1.0)) - 1)
    h, low = 2 / (p + q), (z * z - 3) / 6
    w = z * F.sqrt(h + low) / h - (q - p) * (low + 5 / 6 - 2 / (3 * h))
    return F.when(a >= 1, a / (a + F.greatest(b, F.lit(1.0)) * F.exp(2 * w))).otherwise(F.lit(0.0))


def reputations(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """host, p_host (posterior mean), bound (posterior quantile) and overall (the bad share of all pages) for every host of `hosts`, from `outcomes` (host, bad 0/1)."""
    levels = lambda df: df.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    counted = levels(outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.sum("bad").alias("b_h"), F.count("*").alias("n_h")))
    domains = counted.groupBy("domain", "suffix").agg(F.sum("b_h").alias("b_d"), F.sum("n_h").alias("n_d"))
    suffixes = domains.groupBy("suffix").agg(F.sum("b_d").alias("b_s"), F.sum("n_d").alias("n_s"))
    overall = suffixes.agg(F.coalesce(F.try_divide(F.sum("b_s"), F.sum("n_s")), F.lit(0.0)).alias("overall"))

    def posterior(level: DataFrame, k: str, prior: str, strength: str) -> DataFrame:
        """Means p_k of the groups that are labelled."""
        s = F.col(strength)
        return level.withColumn(f"p_{k}", (F.col(f"b_{k}") + s * F.col(prior)) / (F.col(f"n_{k}") + s))

    one = F.broadcast  # tables of one row
    suffixes = suffixes.crossJoin(one(overall))
    w_s = worth(suffixes, "overall", "n_s", "b_s", "w_s")
    suffixes = posterior(suffixes.crossJoin(one(w_s)), "s", "overall", "w_s").select("suffix", "p_s")
    domains = domains.join(suffixes, "suffix")
    w_d = worth(domains, "p_s", "n_d", "b_d", "w_d")
    domains = posterior(domains.crossJoin(one(w_d)), "d", "p_s", "w_d").select("domain", "p_d")
    w_h = worth(counted.join(domains, "domain"), "p_d", "n_h", "b_h", "w_h")
    joined = (
        levels(hosts).join(counted.select("host", "b_h", "n_h"), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
        .crossJoin(one(overall)).crossJoin(one(w_h))
    )
    prior = F.coalesce("p_d", "p_s", "overall")
    a = F.coalesce("b_h", F.lit(0)) + F.col("w_h") * prior
    b = F.coalesce(F.col("n_h") - F.col("b_h"), F.lit(0)) + F.col("w_h") * (1 - prior)
    return joined.select("host", (a / (a + b)).alias("p_host"), beta_quantile(a, b, z).alias("bound"), "overall")


def url_verdicts(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    limit: float | None = None,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, p_host and bound of every row of pages.

    outcomes: url, bad (0/1, null: not labelled). limit: the bad share that the posterior's lower quantile (z
    standard deviations of a normal down) must exceed; None: the overall share. The reputation table has a row for
    each host; it is joined back by host, and a hot host's pages are spread by AQE's skew join.
    """
    url = F.col(url_col)
    read = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    read = read.withColumns({"rule": rule, "said": said})
    seen = outcomes.select(host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad"))
    judged = read.join(reputations(seen, read.select("host").distinct(), z), "host", "left")
    most = F.col("overall") if limit is None else F.lit(limit)
    verdict = F.coalesce(F.col("said"), F.when(F.col("bound") > most, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("p_host", 9).alias("p_host"), F.round("bound", 9).alias("bound"))
