"""Operator 4: empirical-Bayes host reputation, with rules on host and path.

Labelled outcomes of pages (1: bad) are counted by host. The share of bad
pages is shrunk by beta-binomial priors from the whole corpus to the suffix
(last label of the host), to the registered domain (last two labels), to the
host: each level's posterior mean is the mean of the next level's prior, and
each prior's strength comes from the spread seen at its level (method of
moments). A host is blocked if its share of bad pages is over `ratio` times
the whole corpus' with posterior probability `sure` or more, which is that the
beta posterior's lower quantile lies above it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lithos.llm.common import checkpointed

#: Blocked where the share of bad pages is surely over so many times the whole corpus'.
RATIO = 1.0
#: Posterior probability that is sure enough.
SURE = 0.95
#: Least and greatest correlation of two pages of a group, for the moments' estimate.
RHO = (0.001, 0.999)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, ties to the first in alphabetical order; nulls if none does. A rule: (host, path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def _shrunk(groups: DataFrame, rho_name: str) -> DataFrame:
    """groups: n, bad, prior mean `mu`. Adds the posterior's a and b."""
    p = F.col("bad") / F.col("n")
    var = F.col("mu") * (1 - F.col("mu"))
    some = F.col("n") > 0
    rho = groups.agg(
        F.sum(F.when(some, F.col("n") * F.pow(p - F.col("mu"), 2) - var)).alias("over"),
        F.sum(F.when(some, var * (F.col("n") - 1))).alias("under"),
    ).select(F.coalesce(F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), F.when(F.col("under") > 0, F.col("over") / F.col("under")))), F.lit(RHO[0])).alias(rho_name))
    strength = 1 / F.col(rho_name) - 1
    return groups.crossJoin(F.broadcast(rho)).withColumn("a", strength * F.col("mu") + F.col("bad")).withColumn("b", strength * (1 - F.col("mu")) + F.col("n") - F.col("bad")).drop(rho_name)  # rho: one row


def beta_above(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(t > x) of t ~ Beta(a, b), by Simpson's rule over the log-odds of t, whose density is smooth for all a, b > 0."""
    x = np.clip(x, 1e-12, 1 - 1e-12)
    spread = np.sqrt(1 / a + 1 / b) * 12 + 1
    centre = np.log(a / b)
    cut = np.log(x / (1 - x))

    def area(lo: np.ndarray, hi: np.ndarray, n: int = 512) -> np.ndarray:
        hi = np.maximum(lo, hi)
        z = lo + (hi - lo) * np.linspace(0, 1, n + 1)[:, None]
        weight = np.ones(n + 1)
        weight[1:-1:2], weight[2:-1:2] = 4, 2
        top = a * -np.log1p(b / a) + b * -np.log1p(a / b)  # at the centre
        return (weight[:, None] * np.exp(a * -np.logaddexp(0, -z) + b * -np.logaddexp(0, z) - top)).sum(0) * (hi - lo)

    low, high = centre - spread - 30 / a, centre + spread + 30 / b
    cut = np.clip(cut, low, high)
    above, below = area(cut, high), area(low, cut)
    return above / (above + below)


@F.pandas_udf(DoubleType())
def _above(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    at = range(0, len(a), 4096)
    parts = [beta_above(*(c.to_numpy(float)[i : i + 4096] for c in (a, b, x))) for i in at]
    return pd.Series(np.concatenate(parts) if parts else np.zeros(0))


def reputation(outcomes: DataFrame, sure: float = SURE, ratio: float = RATIO) -> DataFrame:
    """outcomes: host, bad (0, 1 or null for an unlabelled page), a row for each page. Returns host, n, n_bad, mean, bound, blocked for every host.

    bound: the posterior probability that the host's share is over `ratio` times the corpus'.

    Pages are counted by host first, with a map-side sum, so a host of any
    size is one row of what follows. Hosts without a label have their
    domain's prior. A null host is an empty one.
    """
    hosts = checkpointed(outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")))  # written: every level below reads it
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("mu"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = _shrunk(suffixes.crossJoin(F.broadcast(whole)), "r1").select("suffix", mean.alias("mu"))  # whole: one row
    domains = _shrunk(domains.join(suffixes, "suffix"), "r2").select("domain", mean.alias("mu"))
    hosts = _shrunk(hosts.join(domains, "domain"), "r3")
    base = whole.select(F.least(ratio * F.col("mu"), F.lit(1.0)).alias("base"))
    hosts = hosts.crossJoin(F.broadcast(base)).withColumn("bound", _above("a", "b", "base"))  # base: one row
    return hosts.select("host", "n", F.col("bad").alias("n_bad"), mean.alias("mean"), "bound", (F.col("bound") >= sure).alias("blocked"))


def judge(pages: DataFrame, url: str, bad: str, keep: list[str], rules: list[tuple[str, str, str]]) -> DataFrame:
    """`keep`, host, path, rule, verdict (allow or block) and bound of every page.

    A rule that fits decides; else the host's reputation. A null url, or one
    without `://`, has an empty host, which is a host like any other.
    """
    pages = pages.select(*keep, F.col(bad).alias("_bad"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = reputation(pages.select("host", F.col("_bad").alias("bad"))).select(F.col("host").alias("_host"), "bound", "blocked")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = pages.join(known, pages.host == known._host, "left")
    return out.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "bound")
