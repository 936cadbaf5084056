"""URL filters: listed rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (good or not) are counted per host.  The rate of a suffix is shrunk towards the overall rate, a
registered domain's towards its suffix's and a host's towards its domain's, each through a beta prior whose mean is the
level above and whose strength is estimated from how much that level's rates vary beyond chance (moments of the
beta-binomial).  A page is blocked when its host's good rate is below the corpus's own rate (or ``least_good``, where
given) even at the upper bound of the posterior (mean plus ``z`` standard deviations; by default nine parts in ten of a
normal posterior lie below).  So an unknown or little known host is allowed unless what is above it is worse than the
corpus.  Suffix: the last label of a host; registered domain: the last two.

Rules fit their host and its subdomains where the path starts with the rule's path; the longest fitting rule wins.

Defined results: a url that is null or has no ``://`` has empty host and path, which form a host of their own.  Outcomes
with null id or null label aren't counted; several labels of a page count each.  Without outcomes everything not ruled
out is allowed.  Repeated pages are judged each; extra columns pass through ``allowed_pages``; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .base import salted_join, written

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
Z = 1.28
STRENGTHS = (2.0, 1000.0)  # least and most pseudo-counts of a prior
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES, what: str = "rule") -> Column:
    """The longest fitting rule (or its verdict), else null."""
    found = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.lit(rule_host + rule_path if what == "rule" else verdict)).otherwise(found)
    return found


def _strength(groups: DataFrame, low: float, high: float) -> DataFrame:
    """One row: overall good rate ``_mu`` and prior strength ``_m`` from groups with counts ``n`` and ``k``."""
    seen = groups.where("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("N"), F.coalesce(F.sum("k"), F.lit(0)).cast("double").alias("K"),
        F.count(F.lit(1)).cast("double").alias("G"), F.coalesce(F.sum(F.col("k") * F.col("k") / F.col("n")), F.lit(0.0)).alias("Q"),
        F.coalesce(F.sum(F.col("n") * F.col("n")).cast("double"), F.lit(0.0)).alias("S"))
    mu = (F.col("K") + 1) / (F.col("N") + 2)
    chance = mu * (1 - mu)
    spread = F.col("Q") - 2 * mu * F.col("K") + mu * mu * F.col("N")  # sum of n * (rate - mu)^2
    room = chance * (F.col("N") - F.col("S") / F.greatest(F.col("N"), F.lit(1.0)) - (F.col("G") - 1))
    share = F.when(room > 0, (spread - chance * (F.col("G") - 1)) / room).otherwise(0.0)
    m = F.when(share > 0, (1 - share) / share).otherwise(high)
    return seen.select(mu.alias("_mu"), F.least(F.lit(high), F.greatest(F.lit(low), m)).alias("_m"))


def host_bounds(outcomes: DataFrame, z: float = Z, strengths: tuple[float, float] = STRENGTHS) -> DataFrame:
    """One row per host: labelled pages ``n``, good ones ``k``, the posterior bound ``upper`` and the corpus's rate ``overall``.

    ``outcomes``: columns ``host`` and ``good`` (1, 0, or null for a page without label).
    """
    labels = F.split("host", r"\.")
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = hosts.withColumns({"domain": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
                               "suffix": F.element_at(labels, -1)})
    hosts = written(hosts, "hosts")  # read for each level's totals and strength
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrunk(level: DataFrame, mean: Column) -> DataFrame:
        strength = F.broadcast(_strength(level, *strengths).select(F.col("_m").alias("_strength")))  # one row
        return level.join(strength).withColumn("_prior", mean).withColumn(
            "_mean", (F.col("_strength") * F.col("_prior") + F.col("k")) / (F.col("_strength") + F.col("n")))

    overall = F.broadcast(_strength(suffixes, *strengths).select("_mu"))  # one row
    suffixes = shrunk(suffixes.join(overall), F.col("_mu")).select("suffix", F.col("_mean").alias("_above"))
    domains = shrunk(salted_join(domains, suffixes, ["suffix"], ["domain"], how="inner"), F.col("_above"))
    domains = domains.select("domain", F.col("_mean").alias("_above"))
    hosts = shrunk(salted_join(hosts, domains, ["domain"], ["host"], how="inner"), F.col("_above"))
    total = F.col("_strength") + F.col("n")
    sd = F.sqrt(F.col("_mean") * (1 - F.col("_mean")) / (total + 1))
    bounds = hosts.select("host", "n", "k", (F.col("_mean") + z * sd).alias("upper"))
    return bounds.join(overall.withColumnRenamed("_mu", "overall"))


def _judged(pages: DataFrame, outcomes: DataFrame, rules, least_good: float | None, z: float) -> DataFrame:
    """``pages`` (``_id``, ``_url`` and maybe ``_row``) with ``host``, ``path``, ``rule`` and ``verdict``."""
    split = pages.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    good = outcomes.where("_id IS NOT NULL AND good IS NOT NULL")
    bounds = host_bounds(split.select("_id", "host").join(good, "_id", "left"), z)
    limit = F.col("overall") if least_good is None else F.lit(least_good)
    bounds = bounds.select("host", (F.col("upper") < limit).alias("_worse"))
    judged = salted_join(split, bounds, ["host"], ["_id", "path"])
    host, path = F.col("host"), F.col("path")
    return judged.withColumns({
        "rule": rule_of(host, path, rules),
        "verdict": F.coalesce(rule_of(host, path, rules, "verdict"),
                              F.when(F.col("_worse"), F.lit("block")).otherwise(F.lit("allow"))),
    }).drop("_worse")


def _outcomes(outcomes: DataFrame, id_col: str) -> DataFrame:
    return outcomes.select(F.col(id_col).alias("_id"), F.col("good").cast("long").alias("good"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES,
          least_good: float | None = None, z: float = Z) -> DataFrame:
    """Id, ``host``, ``path``, ``rule`` and ``verdict`` of each page.  ``outcomes``: ``id_col`` and ``good``."""
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url}`").alias("_url"))
    judged = _judged(rows, _outcomes(outcomes, id_col), rules, least_good, z)
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")


def allowed_pages(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES,
                  least_good: float | None = None, z: float = Z) -> DataFrame:
    """The pages that aren't blocked, columns unchanged."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"),
                        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url}`").alias("_url"))
    judged = _judged(rows, _outcomes(outcomes, id_col), rules, least_good, z)
    return judged.where("verdict = 'allow'").select("_row.*")
