"""URL filter with empirical-Bayes host reputation.

Pages with a known outcome (good / bad) give every host a count of labelled
pages and of bad ones.  Three beta-binomial levels shrink these counts: the
rate of a suffix towards the rate of all pages, that of a registered domain
towards its suffix, that of a host towards its domain.  The strength of each
level's prior is estimated from the data by the moments of the beta-binomial
(how much more the children of one parent differ than binomial chance gives).
A host is rejected when the lower posterior bound of its bad rate
(mean - z sd of the beta posterior) reaches ``tau``.

Defined results: a null url or one without ``://`` has an empty host and path
and is judged like any other host; a host without labelled pages gets its
domain's, suffix's or overall rate; without any labelled page everything is
allowed.  Repeated rows are judged each; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import ascii_lower, fresh


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the urls of ``pattern`` = host + path, like ``com/fr/``."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty where the url is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, else nulls.  The rule
    list is configuration and becomes one CASE expression."""
    pattern = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern = F.when(fits, r.pattern) if pattern is None else pattern.when(fits, r.pattern)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if pattern is None else (pattern, verdict)


def domain_of(host: Column) -> Column:
    """The last two labels.  Suffixes of several labels (co.uk) aren't known, so there the hosts of
    all registrants are one domain."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def _strength(child: DataFrame, parent: list[str]) -> DataFrame:
    """One row: the prior strength of a level, from the ANOVA estimate of the
    beta-binomial's intra-class correlation, held within [0.001, 0.999]."""
    p = child.groupBy(*parent).agg(
        F.count("*").cast("double").alias("m"), F.sum("n").cast("double").alias("nn"),
        F.sum("k").cast("double").alias("kk"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2"))
    v = F.col("kk") / F.col("nn") * (1 - F.col("kk") / F.col("nn"))
    # sum n (r - rate)^2 = sum k^2/n - kk^2/nn
    between = F.sum(F.col("k2") - F.col("kk") * F.col("kk") / F.col("nn") - (F.col("m") - 1) * v)
    scale = F.sum((F.col("nn") - F.col("n2") / F.col("nn") - (F.col("m") - 1)) * v)
    rho = F.when(F.col("scale") > 0, F.col("between") / F.col("scale")).otherwise(F.lit(0.0))
    return (p.agg(between.alias("between"), scale.alias("scale"))
            .select(F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(0.001)), F.lit(0.999)).alias("rho"))
            .select((1 / F.col("rho") - 1).alias("s")))


def host_reputation(hosts: DataFrame, z: float = 1.0) -> DataFrame:
    """``hosts``: (host, n labelled, k bad), a row per host, n may be 0.
    Returns host, bad_mean, bad_lower.  The three strengths are single numbers."""
    h = hosts.select("host", "n", "k", domain_of(F.col("host")).alias("domain"),
                     suffix_of(F.col("host")).alias("suffix"))
    seen = h.where("n > 0")
    d = seen.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = s.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    if not total["n"]:
        return h.select("host", F.lit(0.0).alias("bad_mean"), F.lit(0.0).alias("bad_lower"))
    mu = float(total["k"]) / float(total["n"])
    root = s.withColumn("one", F.lit(1))
    s1, s2, s3 = (x.first()["s"] for x in (
        _strength(root, ["one"]), _strength(d, ["suffix"]), _strength(seen, ["suffix", "domain"])))
    sm = s.select("suffix", ((F.col("k") + s1 * mu) / (F.col("n") + s1)).alias("sm"))
    dm = (d.join(sm, "suffix").select(
        "domain", ((F.col("k") + s2 * F.col("sm")) / (F.col("n") + s2)).alias("dm")))
    prior = F.coalesce(F.col("dm"), F.col("sm"), F.lit(mu))
    a, b = F.col("k") + s3 * F.col("p"), F.col("n") - F.col("k") + s3 * (1 - F.col("p"))
    t = F.col("a") + F.col("b")
    return (h.join(dm, "domain", "left").join(sm, "suffix", "left")
            .select("host", "n", "k", prior.alias("p"))
            .select("host", a.alias("a"), b.alias("b"))
            .select("host", (F.col("a") / t).alias("bad_mean"),
                    (F.col("a") / t - z * F.sqrt(F.col("a") * F.col("b") / (t * t * (t + 1)))).alias("bad_lower")))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", bad: Column | None = None,
               z: float = 1.0, tau: float = 0.5, salts: int = 16) -> DataFrame:
    """Adds host, path, rule, verdict, bad_lower to the rows of ``pages``.

    ``bad`` is the labelled outcome of a page (true: bad, null: none); without
    it the verdicts of the rules are the outcomes.  Hosts are counted by a
    combining aggregate; the reputation table (a row per host) meets the pages
    on (host, salt), so that a host with a third of the pages is spread over
    ``salts`` tasks and neither side is broadcast by hand.
    """
    host, path, rule, ruled, isbad, salt, low, of, part = fresh(pages, "host", "path", "rule", "ruled", "isbad", "salt", "bad_lower", "_of", "_part")
    hc, pc = url_parts(F.col(url))
    p = pages.withColumn(host, hc).withColumn(path, pc)
    rc, vc = rule_of(F.col(host), F.col(path), rules)
    p = p.withColumn(rule, rc).withColumn(ruled, vc)
    p = p.withColumn(isbad, F.when(F.col(ruled) == "block", True).when(F.col(ruled) == "allow", False)
                     if bad is None else bad)
    hosts = p.groupBy(F.col(host).alias("host")).agg(
        F.count(isbad).alias("n"), F.count(F.when(F.col(isbad), 1)).alias("k"))
    rep = (host_reputation(hosts, z).select(F.col("host").alias(of), F.col("bad_lower").alias(low))
           .withColumn(part, F.explode(F.array(*[F.lit(i) for i in range(salts)]))))
    p = p.withColumn(salt, F.pmod(F.xxhash64(F.col(url), F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    out = p.join(rep, (F.col(host) == F.col(of)) & (F.col(salt) == F.col(part)), "left")
    verdict = F.coalesce(F.col(ruled), F.when(F.round(low, 9) >= tau, "block").otherwise("allow"))
    keep = [F.col(c) for c in pages.columns]
    return out.select(*keep, F.col(host).alias(host), F.col(path).alias(path), F.col(rule).alias(rule),
                      verdict.alias(fresh(pages, "verdict")[0]), F.col(low))
