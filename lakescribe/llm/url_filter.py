"""URL filters by empirical-Bayes host reputation (operator 3), DataFrame functions only.

A page's outcome is bad when its label says toxic or low quality. The bad rate of a suffix is shrunk
towards the overall rate, that of a registered domain towards its suffix, that of a host towards its
domain: each level's posterior mean is the next level's beta prior. A prior's strength is fitted by
moments: within-level variance of the rates beyond binomial noise gives the precision, kept between
``STRENGTH_MIN`` and ``STRENGTH_MAX``, and never above the number of labels it rests on. A host is
blocked when it is credibly worse than the whole: when the lower bound of its posterior (mean - ``Z`` *
standard deviation, some 90 % one-sided) is over the overall bad rate. Fixed rules (host, path prefix)
decide first. Suffixes of several labels are a fixed list (``SUFFIXES``); user and port of a host don't
count, and a numeric address is its own domain and suffix.

Hosts, domains and suffixes are one row each out of partial aggregates; what is joined back to hosts is
written first, so that adaptive execution can split the hosts of a hot domain.

Defined results: a null url, or one without "://", has empty host and path; hosts without labelled
pages take their domain's posterior, unseen suffixes the overall one; without any labels all pages
that no rule blocks are allowed; an empty table gives no rows; repeated rows are judged alike; very long
urls are read whole; extra columns are ignored, and none of theirs is in the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Rules as (host, path prefix, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
STRENGTH_MIN, STRENGTH_MAX = 4.0, 200.0
Z = 1.28
#: Public suffixes of two labels, under which anybody registers a name.
SUFFIXES = (
    "ac.uk co.uk gov.uk me.uk org.uk com.au net.au org.au co.nz co.jp ne.jp or.jp co.kr or.kr com.br org.br com.ar com.mx com.tr com.cn com.tw com.hk "
    "com.sg com.my co.in co.id co.th co.za co.il blogspot.com wordpress.com github.io gitlab.io netlify.app vercel.app pages.dev herokuapp.com"
).split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_HOSTS = 100_000
BROADCAST_SUFFIXES = 20_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _name(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _parts(host: Column, single: int) -> Column:
    """The last ``single`` labels, one more under a suffix of two labels; a numeric address whole."""
    name = _name(host)
    double = F.substring_index(name, ".", -2).isin(SUFFIXES)
    return F.when(name.rlike(r"^[0-9.]+$"), name).when(double, F.substring_index(name, ".", -single - 1)).otherwise(F.substring_index(name, ".", -single))


def suffix_of(host: Column) -> Column:
    return _parts(host, 1)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    return _parts(host, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null when none does."""
    name = verdict = F.lit(None).cast("string")
    for at, prefix, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(at + prefix)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _strength(rates: DataFrame, over: str | None) -> DataFrame:
    """Precision of a beta prior from the spread of rates (_bad of _n) around the mean of their parent ``over``."""
    groups = [F.col(over).alias("_up")] if over else [F.lit("").alias("_up")]
    stats = rates.groupBy(*groups).agg(
        F.sum("_bad").alias("_b"), F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"), F.sum(F.col("_bad") * F.col("_bad") / F.col("_n")).alias("_sq"), F.sum(F.col("_n") * F.col("_n")).alias("_nn")
    )
    p = F.col("_b") / F.col("_t")
    noise = p * (1 - p)
    spread = (F.col("_sq") - F.col("_b") * p - (F.col("_k") - 1) * noise) / (F.col("_t") - F.col("_nn") / F.col("_t"))
    fitted = F.when((F.col("_k") > 1) & (spread > 0), noise / spread - 1).otherwise(F.lit(STRENGTH_MAX))
    most = F.greatest(F.least(F.col("_t"), F.lit(STRENGTH_MAX)), F.lit(STRENGTH_MIN))
    return stats.select("_up", F.least(F.greatest(F.coalesce(fitted, F.lit(STRENGTH_MAX)), F.lit(STRENGTH_MIN)), most).alias("_m"))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, float]:
    """((host, mean, sd) of the bad rate for every host in ``outcomes`` (host, bad; bad null where unlabelled), overall bad rate).

    One row per host comes out of a partial aggregation, so a host with a third of all pages is one
    number per task before anything is shuffled.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("_n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("_bad"))
    hosts = stored(hosts.withColumns({"_domain": domain_of(F.col("host")), "_suffix": suffix_of(F.col("host"))}), "hosts")
    domains = stored(hosts.groupBy("_domain", "_suffix").agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad")), "domains")
    suffixes = stored(domains.groupBy("_suffix").agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad")), "suffixes")
    totals = suffixes.agg(((F.sum("_bad") + 0.5) / (F.sum("_n") + 1)).alias("mean"), F.count(F.lit(1)).alias("suffixes")).first()
    overall = 0.5 if totals["mean"] is None else totals["mean"]

    seen = "_n > 0"
    fitted = _strength(suffixes.filter(seen), None).first()
    m = F.lit(fitted["_m"] if fitted else STRENGTH_MIN)
    top = suffixes.join(_strength(domains.filter(seen), "_suffix").hint("merge"), F.col("_suffix") == F.col("_up"), "left")
    top = stored(top.select(F.col("_suffix").alias("_own"), ((F.col("_bad") + m * F.lit(overall)) / (F.col("_n") + m)).alias("_mean"), F.coalesce("_m", F.lit(STRENGTH_MIN)).alias("_m")), "suffix-priors")
    top = F.broadcast(top) if totals["suffixes"] <= BROADCAST_SUFFIXES else top.hint("merge")
    mid = domains.join(top, F.col("_suffix") == F.col("_own"))
    mid = mid.select("_domain", ((F.col("_bad") + F.col("_m") * F.col("_mean")) / (F.col("_n") + F.col("_m"))).alias("_mean"))
    mid = mid.join(_strength(hosts.filter(seen), "_domain").hint("merge"), F.col("_domain") == F.col("_up"), "left")
    mid = stored(mid.select(F.col("_domain").alias("_own"), "_mean", F.coalesce("_m", F.lit(STRENGTH_MIN)).alias("_m")), "domain-priors")
    low = hosts.join(mid.hint("merge"), F.col("_domain") == F.col("_own"))
    a, b = F.col("_bad") + F.col("_m") * F.col("_mean"), F.col("_n") - F.col("_bad") + F.col("_m") * (1 - F.col("_mean"))
    return low.select("host", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd")), overall


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the posterior mean and bound of its host's bad rate.

    ``labels`` (doc_id, quality, toxic) holds outcomes for pages by page_id; of several labels of a
    page any bad one counts.
    """
    url = F.col("url")
    slim = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0))
    outcome = labels.groupBy(F.col("doc_id").alias("_id")).agg(bad.alias("bad"))
    known, overall = reputations(slim.join(outcome.hint("merge"), F.col("page_id") == F.col("_id"), "left").select("host", "bad"))
    known = stored(known.select(F.col("host").alias("_host"), F.col("mean").alias("bad_rate"), (F.col("mean") - Z * F.col("sd")).alias("bound")), "reputations")
    known = F.broadcast(known) if known.count() <= BROADCAST_HOSTS else known.hint("merge")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = slim.join(known, F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("bound") > F.lit(overall), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("bad_rate", 9).alias("bad_rate"))
