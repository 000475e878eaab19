"""URL filters: explicit rules first, then the reputation of the host.

The reputation is an empirical-Bayes estimate.  Labelled pages give counts of good and bad outcomes
for each host; a beta-binomial prior hands down strength from the suffix to the registered
domain and from there to the host.  A host is blocked when the lower bound of its
posterior share of good pages is under a threshold.  Only DataFrame functions are used: counts are
pre-aggregated by host, so that a host with a third of all pages is one row before anything is joined,
and each level is written once, not made anew by every level below.

Reputation belongs to a site: the host without user name and port.  Its suffix is what names are registered under: the
last label, or the last two where a country's domain has an inner label for a kind of owner (``co.uk``, ``com.au``).
A site that is a number address is its own domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (verdict, rule): a rule names a host, which holds for all subdomains, and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Posterior bound: mean - Z * sd must reach the threshold.
Z, THRESHOLD = 1.0, 0.5
#: Strength of a prior (in pages) when the data do not determine it, and its limits.
STRENGTH, LEAST, MOST = 10.0, 1.0, 1000.0
#: Labels below a country's domain (two letters) under which names are registered.
INNER = ("ac", "co", "com", "edu", "gob", "gov", "ltd", "me", "mil", "ne", "net", "or", "org", "plc", "sch")
#: Parts of a site's pages when they meet its bound.
PARTS = 8
NUMBERS = r"^[0-9]+(\.[0-9]+){3}$"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        on, slash, start = rule.partition("/")
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(slash + start))
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def _strength() -> Column:
    """Beta-binomial strength by moments over the children: p(1-p) / variance beyond the binomial's - 1."""
    p, x = F.col("prior"), F.try_divide(F.col("good"), F.col("n"))
    some = F.col("n") > 0
    between = F.sum(F.when(some, F.col("n") * (x - p) * (x - p)))
    binomial = F.sum(F.when(some, p * (1 - p)))
    spread = F.try_divide(between - binomial, F.sum(F.col("n")) - F.count_if(some))
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.coalesce(F.when(spread > 0, F.try_divide(F.avg(F.when(some, p * (1 - p))), spread) - 1), F.lit(STRENGTH))))


def site_of(host: Column) -> Column:
    """The host without user name, port and a last dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")


def site_suffix(site: Column) -> Column:
    two = F.regexp_extract(site, r"(?:^|\.)((?:" + "|".join(INNER) + r")\.[a-z]{2})$", 1)
    return F.when(F.regexp_like(site, F.lit(NUMBERS)), site).when(two != "", two).otherwise(F.substring_index(site, ".", -1))


def site_domain(site: Column, suffix: Column) -> Column:
    """The suffix and the label before it; a site that is a suffix itself is its own domain."""
    return F.when(site == suffix, site).otherwise(F.concat(F.substring_index(F.substring(site, F.lit(1), F.length(site) - F.length(suffix) - 1), ".", -1), F.lit("."), suffix))


def reputation_from_counts(sites: DataFrame) -> DataFrame:
    """(site, domain, suffix, n, good, mean, bound) from (site, n, good): labelled pages of the site, and how many were good.

    A site with n = 0 gets its domain's estimate. Without any labels every mean is one half. Strengths are rounded to six digits, so that reruns agree.
    """
    sites = sites.withColumn("suffix", site_suffix(F.col("site")))
    sites = C.written(sites.withColumn("domain", site_domain(F.col("site"), F.col("suffix"))), "url-sites")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = C.written(sites.groupBy("suffix", "domain").agg(*sums), "url-domains")
    suffixes = C.written(domains.groupBy("suffix").agg(*sums), "url-suffixes")
    whole = suffixes.agg(F.coalesce(F.try_divide(F.sum("good") + 1, F.sum("n") + 2), F.lit(0.5)).alias("prior"))

    def shrunk(children: DataFrame, parents: DataFrame, *on: str) -> DataFrame:
        children = children.join(parents, list(on)) if on else children.crossJoin(F.broadcast(parents))  # without a key the parent is one row
        children = C.written(children, "url-level")
        strength = children.agg(F.round(_strength(), 6).alias("strength"))
        return children.crossJoin(F.broadcast(strength)).withColumn("mean", (F.col("good") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))  # one row

    up = shrunk(suffixes, whole).select("suffix", F.col("mean").alias("prior"))
    mid = shrunk(domains, up, "suffix").select("suffix", "domain", F.col("mean").alias("prior"))
    out = shrunk(sites, mid, "suffix", "domain")
    size = F.col("n") + F.col("strength")
    return out.select("site", "domain", "suffix", "n", "good", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("bound"))


def filter_urls(pages: DataFrame, labelled: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each page: id, host, path, rule (null if none fits), verdict ('allow' or 'block'), bound (rounded; null if a rule decided).

    ``labelled`` has outcomes (1 good, 0 bad) by page id; other values and null ids do not count, and a page with outcomes of both kinds is good. A page without an
    outcome learns from its site's others, a site without outcomes from its domain, suffix or the whole. Null urls have empty host and path and are
    judged like any other. Repeated ids are judged one by one, each with the id's outcome.
    """
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    urls = urls.select("_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path")).withColumn("site", site_of(F.col("host")))
    outcomes = labelled.where(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(label_col).alias("good"))
    # One count for each site, with the pages that have outcomes; a site without any is there with none.
    counted = urls.select("_id", "site").join(outcomes, "_id", "left").groupBy("site").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))
    bounds = C.written(reputation_from_counts(counted).select("site", F.round("bound", 6).alias("bound"), "n"), "url-bounds")
    # A site with a large share of the pages is met in parts: its bound is one row for each part.
    parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
    judged = urls.withColumn("_part", F.pmod(F.xxhash64("_id", "path"), F.lit(PARTS)).cast("int")).join(bounds.select("site", "bound", F.explode(parts).alias("_part")), ["site", "_part"], "left")
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("_rule", rule)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") >= threshold, "allow").otherwise("block"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_rule").isNull(), F.col("bound")).alias("bound"))
