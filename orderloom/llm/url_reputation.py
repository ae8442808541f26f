"""URL filters: list rules first, then empirical-Bayes reputation of the host.

Method: labelled page outcomes are counted by host, registered domain and public suffix; a beta-binomial prior, whose strength
the moments of its children give, shrinks each level towards the one above it; a host passes if the lower bound of its
posterior good rate is high enough. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import enclose, release, salts, table

SALTS = 16
#: Public suffixes of two labels that count as one suffix; a longer list can be handed in.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.za")
#: The rules of the registered query: (rule, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda x: len(x[0])):  # the longest ends outermost
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_levels(df: DataFrame, host: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Add _domain and _suffix of a host column."""
    parts = F.split(F.col(host), r"\.")
    n = F.size(parts)
    ns = F.when((n >= 2) & F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".").isin(*suffixes), 2).otherwise(1)
    cut = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return df.withColumns({"_suffix": cut(ns), "_domain": cut(ns + 1)})


def _moments(children: DataFrame, parent: str, weak: float) -> DataFrame:
    """Counts of each parent and the strength of the prior that it gives its children, from their spread beyond binomial noise."""
    sums = children.groupBy(parent).agg(
        F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), F.sum(F.when(F.col("_n") > 0, 1).otherwise(0)).alias("_m"),
        F.sum(F.when(F.col("_n") > 0, F.col("_k") * F.col("_k") / F.col("_n")).otherwise(0.0)).alias("_kk"),
        F.sum(F.col("_n") * F.col("_n")).alias("_nn"),
    )
    n, k, m = (F.col(c).cast("double") for c in ("_n", "_k", "_m"))
    noise = k * (n - k) / (n * n)
    free = n - F.col("_nn") / n - (m - 1)
    # a ratio within a millionth of zero is the rounding of sums, not spread
    rho = F.round(((F.col("_kk") - k * k / n) / noise - (m - 1)) / free, 6)
    known = (m >= 3) & (k > 0) & (k < n) & (free > 0)
    strength = F.when(known, F.when(rho <= 0.001, 999.0).when(rho >= 0.3, 2.0).otherwise(1 / rho - 1)).otherwise(weak)
    return sums.withColumn("_strength", strength).select(parent, "_n", "_k", "_strength")


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES, z: float = 1.645, weak: float = 10.0) -> DataFrame:
    """_host, posterior mean and lower bound (mean - z deviations) of its good rate, for each host of `pages`.

    pages: _id, _host. outcomes: _id, _good (0 or 1), one row an id. Hosts without outcomes get their domain's prior, and so
    on up to the suffix and to the whole table, whose own prior is uniform. `weak` is the strength where children are too few.
    """
    hosts = (
        pages.join(outcomes, "_id", "left")
        .groupBy("_host")
        .agg(F.count("_good").alias("_n"), F.coalesce(F.sum("_good"), F.lit(0)).cast("long").alias("_k"))
    )
    hosts = with_levels(hosts, "_host", suffixes).withColumn("_root", F.lit(0))
    domains = _moments(hosts, "_domain", weak).join(hosts.select("_domain", "_suffix", "_root").distinct(), "_domain")
    tops = _moments(domains, "_suffix", weak).join(domains.select("_suffix", "_root").distinct(), "_suffix")
    roots = _moments(tops, "_root", weak)
    root = roots.select("_root", ((F.col("_k") + 1) / (F.col("_n") + 2)).alias("_mean0"), F.col("_strength").alias("_strength0"))

    def shrink(level: DataFrame, above: DataFrame, key: str, keep: list[str]) -> DataFrame:
        mean = (F.col("_k") + F.col("_strength0") * F.col("_mean0")) / (F.col("_n") + F.col("_strength0"))
        return level.join(above, key).select(*keep, mean.alias("_mean0"), F.col("_strength").alias("_strength0"))

    top = shrink(tops, root, "_root", ["_suffix"])
    domain = shrink(domains, top, "_suffix", ["_domain"])
    # most hosts may share one domain: its prior is dealt out in salted copies
    a, b = F.col("_k") + F.col("_strength0") * F.col("_mean0"), F.col("_n") - F.col("_k") + F.col("_strength0") * (1 - F.col("_mean0"))
    out = hosts.withColumn("_salt", F.pmod(F.xxhash64("_host"), F.lit(SALTS)).cast("int")).join(domain.withColumn("_salt", salts(SALTS)), ["_domain", "_salt"])
    mean = a / (a + b)
    return out.select("_host", mean.alias("_mean"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", page_id: str = "page_id", min_good: float = 0.6, **how) -> DataFrame:
    """pages with host, path, rule, verdict, good_rate and good_bound.

    outcomes: page_id, good (0 or 1; rows of null are passed over; a page is bad if any of its rows is). The longest fitting
    rule decides; else a page is allowed if its host's bound is at least min_good. Null url, or one without ://: host and path
    are empty, and the empty host has a reputation like any other. Empty tables give empty results; with no outcomes at all,
    every host has the root's uniform prior. Repeated page_ids count once for each row. Columns named like an output are replaced.
    """
    own = enclose(pages)
    u = F.col(f"in_{url}")
    own = own.withColumns({"host": host_of(u), "path": path_of(u), "_id": F.col(f"in_{page_id}")})
    own = own.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    good = outcomes.select(F.col(page_id).alias("_id"), F.col("good").cast("int").alias("_good")).filter(F.col("_good").isNotNull()).groupBy("_id").agg(F.min("_good").alias("_good"))
    known = host_reputation(own.select("_id", F.col("host").alias("_host")), good, **how)
    # a host may hold a third of the pages: its row is dealt out in salted copies
    left = own.withColumns({"_host": F.col("host"), "_salt": F.pmod(F.xxhash64(u, "_id"), F.lit(SALTS)).cast("int")})
    out = left.join(known.withColumn("_salt", salts(SALTS)), ["_host", "_salt"])
    passed = F.when(F.round("_bound", 9) >= min_good, "allow").otherwise("block")
    out = out.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), passed), "good_rate": F.col("_mean"), "good_bound": F.col("_bound")})
    return release(out, ["host", "path", "rule", "verdict", "good_rate", "good_bound"])


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("good_bound", 6).alias("good_bound"))


_LEVEL = """
  SELECT {parent}, sum(n) AS n, sum(k) AS k, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS m, sum(CASE WHEN n > 0 THEN CAST(k AS DOUBLE) * k / n ELSE 0 END) AS kk, sum(n * n) AS nn{more} FROM {child} GROUP BY ALL"""
_STRENGTH = """
  SELECT *, CASE WHEN m >= 3 AND k > 0 AND k < n AND n - CAST(nn AS DOUBLE) / n - (m - 1) > 0
    THEN CASE WHEN rho <= 0.001 THEN 999.0 WHEN rho >= 0.3 THEN 2.0 ELSE 1 / rho - 1 END ELSE 10.0 END AS s
  FROM (SELECT *, CASE WHEN m >= 3 AND k > 0 AND k < n AND n - CAST(nn AS DOUBLE) / n - (m - 1) > 0 THEN
    round(((kk - CAST(k AS DOUBLE) * k / n) / (CAST(k AS DOUBLE) * (n - k) / (CAST(n AS DOUBLE) * n)) - (m - 1)) / (n - CAST(nn AS DOUBLE) / n - (m - 1)), 6) END AS rho FROM ({level}))"""
_DOMAINS = _LEVEL.format(parent="domain, suffix", child="hosts", more="")
_SUFFIXES = _LEVEL.format(parent="suffix", child="domains", more="")
_ROOT = _LEVEL.format(parent="0 AS root", child="suffixes", more="")

OP7_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(COALESCE(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), o AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND COALESCE(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1
), h0 AS (
  SELECT host, count(good) AS n, COALESCE(sum(good), 0) AS k, string_split(host, '.') AS ps FROM p LEFT JOIN o USING (page_id) GROUP BY host
), h1 AS (
  SELECT *, CASE WHEN len(ps) >= 2 AND array_to_string(ps[-2:], '.') IN {TWO_LABEL_SUFFIXES} THEN 2 ELSE 1 END AS ns FROM h0
), hosts AS (
  SELECT host, n, k, array_to_string(ps[greatest(len(ps) - ns + 1, 1):], '.') AS suffix, array_to_string(ps[greatest(len(ps) - ns, 1):], '.') AS domain FROM h1
), domains AS ({_STRENGTH.format(level=_DOMAINS)}
), suffixes AS ({_STRENGTH.format(level=_SUFFIXES)}
), roots AS ({_STRENGTH.format(level=_ROOT)}
), s1 AS (
  SELECT suffix, (a.k + r.s * ((r.k + 1) / (r.n + 2))) / (a.n + r.s) AS mean, a.s FROM suffixes a, roots r
), d1 AS (
  SELECT domain, (d.k + s1.s * s1.mean) / (d.n + s1.s) AS mean, d.s FROM domains d JOIN s1 USING (suffix)
), ab AS (
  SELECT host, h.k + d1.s * d1.mean AS a, h.n - h.k + d1.s * (1 - d1.mean) AS b FROM hosts h JOIN d1 USING (domain)
), bounds AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM ab
), ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p JOIN bounds USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN round(bound, 9) >= 0.6 THEN 'allow' ELSE 'block' END AS verdict,
       round(bound, 6) AS good_bound
FROM ruled
"""
