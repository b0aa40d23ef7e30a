"""URL filters: rules first, then a reputation of hosts by empirical Bayes.

Pages that a rule decides are the labelled outcomes: block is bad, allow is good. A host's share of bad pages has a
beta prior around the estimate for its registered domain, a domain's one around that for its suffix, and a suffix's
one around the share over all pages. How strong each prior is comes from the data: the spread of the shares at that
level beyond what chance gives (method of moments). A prior leaves out the pages of what it is a prior for. A page that no rule decides is blocked if its host's share of bad
pages is above one half with a posterior chance of 95 %, that is, if the 5 % quantile of its beta distribution is.
All steps are native columns, aggregates and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, free_name, lookup_join

#: (host, start of path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Labels under which countries register domains, as in co.uk, com.sg or edu.au. With a country's two
#: letters behind them they make a suffix of two labels. Suffixes that this rule doesn't give are an argument.
CATEGORIES = ("ac", "co", "com", "edu", "gen", "go", "gob", "gov", "gub", "id", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: The least and the most pages that a prior is worth; it is never worth more than there are labelled pages.
KAPPA = (1.0, 999.0)
#: The chance with which a share has to lie above one half; beyond so many pages the normal limit takes over.
CHANCE, Z, MOST_TERMS_FOR = 0.95, 1.6448536269514722, 1e6


def host_of(url: Column) -> Column:
    """What stands behind the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_behind(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_behind(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def site_of(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """By the rule of CATEGORIES. An IP address is its own domain, with an empty suffix."""
    site = site_of(host)
    labels = F.split(site, r"\.")
    last = lambda k: F.concat_ws(".", F.slice(labels, -F.least(F.size(labels), F.lit(k)), k))
    two = last(2).rlike(f"^({'|'.join(CATEGORIES)})[.][a-z][a-z]$")
    ip = site.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[")
    suffix = F.when(ip, "").when(two, last(2)).otherwise(last(1))
    return suffix, F.when(ip, site).when(two, last(3)).otherwise(last(2))


def listed_suffixes(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, suffix, domain, ...) with both taken from the longest listed suffix (column suffix) that the host
    ends with, where there is one."""
    labels = F.split(site_of(F.col("host")), r"\.")
    n = F.size(labels)
    tail = lambda k: F.concat_ws(".", F.slice(labels, n - k + 1, k))
    tails = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), tail(k).alias("tail"), tail(F.least(n, k + 1)).alias("domain")))
    each = hosts.select("host", F.explode(tails).alias("t")).select("host", "t.*")
    met = lookup_join(each, suffixes.select(F.col("suffix").alias("tail")).distinct(), ["tail"], "inner")
    best = met.groupBy("host").agg(F.max_by(F.struct("tail", "domain"), "k").alias("listed"))
    joined = lookup_join(hosts, best, ["host"])
    own = F.coalesce(F.col("listed.tail"), F.col("suffix")), F.coalesce(F.col("listed.domain"), F.col("domain"))
    return joined.withColumns({"suffix": own[0], "domain": own[1]}).drop("listed")


def _log_gamma(z: Column) -> Column:
    """Stirling's series at z + 8, and back by the recurrence."""
    s = z + 8
    below = z
    for k in range(1, 8):
        below = below * (z + k)
    return (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * s * s * s) + 1 / (1260 * F.pow(s, F.lit(5))) - F.log(below)


def mostly_bad(a: Column, b: Column) -> Column:
    """Whether a share with the distribution Beta(a, b) is above one half with CHANCE.

    The chance to be below is the incomplete beta function at one half, a series with falling terms where a > b; where
    it isn't, the median is no more than one half."""
    n = F.least(a + b, F.lit(MOST_TERMS_FOR))
    terms = F.sequence(F.lit(0), (60 + 12 * F.sqrt(n)).cast("int"))
    one = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    add = lambda acc, k: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (a + b + k) / (2 * (a + 1 + k))).alias("term"))
    series = F.aggregate(terms, one, add)["sum"]
    below = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) - (a + b) * math.log(2)) / a * series
    normal = a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5
    return F.when(a <= b, False).when(a + b > MOST_TERMS_FOR, normal).otherwise(below <= 1 - CHANCE)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host is the url's or a parent of it, and the path starts
    with the rule's. Of equally long ones that with the longer host, then the one named last, wins; null where none
    fits. Rules are part of the plan: some hundred at most."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # the longest is asked first, as it is outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, mean: Column) -> DataFrame:
    """One row with kappa, the prior's worth in pages, from groups of n pages with bad ones among them."""
    p = F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0)
    s = groups.where("n > 0").agg(F.sum("n").cast("double").alias("all"), F.count("*").cast("double").alias("k"), F.sum(F.col("n") * (p - mean) * (p - mean)).alias("ss"))
    chance = F.col("k") / F.col("all")
    rho = (F.col("ss") / F.col("all") / (mean * (1 - mean)) - chance) / F.greatest(1 - chance, F.lit(1e-9))
    kappa = F.when(rho > 0, (1 - rho) / rho).otherwise(KAPPA[1])
    return s.select(F.greatest(F.lit(KAPPA[0]), F.least(F.lit(KAPPA[1]), F.col("all"), F.coalesce(kappa, F.lit(KAPPA[0])))).alias("kappa"))


def reputations(pages: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, a, b): for each host of pages (host, verdict or null), the beta distribution of its share of bad pages."""
    suffix, domain = suffix_and_domain(F.col("host"))
    counted = pages.groupBy("host").agg(F.count("verdict").alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"))
    hosts = counted.withColumn("suffix", suffix).withColumn("domain", domain)
    hosts = checkpointed(hosts if suffixes is None else listed_suffixes(hosts, suffixes))
    domains = checkpointed(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = checkpointed(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (total.bad + 1.0) / (total.n + 2.0)
    kappa = {name: F.lit(_strength(level, F.lit(mean)).first().kappa) for name, level in (("host", hosts), ("domain", domains), ("suffix", suffixes))}
    # A prior leaves out what it is a prior for, so that no page counts twice.
    up = suffixes.select("suffix", F.col("n").alias("n_up"), F.col("bad").alias("bad_up"))
    rest = lambda k, mean: (F.col("bad_up") - F.col("bad") + k * mean) / (F.col("n_up") - F.col("n") + k)
    domains = lookup_join(domains, up, ["suffix"]).withColumn("suffix_mean", rest(kappa["suffix"], F.lit(mean)))
    up = domains.select("domain", F.col("n").alias("n_up"), F.col("bad").alias("bad_up"), "suffix_mean")
    hosts = lookup_join(hosts, up, ["domain"]).withColumn("domain_mean", rest(kappa["domain"], F.col("suffix_mean")))
    a = F.col("bad") + kappa["host"] * F.col("domain_mean")
    b = F.col("n") - F.col("bad") + kappa["host"] * (1 - F.col("domain_mean"))
    return hosts.select("host", a.alias("a"), b.alias("b"))


def judge(pages: DataFrame, url: str = "url", rules=RULES, suffixes: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict, "allow" or "block". suffixes: a table of public
    suffixes (column suffix), whose longest that fits a host goes before the rule of CATEGORIES.

    Other columns stay, but for those named like these four, which are replaced. Null urls and urls without ://
    have an empty host, which is judged like any other; without any page that a rule decides, all are allowed. A very
    long url is read whole. Repeated pages count as often as they come; pages of one host that no rule decides get
    equal verdicts. An empty table gives no row.
    """
    new = ("host", "path", "rule", "verdict")
    clash = {c: free_name(pages, "in_" + c) for c in pages.columns if c in new and c == url}
    given = pages.withColumnsRenamed(clash)
    source = clash.get(url, url)
    given = given.drop(*(c for c in new if c != source))
    decided = given.withColumn("host", host_of(F.col(source))).withColumn("path", path_of(F.col(source)))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    decided = decided.withColumn("rule", rule).withColumn("verdict", verdict).drop(*clash.values())
    bad = free_name(decided, "mostly_bad")
    known = reputations(decided.select("host", "verdict"), suffixes).select("host", mostly_bad(F.col("a"), F.col("b")).alias(bad))
    judged = lookup_join(decided, known, ["host"])
    by_host = F.when(F.col(bad), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("verdict", by_host)).drop(bad)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
)
_VERDICTS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)


def _kappa(level: str) -> str:
    return f"""k_{level} AS (SELECT greatest({KAPPA[0]}::DOUBLE, least({KAPPA[1]}::DOUBLE, coalesce(n, {KAPPA[0]}::DOUBLE), coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho WHEN rho <= 0 THEN {KAPPA[1]}::DOUBLE END, {KAPPA[0]}::DOUBLE))) AS kappa
  FROM (SELECT n, (ss / n / (mean * (1 - mean)) - k / n) / greatest(1 - k / n, 1e-9::DOUBLE) AS rho
  FROM (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(n * (bad / n - mean) * (bad / n - mean)) AS ss, any_value(mean) AS mean FROM {level}s, total WHERE n > 0)))"""


ORACLE = f"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM parsed),
decided AS (SELECT *, CASE rule {_VERDICTS} END AS by_rule FROM ruled),
counted AS (SELECT host, count(by_rule) AS n, count(*) FILTER (WHERE by_rule = 'block') AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM decided GROUP BY host),
labelled AS (SELECT *, string_split(site, '.') AS labels, regexp_matches(site, '^([0-9]+[.]){{3}}[0-9]+$|^\\[') AS ip FROM counted),
tailed AS (SELECT *, array_to_string(labels[-1:], '.') AS one, array_to_string(labels[-2:], '.') AS two, array_to_string(labels[-3:], '.') AS three FROM labelled),
hosts AS (SELECT host, n, bad, CASE WHEN ip THEN '' WHEN regexp_matches(two, '^({"|".join(CATEGORIES)})[.][a-z][a-z]$') THEN two ELSE one END AS suffix,
  CASE WHEN ip THEN site WHEN regexp_matches(two, '^({"|".join(CATEGORIES)})[.][a-z][a-z]$') THEN three ELSE two END AS domain FROM tailed),
domains AS (SELECT domain, any_value(suffix) AS suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain),
suffixs AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
total AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS mean FROM suffixs),
{_kappa("host")}, {_kappa("domain")}, {_kappa("suffix")},
s AS (SELECT d.domain, d.n, d.bad, (u.bad - d.bad + kappa * mean) / (u.n - d.n + kappa) AS m FROM domains AS d JOIN suffixs AS u USING (suffix), total, k_suffix),
d AS (SELECT hosts.host, (s.bad - hosts.bad + kappa * m) / (s.n - hosts.n + kappa) AS m FROM hosts JOIN s USING (domain), k_domain),
h AS (SELECT host, bad + kappa * m AS a, n - bad + kappa * (1 - m) AS b FROM hosts JOIN d USING (host), k_host),
judged AS (SELECT host, CASE WHEN a <= b THEN false
  WHEN a + b > {MOST_TERMS_FOR}::DOUBLE THEN a / (a + b) - {Z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5::DOUBLE
  ELSE list_sum(list_transform(range(0, (60 + 12 * sqrt(a + b))::BIGINT), lambda k: exp(lgamma(a + b + k) - lgamma(b) - lgamma(a + 1 + k) - (a + b + k) * ln(2::DOUBLE)))) <= 1 - {CHANCE}::DOUBLE END AS bad FROM h)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM decided JOIN judged USING (host)"""
