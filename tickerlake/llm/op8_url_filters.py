"""URL filters: written rules first, then an empirical-Bayes reputation of the host.

Pages with a known outcome (bad or not) are counted per host.  A host's rate of bad pages is shrunk towards that
of its registered domain, the domain's towards that of its suffix, the suffix's towards the rate of all pages:
each level is a beta-binomial model whose prior has the posterior mean of the level above and a strength that the
spread among the siblings tells (by moments).  A host is blocked when even the lower posterior bound of its rate
is above the rate of all pages: it is worse than the whole beyond chance.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Normal quantile of the posterior bound (one-sided 95 %), how many times the rate of all pages a bad host's bound
#: exceeds, strength of a prior without siblings, its limits.
QUANTILE = 1.645
LIFT = 1.0
STRENGTH = 10.0
LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; nulls where none fits.  Of equally long ones the first counts."""
    name = verdict = F.lit(None).cast("string")
    for said, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _shrunk(level: DataFrame, key: str, parent: str, above: DataFrame) -> DataFrame:
    """Posterior of every unit of a level: (key, parent, n, bad, overall, a, b, mean).

    level: (key, parent, n, bad); above: (parent, mean, overall).  The strength of a parent's prior follows from its children.
    """
    counted = level.where("n > 0").groupBy(parent).agg(F.count("*").alias("k"), F.sum("n").alias("sn"), F.sum("bad").alias("sb"), F.sum(F.col("n") * F.col("n")).alias("snn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("spp"))
    rate = F.col("sb") / F.col("sn")
    spread = (F.col("spp") - F.col("sn") * rate * rate) / F.nullif(rate * (1 - rate), F.lit(0.0)) - (F.col("k") - 1)
    room = F.nullif(F.col("sn") - F.col("snn") / F.col("sn") - (F.col("k") - 1), F.lit(0.0))
    rho = F.when(F.col("k") > 1, F.least(F.greatest(spread / room, F.lit(1 / (MOST_STRENGTH + 1))), F.lit(1 / (LEAST_STRENGTH + 1))))
    strength = counted.select(parent, F.coalesce(1 / rho - 1, F.lit(STRENGTH)).alias("strength"))
    prior = above.join(strength, parent, "left").select(parent, F.col("mean").alias("prior"), "overall", F.coalesce("strength", F.lit(STRENGTH)).alias("strength"))
    a, b = F.col("strength") * F.col("prior") + F.col("bad"), F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    return level.join(prior, parent).select(key, parent, "n", "bad", "overall", a.alias("a"), b.alias("b")).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, mean, overall, lower, upper): posterior rate of bad pages with its bounds, and the rate of all pages.

    hosts: (host, n, bad), one row per host, n = 0 where nothing is known.  An empty table gives an empty result.
    """
    own = hosts.select("host", domain(F.col("host")).alias("domain"), "n", "bad")
    domains = own.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("suffix", suffix(F.col("domain")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("root", F.left("suffix", F.lit(0)))  # one value, kept a column so that levels join on keys
    root = suffixes.groupBy("root").agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean")).withColumn("overall", F.col("mean"))
    level = _shrunk(suffixes, "suffix", "root", root)
    level = _shrunk(domains, "domain", "suffix", level.select("suffix", "mean", "overall"))
    level = _shrunk(own, "host", "domain", level.select("domain", "mean", "overall"))
    total = F.col("a") + F.col("b")
    wide = QUANTILE * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return level.select("host", "mean", "overall", F.greatest(F.col("mean") - wide, F.lit(0.0)).alias("lower"), F.least(F.col("mean") + wide, F.lit(1.0)).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, lift: float = LIFT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    pages: page_id, url (further columns are ignored); outcomes: page_id, bad boolean.  Repeated pages stay and are
    each counted; a page has one outcome, bad if any of its rows says so; rows with nulls tell nothing.  Null urls
    and urls without ``://`` have an empty host, which has a reputation like any other.  No pages, no rows; without
    outcomes every host has the rate one half, whose lower bound blocks nothing.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("was_bad"))
    hosts = rows.join(known, "page_id", "left").groupBy("host").agg(F.count("was_bad").alias("n"), F.coalesce(F.sum("was_bad"), F.lit(0)).alias("bad"))
    name, verdict = best_rule(F.col("host"), F.col("path"), rules)
    told = F.when(F.col("lower") > lift * F.col("overall"), "block").otherwise("allow")
    hosts = session.stage(hosts, "hosts")  # small, read at each level
    return rows.join(reputation(hosts).select("host", "lower", "overall"), "host").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, told).alias("verdict"))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) from the labels of the documents that the pages hold: a page's path ends with its document's id."""
    number = F.try_to_number(F.regexp_extract(host_and_path(F.col("url"))[1], r"/([0-9]{1,18})(?:[/.]|$)", 1), F.lit("9" * 18)).cast("long")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return pages.select("page_id", number.alias("doc_id")).where("doc_id is not null").join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return judge(pages, outcomes(pages, common.table(spark, sf_dir, "labels")))


#: The same in DuckDB's SQL, levels written out.
def _level(name: str, key: str, parent: str, units: str, above: str) -> str:
    return f"""
{name}_counted AS (SELECT {parent}, count(*) AS k, sum(n)::DOUBLE AS sn, sum(bad)::DOUBLE AS sb, sum(n * n)::DOUBLE AS snn, sum(bad * bad / n::DOUBLE) AS spp FROM {units} WHERE n > 0 GROUP BY {parent}),
{name}_strength AS (SELECT {parent}, coalesce(1 / CASE WHEN k > 1 THEN least(greatest(((spp - sn * (sb / sn) * (sb / sn)) / nullif((sb / sn) * (1 - sb / sn), 0) - (k - 1)) / nullif(sn - snn / sn - (k - 1), 0), {1 / (MOST_STRENGTH + 1)!r}), {1 / (LEAST_STRENGTH + 1)!r}) END - 1, {STRENGTH}) AS strength FROM {name}_counted),
{name}_post AS (SELECT u.{key}, s * p.mean + bad AS a, s * (1 - p.mean) + n - bad AS b, (s * p.mean + bad) / (s + n) AS mean FROM (SELECT u.*, coalesce(strength, {STRENGTH}) AS s FROM {units} u LEFT JOIN {name}_strength USING ({parent})) u JOIN {above} p USING ({parent}))"""


ORACLE = f"""
WITH split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM split),
own AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
known AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS was_bad FROM own JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1) AS BIGINT) GROUP BY page_id),
hosts AS (SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, count(was_bad) AS n, coalesce(sum(was_bad), 0)::BIGINT AS bad FROM own LEFT JOIN known USING (page_id) GROUP BY host),
domains AS (SELECT domain, regexp_extract(domain, '[^.]*$') AS suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, '' AS root, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
root AS (SELECT root, (sum(bad) + 1) / (sum(n) + 2)::DOUBLE AS mean FROM suffixes GROUP BY root),
{_level('s', 'suffix', 'root', 'suffixes', 'root')},
{_level('d', 'domain', 'suffix', 'domains', 's_post')},
{_level('h', 'host', 'domain', 'hosts', 'd_post')},
told AS (SELECT host, CASE WHEN greatest(mean - {QUANTILE} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) > {LIFT} * (SELECT mean FROM root) THEN 'block' ELSE 'allow' END AS verdict FROM h_post),
ruled AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM own)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE verdict END AS verdict FROM ruled JOIN told USING (host)
"""
