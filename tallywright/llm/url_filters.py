"""URL filters: allow and block rules first, host reputation for what no rule decides.

Labelled page outcomes are counted by host. A host's rate of bad pages has a beta prior
around the rate of its registered domain, that one around its suffix's, and that around
the rate of all; each level's counts leave out the child in question, so that no page counts
twice. How strong a prior is comes from the data: from the mean chance that one, and that
two pages of a host (domain, suffix) are bad, as the beta-binomial has it. A host is blocked
if the lower bound of its posterior lies above the permitted rate. Everything is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The contract's rules, as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Blocked are hosts of which at least this rate of bad pages is all but sure ...
MOST_BAD = 0.5
#: ... that is, lies so many posterior standard deviations below the mean (95 % one-sided).
DEVIATIONS = 1.645
#: Bounds of a prior's strength, in pages, and the strength where no group has two labelled pages.
WEAKEST, STRONGEST, USUAL = 1.0, 1000.0, 10.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end; A-Z become a-z."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label; with a generic one before a country's, both (``co.uk``); of an address, all of it."""
    site = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.when(site.rlike(r"^[0-9.]+$|[\[\]:]"), site).otherwise(F.regexp_extract(site, r"((?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})|[^.]*)\.?$", 1))


def domain_of(host: Column) -> Column:
    """The suffix with the label before it."""
    site = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.when(site.rlike(r"^[0-9.]+$|[\[\]:]"), site).otherwise(F.regexp_extract(site, r"((?:[^.]+\.)?(?:(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})|[^.]*))\.?$", 1))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    A rule fits its host and all subdomains whose path starts with the rule's. Of rules of one
    length the one with the longer host comes first, then block before allow. Rules are a
    short list that is compiled into the plan.
    """
    def parts(rule: str) -> tuple[str, str]:
        name, slash, rest = rule.partition("/")
        return name, slash + rest

    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -len(parts(r[1])[0]), r[0] != "block", r[1])):
        name, start = parts(rule)
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def strength(groups: DataFrame) -> float:
    """How many pages the prior of these groups (n, bad) weighs, by matching moments.

    m1 is the mean chance that a page is bad, m2 that two of a group are; groups count alike
    and those below two pages not at all. Chances are floored to billionths, so that the sums
    are exact in any order.
    """
    def mean(chance: Column) -> Column:
        return F.sum(F.floor(chance * 1e9)) / F.count(F.lit(1)) / 1e9

    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    row = groups.where(F.col("n") >= 2).agg(mean(bad / n).alias("m1"), mean(bad * (bad - 1) / (n * (n - 1))).alias("m2")).first()
    if row["m1"] is None:
        return USUAL
    spread = row["m2"] - row["m1"] * row["m1"]
    return STRONGEST if spread <= 0 else min(STRONGEST, max(WEAKEST, (row["m1"] - row["m2"]) / spread))


def reputation(sites: DataFrame) -> DataFrame:
    """``sites`` (host, n, bad) with ``rate``, the posterior mean of bad pages, and ``bound``, its lower bound."""
    sites = sites.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    domains = sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    of_host, of_domain, of_suffix = strength(sites), strength(domains), strength(suffixes)

    top = suffixes.select("suffix", F.col("n").alias("sn"), F.col("bad").alias("sb"))
    middle = domains.select("domain", "suffix", F.col("n").alias("dn"), F.col("bad").alias("db")).join(top, "suffix")
    all_but = (F.lit(whole["bad"]) - F.col("sb") + 1) / (F.lit(whole["n"]) - F.col("sn") + 2)
    suffix_rate = (of_suffix * all_but + F.col("sb") - F.col("db")) / (of_suffix + F.col("sn") - F.col("dn"))
    rated = sites.join(middle, ["domain", "suffix"]).withColumn("suffix_rate", suffix_rate)
    rated = rated.withColumn("domain_rate", (of_domain * F.col("suffix_rate") + F.col("db") - F.col("bad")) / (of_domain + F.col("dn") - F.col("n")))
    rated = rated.withColumn("rate", (of_host * F.col("domain_rate") + F.col("bad")) / (of_host + F.col("n")))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (of_host + F.col("n") + 1))
    return rated.select("host", "domain", "suffix", "n", "bad", "rate", (F.col("rate") - DEVIATIONS * deviation).alias("bound"))


def host_outcomes(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad) of every host of ``pages`` (host, key), by ``outcomes`` (key, bad).

    Pages count by host and key before they meet the outcomes, so one page that is most of
    the table is one row. Written once.
    """
    counted = pages.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"))
    labelled = F.col("bad").isNotNull()
    joined = counted.join(outcomes, "key", "left").groupBy("host").agg(
        F.sum(F.when(labelled, F.col("pages")).otherwise(0)).alias("n"), F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)).alias("bad"),
    )
    return materialise(joined, "host-outcomes")


def judge(pages: DataFrame, outcomes: DataFrame, key: Column, id_col: str = "page_id", url_col: str = "url", rules=RULES, most_bad: float = MOST_BAD) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    ``key`` gives a page's key in ``outcomes`` (key, bad), from the columns host and path; a
    null key has no outcome, nor has a key that ``outcomes`` lacks. Only hosts that are to be
    blocked meet the pages again.

    A null url or one without ``://`` has an empty host and path, which no rule fits; such
    pages share the reputation of the empty host. Repeated or null ids are judged row by row;
    repeated keys of ``outcomes`` are bad if one is; a null outcome is none. Other columns are
    ignored, an empty table has no rows, and without outcomes no host is blocked.
    """
    urls = pages.select(F.col(id_col).alias("id_"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.where(F.col("key").isNotNull() & F.col("bad").isNotNull()).groupBy("key").agg(F.max("bad").alias("bad"))
    sites = host_outcomes(urls.select("host", key.alias("key")), known)
    blocked = reputation(sites).where(F.col("bound") > most_bad).select("host", F.lit(True).alias("blocked"))
    ruled = urls.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    return ruled.join(blocked, "host", "left").select(
        F.col("id_").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
    )


def op13_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages. A page shows the document whose number is the second part of its path;
    it is bad if that document is labelled toxic or of no quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), True).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), False)
    shown = F.expr(r"try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{1,18})(?![0-9])', 1), '') AS BIGINT)")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels.select(F.col("doc_id").alias("key"), bad.alias("bad")), shown)


#: The same with the shares of every level spelled out, for DuckDB.
ORACLE_SQL = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
o AS (SELECT u.host, count(l.bad) AS n, count(*) FILTER (l.bad) AS bad FROM u LEFT JOIN l ON l.doc_id = TRY_CAST(nullif(regexp_extract(u.path, '^/[^/]*/([0-9]{1,18})(?:[^0-9]|$)', 1), '') AS BIGINT) GROUP BY u.host),
h AS (SELECT *, regexp_extract(site, '((?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})|[^.]*)\.?$', 1) AS suffix,
        regexp_extract(site, '((?:[^.]+\.)?(?:(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})|[^.]*))\.?$', 1) AS domain
      FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM o) WHERE NOT regexp_matches(site, '^[0-9.]+$|[\[\]:]')
      UNION ALL SELECT *, site, site FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM o) WHERE regexp_matches(site, '^[0-9.]+$|[\[\]:]')),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
t AS (SELECT sum(n) AS n, sum(bad) AS bad FROM s),
z AS (SELECT level, sum(floor(bad / n * 1e9)) / count(*) / 1e9 AS m1, sum(floor(bad * (bad - 1) / (n * (n - 1)) * 1e9)) / count(*) / 1e9 AS m2
      FROM (SELECT 1 AS level, CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad FROM h UNION ALL SELECT 2, n, bad FROM d UNION ALL SELECT 3, n, bad FROM s) WHERE n >= 2 GROUP BY level),
m AS (SELECT x.level, CASE WHEN m1 IS NULL THEN 10.0::DOUBLE WHEN m2 - m1 * m1 <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, (m1 - m2) / (m2 - m1 * m1))) END AS w
      FROM (SELECT unnest([1, 2, 3]) AS level) AS x LEFT JOIN z ON z.level = x.level),
w AS (SELECT max(w) FILTER (level = 1) AS wh, max(w) FILTER (level = 2) AS wd, max(w) FILTER (level = 3) AS ws FROM m),
r AS (SELECT h.host, h.n, h.bad, wh, (wd * ((ws * ((t.bad - s.bad + 1) / (t.n - s.n + 2)) + s.bad - d.bad) / (ws + s.n - d.n)) + d.bad - h.bad) / (wd + d.n - h.n) AS dr
      FROM h JOIN d ON d.domain = h.domain AND d.suffix = h.suffix JOIN s ON s.suffix = h.suffix, t, w),
p AS (SELECT host, n, wh, (wh * dr + bad) / (wh + n) AS rate FROM r),
b AS (SELECT host FROM p WHERE rate - 1.645 * sqrt(rate * (1 - rate) / (wh + n + 1)) > 0.5),
f AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
