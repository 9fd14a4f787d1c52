"""URL filters: rules first, then an empirical-Bayes reputation of hosts (op12).

A page is judged by the longest rule that fits its url; where none fits, by its host's share of bad pages, of which labels
tell only a few.  The shares are shrunk down a tree: every suffix (`com`) towards the corpus, every registered domain
(`example.com`) towards its suffix, every host towards its domain.  On each level the counts k of n are beta-binomial about
the mean m of the level above, with one correlation rho of the level, by moments:

    rho = sum((k - n m)^2 - n m (1 - m)) / sum(n (n - 1) m (1 - m)),    strength s = 1 / rho - 1

and the mean passed on is (k + s m) / (n + s).  A host's posterior is Beta(s m + k, s (1 - m) + n - k); the host is blocked if
its lower bound, `z` standard deviations under the mean, is over `most_bad`.  A host without labelled pages has the
posterior of its prior, so few labels never block by themselves.

Everything is a grouped aggregation: pages are counted by host, hosts by domain, domains by suffix.  Moments are a few sums
of a level.  One host may have any share of the pages: counts combine before the shuffle, and verdicts come back by a
broadcast of hosts (counted before) or a join salted by page.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule and the reputation of the empty host.
Repeated pages are judged row by row and count row by row; repeated labels of one id count once, bad if any is.  Labels with
null in both columns and labels without page tell nothing.  No labels at all: nothing is blocked but by rules.  Hosts are
compared as written (user and port included); a domain is taken without them.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import ascii_lower, stored

#: (verdict, host, path) as in `block example.org/es/`.
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Names under which countries register domains, fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")
Z, MOST_BAD = 1.645, 0.4
#: Bounds of a level's correlation: at the lower one counts of thousands are needed to leave the mean of the level above.
LEAST_RHO, MOST_RHO = 0.0001, 0.9
BROADCAST_ROWS = 200_000
SALTS = 32


def host(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(after, F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain(host: Column) -> Column:
    """The registered domain: the last two names, three under names such as `co.uk`; a host of fewer names, or of digits, whole."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    names = F.split(bare, r"\.")
    n = F.size(names)
    last, second = F.get(names, n - 1), F.get(names, n - 2)
    long = (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    take = F.when(long, 3).otherwise(2)
    whole = (n <= take) | bare.rlike(r"^[0-9.]*$")
    return F.when(whole, bare).otherwise(F.array_join(F.slice(names, n - take + 1, take), "."))


def suffix(domain: Column) -> Column:
    """What follows the first name of a registered domain; empty for a domain of one name or of digits."""
    return F.when(domain.rlike(r"^[0-9.]*$"), "").otherwise(F.regexp_extract(domain, r"(?s)^[^.]*\.(.*)$", 1))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct (name, verdict); of equally long ones that of the longer host, then the first."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = F.lit(None)
    for verdict, name, start in reversed(order):
        inside = (host == name) | host.endswith("." + name)
        fits = F.when(inside & path.startswith(start), F.struct(F.lit(name + start).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _level(groups: DataFrame) -> DataFrame:
    """groups (n, k, mean of the level above) with the level's strength and their own shrunk share."""
    n, k, m = F.col("n"), F.col("k"), F.col("mean")
    spread = m * (1 - m)
    rho = F.try_divide(F.sum((k - n * m) * (k - n * m) - n * spread), F.sum(n * (n - 1) * spread))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0e0)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    one = groups.agg(F.round(1 / rho - 1, 6).alias("strength"))
    return groups.join(one).withColumn("share", (k + F.col("strength") * m) / (n + F.col("strength")))  # joins one row


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts (host, n labelled pages, k bad ones) with domain, suffix, posterior (a, b) and its mean `share`."""
    hosts = hosts.withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain")))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    corpus = suffixes.agg(F.coalesce(F.try_divide(F.sum("k"), F.sum("n")), F.lit(0e0)).alias("mean"))
    above = _level(suffixes.join(corpus)).select("suffix", F.col("share").alias("mean"))
    above = _level(domains.join(above, "suffix")).select("domain", F.col("share").alias("mean"))
    out = _level(hosts.join(above, "domain"))
    a, b = F.col("strength") * F.col("mean") + F.col("k"), F.col("strength") * (1 - F.col("mean")) + F.col("n") - F.col("k")
    return out.withColumn("a", a).withColumn("b", b)


def lower_bound(z: float) -> Column:
    """`z` standard deviations under the mean of Beta(a, b); 0 where a or b is."""
    a, b = F.col("a"), F.col("b")
    total = a + b
    return F.coalesce(F.try_divide(a, total) - z * F.sqrt(F.try_divide(a * b, total * total * (total + 1))), F.lit(0e0))


def outcomes(labels: DataFrame) -> DataFrame:
    """page_id and bad (0 or 1) from rows of labels whose id is that of a page: bad is low quality or toxic."""
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def filtered(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, most_bad: float = MOST_BAD, z: float = Z, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and host_blocked (the reputation's own verdict) of every row of pages (page_id, url).

    outcomes: page_id (unique) and bad.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    told = rows.join(outcomes, "page_id", "left")
    counts = told.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    judged = reputations(stored(counts, "url-hosts"))
    judged = stored(judged.select("host", (F.round(lower_bound(z), 9) > most_bad).alias("host_blocked")), "url-reputations")
    if judged.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(judged), "host")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
        rows = salted.join(judged.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"]).drop("salt")
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("host_blocked"), "block").otherwise("allow")
    rows = rows.withColumn("fits", rule)
    return rows.select("page_id", "host", "path", F.col("fits.name").alias("rule"), F.coalesce("fits.verdict", own).alias("verdict"), "host_blocked")


def _level_sql(name: str, source: str) -> str:
    return (
        f"{name}_s AS (SELECT round(1 / least(greatest(coalesce(sum((k - n * mean) * (k - n * mean) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0e0), {LEAST_RHO}e0), {MOST_RHO}e0) - 1, 6) AS strength FROM {source}),"
        f" {name} AS (SELECT *, (k + strength * mean) / (n + strength) AS share FROM {source}, {name}_s)"
    )


SQL = (
    r"""WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') AS bare FROM v LEFT JOIN l USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(bare, '.') AS names, len(string_split(bare, '.')) AS parts FROM h0),
h2 AS (SELECT *, CASE WHEN length(names[parts]) = 2 AND parts > 1 AND names[parts - 1] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'or', 'org') THEN 3 ELSE 2 END AS take FROM h1),
h3 AS (SELECT host, n, k, CASE WHEN parts <= take OR regexp_full_match(bare, '[0-9.]*') THEN bare ELSE array_to_string(names[parts - take + 1 : parts], '.') END AS domain FROM h2),
h AS (SELECT *, CASE WHEN regexp_full_match(domain, '[0-9.]*') OR NOT contains(domain, '.') THEN '' ELSE substr(domain, strpos(domain, '.') + 1) END AS suffix FROM h3),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2), s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY 1),
s1 AS (SELECT s0.*, (SELECT coalesce(sum(k) / nullif(sum(n), 0)::DOUBLE, 0e0) FROM s0) AS mean FROM s0), """
    + _level_sql("s", "s1")
    + ", d1 AS (SELECT d0.*, s.share AS mean FROM d0 JOIN s USING (suffix)), " + _level_sql("d", "d1")
    + ", g1 AS (SELECT h.*, d.share AS mean FROM h JOIN d USING (domain)), " + _level_sql("g", "g1")
    + f""", b AS (SELECT host, strength * mean + k AS a, strength * (1 - mean) + n - k AS b, strength + n AS t FROM g),
r AS (SELECT host, round(coalesce(a / nullif(t, 0) - {Z}e0 * sqrt(a * b / nullif(t * t * (t + 1), 0)), 0e0), 9) > {MOST_BAD}e0 AS blocked FROM b),
f AS (SELECT v.*, blocked, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
 WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM v JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict FROM f"""
)
