"""URL filters by empirical-Bayes host reputation: beta-binomial shrinkage from host to registered domain to suffix.

Labelled pages give each host good and bad outcomes. A suffix's share of good pages is shrunk to the share of all
pages, a registered domain's to its suffix, a host's to its domain. How strongly is fitted from the data: the
concentration of each level's beta prior comes from the method of moments over the groups of that level. A host is
blocked where the upper bound of its posterior, mean + z standard deviations, stays below a floor; hosts without
labels stand at their domain's prior. Fixed rules on host and path come first; the longest that fits decides.

Defined results: a null url, or one without ://, has empty host and path, no rule, and the reputation of that empty
host; labels with a null quality do not count; repeated pages keep their own rows and each label counts once for each
host of its page; without any label every host stands at an even prior and passes; an address in numbers is a domain of
its own, under the empty suffix; urls of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import table, write_shared

#: (rule, verdict): host and path together, the path from the first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of two labels under which names are registered, where no table of suffixes is given; others are the last label.
SUFFIXES = ("co.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
Z = 1.64
FLOOR = 0.5
#: Bounds of a prior's concentration, in labelled pages.
CONCENTRATION = (2.0, 50.0)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of_host, slash, of_path = name.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(slash + of_path))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def by_numbers(host: Column) -> Column:
    return host.rlike(r"^\d+\.\d+\.\d+\.\d+$") | F.startswith(host, F.lit("["))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(by_numbers(host), "").when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(by_numbers(host), host).when(two.isin(*suffixes), three).otherwise(two)


def with_domains(hosts: DataFrame, bare: Column, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (host and more) with domain and suffix: of a table (suffix) the longest that ends the host, else by SUFFIXES.

    A host asks for each of its own endings, a row each, so the table may be of any length.
    """
    if suffixes is None:
        return hosts.withColumns({"domain": domain_of(bare), "suffix": suffix_of(bare)})
    split = hosts.withColumn("_bare", bare).withColumn("_parts", F.split("_bare", r"\."))
    ends = split.select("host", "_bare", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("_n")).withColumn("suffix", F.expr("substring_index(_bare, '.', -_n)"))
    longest = ends.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.max("_n").alias("_n"))
    out = split.join(longest, "host", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return out.withColumns({
        "domain": F.when(by_numbers(F.col("_bare")), F.col("_bare")).otherwise(F.expr("substring_index(_bare, '.', -_n - 1)")),
        "suffix": F.when(by_numbers(F.col("_bare")), "").otherwise(F.expr("substring_index(_bare, '.', -_n)")),
    }).drop("_bare", "_parts", "_n")


def concentration(groups: DataFrame, n: str, good: str, mean: str) -> Column:
    """An aggregate over groups: the fitted concentration of beta-binomial counts around their given means.

    The expected squared error of a group's share is mean (1 - mean) / n * (1 + (n - 1) rho), rho = 1 / (k + 1).
    """
    spread = F.col(mean) * (1 - F.col(mean))
    error = F.sum((F.col(good) - F.col(n) * F.col(mean)) * (F.col(good) - F.col(n) * F.col(mean)) / F.col(n) - spread)
    weight = F.sum((F.col(n) - 1) * spread)
    rho = F.when(weight > 0, error / weight)
    k = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(CONCENTRATION[1]))
    return F.least(F.greatest(F.coalesce(k, F.lit(CONCENTRATION[1])), F.lit(CONCENTRATION[0])), F.lit(CONCENTRATION[1]))


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts (host, domain, suffix, n, good) with the posterior `a`, `b` of each host's share of good pages."""

    def level(groups: DataFrame, parent: Column) -> DataFrame:
        """groups with n, good and the prior mean `parent`; adds `post`, the posterior mean, and `k`, the concentration."""
        groups = groups.withColumn("parent", parent)
        k = groups.where("n > 0").agg(concentration(groups, "n", "good", "parent")).first()[0]
        return groups.withColumn("k", F.lit(float(k))).withColumn("post", (F.col("parent") * F.col("k") + F.col("good")) / (F.col("k") + F.col("n")))

    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    suffixes = level(suffixes, F.lit((good + 1) / (n + 2))).select("suffix", F.col("post").alias("of_suffix"))
    domains = level(domains.join(suffixes, "suffix"), F.col("of_suffix")).select("domain", F.col("post").alias("of_domain"))
    found = level(hosts.join(domains, "domain"), F.col("of_domain"))
    return found.select("host", "n", "good", (F.col("parent") * F.col("k") + F.col("good")).alias("a"), ((1 - F.col("parent")) * F.col("k") + F.col("n") - F.col("good")).alias("b"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, z: float = Z, floor: float = FLOOR, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and upper (the bound) of pages (page_id, url); labels: doc_id, quality, toxic;
    suffixes: the endings under which names are registered (suffix), as published lists have them."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    outcome = labels.where("quality is not null").select(F.col("doc_id").alias("_id"), F.expr("cast(quality = 1 and coalesce(toxic, 0) = 0 as long)").alias("_good"))
    labelled = parsed.select("page_id", "host").distinct().join(outcome, F.col("page_id") == F.col("_id"))
    counts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("_good").alias("good"))
    bare = F.regexp_replace(F.substring_index("host", "@", -1), r":\d*$", "")
    hosts = parsed.select("host").distinct().join(counts, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    hosts = with_domains(hosts, bare, suffixes)
    # few rows beside the pages, and read once for each level above them
    hosts = pages.sparkSession.read.parquet(write_shared(hosts, "hosts"))
    a, b = F.col("a"), F.col("b")
    known = reputations(hosts).select("host", (a / (a + b) + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("upper"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    of_host = F.when(F.col("upper") < floor, "block").otherwise("allow")
    return parsed.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, of_host).alias("verdict"), "upper")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_pages(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT doc_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g FROM labels WHERE quality IS NOT NULL),
c AS (SELECT host, count(*)::DOUBLE AS n, sum(g) AS good FROM (SELECT DISTINCT page_id, host FROM q) JOIN l ON page_id = doc_id GROUP BY host),
h0 AS (SELECT DISTINCT host, regexp_replace(CASE WHEN host LIKE '%@%' THEN regexp_extract(host, '([^@]*)$', 1) ELSE host END, ':[0-9]*$', '') AS bare FROM q),
h AS (SELECT h0.host, CASE WHEN bare SIMILAR TO '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+' OR bare LIKE '[%' THEN bare WHEN regexp_extract(bare, '([^.]*\\.)?[^.]*$', 0) IN {SUFFIXES} THEN regexp_extract(bare, '([^.]*\\.)?([^.]*\\.)?[^.]*$', 0) ELSE regexp_extract(bare, '([^.]*\\.)?[^.]*$', 0) END AS domain,
  CASE WHEN bare SIMILAR TO '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+' OR bare LIKE '[%' THEN '' WHEN regexp_extract(bare, '([^.]*\\.)?[^.]*$', 0) IN {SUFFIXES} THEN regexp_extract(bare, '([^.]*\\.)?[^.]*$', 0) ELSE regexp_extract(bare, '[^.]*$', 0) END AS suffix,
  coalesce(n, 0) AS n, coalesce(good, 0) AS good FROM h0 LEFT JOIN c USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY suffix),
w AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS m FROM s),
s1 AS (SELECT s.*, m FROM s, w),
sr AS (SELECT sum((good - n * m) * (good - n * m) / n - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM s1 WHERE n > 0),
sk AS (SELECT least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {CONCENTRATION[1]}::DOUBLE END, {CONCENTRATION[0]}::DOUBLE), {CONCENTRATION[1]}::DOUBLE) AS k FROM sr),
s2 AS (SELECT suffix, (m * k + good) / (k + n) AS m FROM s1, sk),
d1 AS (SELECT d.*, m FROM d JOIN s2 USING (suffix)),
dr AS (SELECT sum((good - n * m) * (good - n * m) / n - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM d1 WHERE n > 0),
dk AS (SELECT least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {CONCENTRATION[1]}::DOUBLE END, {CONCENTRATION[0]}::DOUBLE), {CONCENTRATION[1]}::DOUBLE) AS k FROM dr),
d2 AS (SELECT domain, (m * k + good) / (k + n) AS m FROM d1, dk),
h1 AS (SELECT h.*, m FROM h JOIN d2 USING (domain)),
hr AS (SELECT sum((good - n * m) * (good - n * m) / n - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM h1 WHERE n > 0),
hk AS (SELECT least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {CONCENTRATION[1]}::DOUBLE END, {CONCENTRATION[0]}::DOUBLE), {CONCENTRATION[1]}::DOUBLE) AS k FROM hr),
r AS (SELECT host, m * k + good AS a, (1 - m) * k + n - good AS b FROM h1, hk),
v AS (SELECT host, CASE WHEN a / (a + b) + {Z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {FLOOR}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM r),
t AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE verdict END AS verdict
FROM t JOIN v USING (host)
"""
