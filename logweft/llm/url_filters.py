"""URL filters: explicit rules, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are counted by host, and shrunk down a chain of beta-binomial priors: all pages -> suffix ->
registered domain -> host. How strongly each level pulls is estimated from the counts (the moment estimator of the
intra-class correlation). A host passes if the lower bound of its posterior reaches a limit; the bound is that of the
normal distribution with the posterior's mean and variance.

Defined cases: a null url, or one without "://", has an empty host and path; such pages share the host "". An IPv4
address is its own domain and suffix. A host without outcomes gets the posterior of its domain, a domain without
outcomes that of its suffix, and so on up to the mean of all outcomes (0.5 without any). Null outcomes don't count;
repeated rows count each time; of rules of one length the first in the order of their texts counts; an empty table gives
an empty one. Extra columns of pages are kept by judge(), and its own get a number behind where a name is taken.

A host's verdict is joined to its pages: sent to all tasks if there are at most HOSTS hosts, else by a join on the host,
which adaptive execution splits where one host has a large share of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, quoted, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A registered domain has one label more than its suffix. Suffixes of two labels, by their usual second level.
IPV4 = r"^[0-9]+(\.[0-9]+){3}$"
SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Normal quantile of the bound, the limit that it must reach, and bounds of the prior's weight in pages.
Z, LIMIT, WEIGHT = 1.645, 0.6, (2.0, 1000.0)
#: Verdicts are sent to all tasks for so many hosts at most.
HOSTS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = url.cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F, F
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(what))
    if rule is F:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _levels(df: DataFrame) -> DataFrame:
    host = F.regexp_replace("__host", ":[0-9]*$", "")
    labels = F.when(host.rlike(IPV4), F.array(host)).otherwise(F.split(host, "\\."))
    n = F.size(labels)
    two = (n > 2) & F.element_at(labels, -2).isin(*SECOND_LEVELS) & (F.length(F.element_at(labels, -1)) == 2)
    k = F.when(two, 2).otherwise(1)
    last = lambda m: F.concat_ws(".", F.slice(labels, F.greatest(n - m + 1, F.lit(1)), m))
    return df.withColumn("__suffix", last(k)).withColumn("__domain", last(k + 1))


def _weight(groups: DataFrame, name: str) -> DataFrame:
    """One row: the prior's weight in pages, from n and good (y) of the groups of a level, by moments."""
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    sums = groups.agg(F.sum(n).alias("n"), F.sum(y).alias("y"), F.sum(n * n).alias("nn"), F.sum(y * y / n).alias("q"), F.count("*").cast("double").alias("k"))
    p = F.expr("y / n")
    spread = F.expr("q - y * y / n") / (p * (1 - p)) - (F.col("k") - 1)
    rho = F.try_divide(spread, F.expr("n - nn / n") - (F.col("k") - 1))
    weight = F.when(rho > 0, F.try_divide(1 - rho, rho)).otherwise(F.lit(WEIGHT[1]))
    return sums.select(F.coalesce(F.greatest(F.lit(WEIGHT[0]), F.least(F.lit(WEIGHT[1]), F.when((F.col("y") > 0) & (F.col("y") < F.col("n")), weight))), F.lit(WEIGHT[1])).alias(name))


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """hosts (__host): all hosts to judge, once each; outcomes (__host, good 0/1). Returns __host, __n, __mean, __bound, __verdict."""
    by_host = outcomes.filter(F.col("good").isNotNull()).groupBy("__host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("y"))
    # Read by each level and each prior: written once.
    by_host, _ = cut(_levels(by_host), "hosts-outcomes")
    by_domain = by_host.groupBy("__domain", "__suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    by_suffix = by_domain.groupBy("__suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    every = by_suffix.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).select(F.coalesce(F.expr("try_divide(y, n)"), F.lit(0.5)).alias("__p"))
    # One row each: an aggregate without keys never has more.
    fixed = every.join(_weight(by_suffix, "__w1"), how="cross").join(_weight(by_domain, "__w2"), how="cross").join(_weight(by_host, "__w3"), how="cross")
    named = lambda df, k, tag: df.select(k, F.col("n").alias(f"__n{tag}"), F.col("y").alias(f"__y{tag}"))
    df = _levels(hosts).join(named(by_host, "__host", 3), "__host", "left").join(named(by_domain, "__domain", 2), "__domain", "left").join(named(by_suffix, "__suffix", 1), "__suffix", "left").join(F.broadcast(fixed), how="cross")
    mean = F.col("__p")
    for k in (1, 2, 3):
        n, y, w = F.coalesce(F.col(f"__n{k}"), F.lit(0)), F.coalesce(F.col(f"__y{k}"), F.lit(0)), F.col(f"__w{k}")
        df = df.withColumn(f"__m{k}", (w * mean + y) / (w + n))
        mean = F.col(f"__m{k}")
    total = F.col("__w3") + F.coalesce(F.col("__n3"), F.lit(0))
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    return df.select("__host", F.coalesce(F.col("__n3"), F.lit(0)).alias("__n"), mean.alias("__mean"), bound.alias("__bound"), F.when(bound >= limit, "allow").otherwise("block").alias("__verdict"))


def judge(pages: DataFrame, outcomes: DataFrame, *, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """pages with host, path, rule, verdict, mean, bound. outcomes: (__host, good)."""
    # The whole row as one value, so that none of its names can clash.
    host, path = host_and_path(F.col(quoted(url)[0]))
    df = pages.select(F.struct(*quoted(*pages.columns)).alias("__row"), host.alias("__host"), path.alias("__path"))
    rule, said = rule_of(F.col("__host"), F.col("__path"), rules)
    df = df.select("*", rule.alias("__rule"), said.alias("__said"))
    known, _ = cut(reputation(df.select("__host").distinct(), outcomes, z, limit), "hosts-verdicts")
    if known.limit(HOSTS + 1).count() <= HOSTS:
        known = F.broadcast(known)
    out, names = df.join(known, "__host", "left").withColumn("__verdict", F.coalesce("__said", "__verdict")), list(pages.columns)
    new = []
    for n in ("host", "path", "rule", "verdict", "mean", "bound"):
        new.append(free(n, names))
        names.append(new[-1])
    return out.select("__row.*", *[F.col(f"__{n}").alias(m) for n, m in zip(("host", "path", "rule", "verdict", "mean", "bound"), new, strict=True)])


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(__host, good): the quality label of the document whose number stands behind the page's language folder."""
    host, path = host_and_path(F.col("url"))
    number = F.expr("try_cast(regexp_extract(__path, '^/[^/]*/([0-9]+)', 1) AS BIGINT)")
    numbered = pages.select(host.alias("__host"), path.alias("__path")).select("__host", number.alias("__doc"))
    return numbered.join(labels.select(F.col("doc_id").alias("__doc"), F.col("quality").alias("good")), "__doc").select("__host", "good")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _level_sql() -> str:
    two = f"len(l) > 2 AND l[-2] IN ({', '.join(repr(x) for x in SECOND_LEVELS)}) AND length(l[-1]) = 2"
    last = lambda m: f"array_to_string(l[greatest(len(l) - {m} + 1, 1):], '.')"
    return f"CASE WHEN {two} THEN {last(2)} ELSE {last(1)} END AS suffix, CASE WHEN {two} THEN {last(3)} ELSE {last(2)} END AS domain"


def _weight_sql(level: str) -> str:
    lo, hi = WEIGHT
    return f"""(SELECT coalesce(greatest({lo}, least({hi}, CASE WHEN y > 0 AND y < n THEN CASE WHEN rho > 0 THEN (1 - rho) / rho ELSE {hi} END END)), {hi})
      FROM (SELECT n, y, CASE WHEN y > 0 AND y < n AND (n - nn / n) - (k - 1) <> 0 THEN ((q - y * y / n) / ((y / n) * (1 - y / n)) - (k - 1)) / ((n - nn / n) - (k - 1)) END AS rho
      FROM (SELECT sum(n::DOUBLE) n, sum(y::DOUBLE) y, sum(n::DOUBLE * n) nn, sum(y::DOUBLE * y / n) q, count(*)::DOUBLE k FROM {level})))"""


def _rule_sql(value: str) -> str:
    cases = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value == 'rule' else what}'" for what, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    return f"CASE{cases} END"


SQL = f"""
WITH cutoff AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cutoff),
outcomes AS (SELECT host, quality AS good FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '^/[^/]*/([0-9]+)', 1), '') AS BIGINT) AS doc FROM parts) p JOIN labels ON doc_id = doc WHERE quality IS NOT NULL),
split_hosts AS (SELECT host, CASE WHEN regexp_matches(bare, '{IPV4}') THEN [bare] ELSE string_split(bare, '.') END AS l
  FROM (SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS bare FROM parts)),
hosts AS (SELECT host, {_level_sql()} FROM split_hosts),
by_host AS (SELECT host, domain, suffix, n, y FROM (SELECT host, count(*) n, sum(good)::BIGINT y FROM outcomes GROUP BY host) JOIN hosts USING (host)),
by_domain AS (SELECT domain, suffix, sum(n) n, sum(y) y FROM by_host GROUP BY domain, suffix),
by_suffix AS (SELECT suffix, sum(n) n, sum(y) y FROM by_domain GROUP BY suffix),
fixed AS (SELECT coalesce((SELECT sum(y)::DOUBLE / sum(n) FROM by_suffix), 0.5) AS p, {_weight_sql("by_suffix")} AS w1, {_weight_sql("by_domain")} AS w2, {_weight_sql("by_host")} AS w3),
m1 AS (SELECT h.*, f.*, (w1 * p + coalesce(s.y, 0)) / (w1 + coalesce(s.n, 0)) AS mean1 FROM hosts h CROSS JOIN fixed f LEFT JOIN by_suffix s ON s.suffix = h.suffix),
m2 AS (SELECT m1.*, (w2 * mean1 + coalesce(d.y, 0)) / (w2 + coalesce(d.n, 0)) AS mean2 FROM m1 LEFT JOIN by_domain d ON d.domain = m1.domain),
m3 AS (SELECT m2.host, w3 + coalesce(b.n, 0) AS total, (w3 * mean2 + coalesce(b.y, 0)) / (w3 + coalesce(b.n, 0)) AS mean3 FROM m2 LEFT JOIN by_host b ON b.host = m2.host),
verdicts AS (SELECT host, CASE WHEN mean3 - {Z} * sqrt(mean3 * (1 - mean3) / (total + 1)) >= {LIMIT} THEN 'allow' ELSE 'block' END AS verdict FROM m3)
SELECT page_id, host, path, {_rule_sql("rule")} AS rule, coalesce({_rule_sql("verdict")}, verdict) AS verdict FROM parts LEFT JOIN verdicts USING (host)
"""
