"""URL filters with empirical-Bayes host reputation, in DataFrame functions alone.

Labelled outcomes of pages are counted for each host, registered domain and suffix. How much the rates of one level scatter
beyond chance (method of moments over the groups of that level) gives the weight of its beta prior; each level is shrunk
towards the one above it, the suffix towards the whole table. A host is blocked if the lower posterior bound of its rate of
bad pages reaches `worst`. Rules on host and path come before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.components import stored

#: (verdict, host, path) of the rules of the registered query.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
WORST = 0.5
Z = 1.6449
#: Weight of a prior whose level shows nothing to estimate it from.
PLAIN_WEIGHT = 10.0
#: Second labels that form a suffix with a country's two letters after them.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Bounds of the share of variance between groups.
LEAST_SHARE, MOST_SHARE = 0.001, 0.999


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), *_CASES), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


_CASES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, its port left aside."""
    labels = F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")
    n = F.size(labels)
    last = F.element_at(labels, -1)
    second = F.try_element_at(labels, F.lit(-2))
    taken = F.when((n >= 3) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL), 3).otherwise(2)

    def tail(k: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")

    return tail(taken), tail(taken - 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (its text and verdict; null without one); of equally long ones the first given."""
    rule = verdict = None
    for word, at, under in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(under)
        rule = F.when(fits, at + under) if rule is None else rule.when(fits, at + under)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _weight(groups: DataFrame) -> float:
    """Prior weight from the scatter of the groups' rates (`n` outcomes, `bad` of them)."""
    row = groups.where("n > 0").agg(
        F.count("*").alias("g"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("b"),
        F.sum(F.expr("cast(n as double) * n")).alias("nn"),
        F.sum(F.expr("cast(bad as double) * bad / n")).alias("bb"),
    ).first()
    if row.g < 2 or row.b in (0, row.n):
        return PLAIN_WEIGHT
    rate = row.b / row.n
    spread = rate * (1 - rate)
    room = row.n - row.nn / row.n - (row.g - 1)
    if room <= 0:
        return PLAIN_WEIGHT
    share = (row.bb - row.b * rate - spread * (row.g - 1)) / (spread * room)
    return 1 / min(max(share, LEAST_SHARE), MOST_SHARE) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per host of `pages` (page_id, host): domain, suffix, n, bad, and the lower bound `bad_bound`.

    `outcomes` (page_id, bad boolean) may hold several rows for a page or none; each counts. Outcomes with a null id, null
    `bad` or without a page are left out. With no outcome at all every rate is one half.
    """
    known = outcomes.where("bad is not null and page_id is not null")
    known = known.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    counted = pages.join(known, "page_id", "left").groupBy("host")
    counted = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "bad")))
    domain, suffix = _levels(F.col("host"))
    hosts, _ = stored(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    # A registered domain has one suffix, so the sums go up one level at a time.
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = whole.bad / whole.n if whole.n else 0.5
    k3, k2, k1 = _weight(suffixes), _weight(domains), _weight(hosts)
    suffixes = suffixes.select("suffix", ((F.col("bad") + k3 * rate) / (F.col("n") + k3)).alias("above"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", "suffix", ((F.col("bad") + k2 * F.col("above")) / (F.col("n") + k2)).alias("above")
    )
    mean = (F.col("bad") + k1 * F.col("above")) / (F.col("n") + k1)
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (F.col("n") + k1 + 1))
    return hosts.join(domains, ["domain", "suffix"]).select(
        "host", "domain", "suffix", "n", "bad", F.greatest(bound, F.lit(0.0)).alias("bad_bound")
    )


def url_filter(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[tuple[str, str, str]] = RULES,
    worst: float = WORST,
) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict` and `bad_bound` of every row of `pages`.

    A null url, or one without `://`, has an empty host and path, and the reputation of the empty host. Rows with a null id
    are judged but carry no outcome; repeated rows are judged each. Empty tables give an empty result. Columns besides id
    and url are not looked at.
    """
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = host_reputation(parts.select("page_id", "host"), outcomes).select("host", "bad_bound")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") >= worst, "block").otherwise("allow")
    return parts.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_bound"
    )


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page; labels of the same id are the pages' outcomes (bad: toxic, or quality 0)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.expr("toxic = 1 or quality = 0").alias("bad"))
    result = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes)
    return result.withColumn("bad_bound", F.round("bad_bound", 6))


def _weight_sql(groups: str) -> str:
    return f"""(SELECT CASE WHEN g < 2 OR b = 0 OR b = n OR n - nn / n - (g - 1) <= 0 THEN {PLAIN_WEIGHT}
    ELSE 1 / least(greatest((bb - b * (b / n) - (b / n) * (1 - b / n) * (g - 1))
      / ((b / n) * (1 - b / n) * (n - nn / n - (g - 1))), {LEAST_SHARE}), {MOST_SHARE}) - 1 END
  FROM (SELECT count(*) AS g, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS b,
    sum(CAST(n AS DOUBLE) * n) AS nn, sum(CAST(bad AS DOUBLE) * bad / n) AS bb FROM {groups} WHERE n > 0))"""


_SECONDS = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
OP8_SQL = rf"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_CASES[0]}', '{_CASES[1]}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), known AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE toxic = 1 OR quality = 0) AS bad
  FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id
), counted AS (
  SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad
  FROM parts LEFT JOIN known ON page_id = doc_id GROUP BY host
), split AS (
  SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM counted
), cut AS (
  SELECT *, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({_SECONDS}) THEN 3 ELSE 2 END AS k FROM split
), hosts AS (
  SELECT host, n, bad, array_to_string(l[greatest(len(l) - k + 1, 1):], '.') AS domain,
    array_to_string(l[greatest(len(l) - k + 2, 1):], '.') AS suffix FROM cut
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), whole AS (
  SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / CAST(sum(n) AS DOUBLE) ELSE 0.5 END AS rate FROM suffixes
), weights AS (
  SELECT {_weight_sql("suffixes")} AS k3, {_weight_sql("domains")} AS k2, {_weight_sql("hosts")} AS k1
), s AS (
  SELECT suffix, (bad + k3 * rate) / (n + k3) AS above FROM suffixes, weights, whole
), d AS (
  SELECT domain, suffix, (x.bad + k2 * s.above) / (x.n + k2) AS above FROM domains x JOIN s USING (suffix), weights
), h AS (
  SELECT host, n, k1, (x.bad + k1 * d.above) / (x.n + k1) AS mean FROM hosts x JOIN d USING (domain, suffix), weights
), bounds AS (
  SELECT host, greatest(mean - {Z} * sqrt(mean * (1 - mean) / (n + k1 + 1)), 0) AS bad_bound FROM h
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts JOIN bounds USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL OR bad_bound >= {WORST} THEN 'block' ELSE 'allow' END AS verdict,
  round(bad_bound, 6) AS bad_bound
FROM ruled
"""
