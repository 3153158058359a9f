"""Keyword routing of questions and its evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from evidora import constants as K
from evidora.functions.text import fold

WHEN_CHAIN_KEYWORDS = 200
# Keywords of a rule table that every text is asked for first.
LEADING_KEYWORDS = 200
# Length of the character runs by which keywords of a table meet texts.
GRAM = 3


@dataclass(frozen=True)
class Rule:
    route: str
    keywords: tuple[str, ...]


DEFAULT_RULES = tuple(Rule(route, tuple(words)) for route, words in K.ROUTE_KEYWORDS)


def rules_from_table(rules: DataFrame) -> tuple[Rule, ...]:
    """Read a rule table (priority, route, keyword), which is configuration, into rules."""
    grouped: dict[tuple[int, str], list[str]] = {}
    for row in rules.orderBy("priority", "route", "keyword").toLocalIterator():
        grouped.setdefault((row["priority"], row["route"]), []).append(row["keyword"])
    return tuple(Rule(route, tuple(words)) for (_, route), words in grouped.items())


def _hit(folded: Column, keyword: Column, word_boundary: bool) -> Column:
    if word_boundary:
        return F.regexp_like(folded, F.concat(F.lit(r"(?U)(?<!\w)\Q"), keyword, F.lit(r"\E(?!\w)")))
    return folded.contains(keyword)


def route(
    text: Column,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    *,
    default: str = K.DEFAULT_ROUTE,
    word_boundary: bool = False,
) -> Column:
    """Route of a text: the first rule with any keyword in the folded text, else the default.

    Keywords match inside words unless ``word_boundary`` is set. Short rule lists become one CASE
    chain; longer ones one pass over a constant list, which keeps the generated code small.
    """
    return _first_hit(fold(text), rules, default=default, word_boundary=word_boundary)


def _first_hit(
    folded: Column, rules: tuple[Rule, ...], *, default: str = K.DEFAULT_ROUTE, word_boundary: bool = False
) -> Column:
    if sum(len(r.keywords) for r in rules) <= WHEN_CHAIN_KEYWORDS:
        chain = None
        for rule in rules:
            hit = F.lit(False)
            for keyword in rule.keywords:
                hit = hit | _hit(folded, F.lit(keyword.lower()), word_boundary)
            chain = F.when(hit, rule.route) if chain is None else chain.when(hit, rule.route)
        return F.lit(default) if chain is None else chain.otherwise(default)
    listed = F.array(
        *[
            F.struct(F.lit(r.route).alias("route"), F.array(*[F.lit(k.lower()) for k in r.keywords]).alias("words"))
            for r in rules
        ]
    )
    hits = F.filter(listed, lambda r: F.exists(r["words"], lambda w: _hit(folded, w, word_boundary)))
    return F.coalesce(F.get(hits, F.lit(0))["route"], F.lit(default))


def with_route(
    df: DataFrame, text: str, rules: tuple[Rule, ...] = DEFAULT_RULES, *, name: str = "route", **options
) -> DataFrame:
    """Add the route of a text column. The text is folded once per row, not once per keyword."""
    folded = df.withColumn("__folded", fold(F.col(text)))
    return folded.withColumn(name, _first_hit(F.col("__folded"), rules, **options)).drop("__folded")


def _grams(text: Column) -> Column:
    """Distinct runs of GRAM characters of a text and all their beginnings, the empty one among them."""
    # Blanks at the end let the last characters begin a run too; what they add is checked like everything else.
    whole = F.array_distinct(
        F.regexp_extract_all(F.concat(text, F.lit(" " * GRAM)), F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    )

    def beginnings(n: int) -> Column:
        return F.array_distinct(F.transform(whole, lambda g: F.substring(g, 1, n)))

    return F.array_distinct(F.concat(whole, *map(beginnings, range(1, GRAM)), F.array(F.lit(""))))


def keyword_keys(rules: DataFrame) -> DataFrame:
    """The rules with the `gram` by which each keyword is looked up: the run of GRAM characters that the fewest keywords hold.

    Keywords of fewer characters are their own key; rules without a keyword are left out.
    """
    words = rules.select(fold(F.col("keyword")).alias("keyword")).where("keyword IS NOT NULL").distinct()
    runs = F.array_distinct(F.regexp_extract_all("keyword", F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    spread = words.select("keyword", F.explode(F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(runs)).alias("gram"))
    held = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rarest = spread.join(held, "gram").groupBy("keyword").agg(F.min(F.struct("held", "gram"))["gram"].alias("gram"))
    named = rules.select("priority", "route", fold(F.col("keyword")).alias("keyword"))
    return named.groupBy("keyword").agg(F.min(F.struct("priority", "route")).alias("rule")).join(rarest, "keyword")


def with_route_from_table(
    df: DataFrame,
    text: str,
    rules: DataFrame,
    *,
    name: str = "route",
    default: str = K.DEFAULT_ROUTE,
    word_boundary: bool = False,
) -> DataFrame:
    """Add the route of a text column by a rule table (priority, route, keyword) of any size.

    The rule of the smallest priority, then route, with a keyword in the folded text wins, as in a chain of its rules. The first
    LEADING_KEYWORDS in that order are looked for where a text lies: none of the others can win over one of them, so a text that
    holds one is settled. Only the other texts meet the other keywords, by equality of one character run per keyword; narrow
    rows move for that, and the few keywords found for a text are looked for in it when it is joined with them. Equal texts
    share one list. A null text and a text without a keyword get the default.
    """
    named = rules.select("priority", "route", fold(F.col("keyword")).alias("keyword")).where("keyword IS NOT NULL").distinct()
    leading = named.orderBy("priority", "route", "keyword").limit(LEADING_KEYWORDS + 1).collect()
    more, leading = len(leading) > LEADING_KEYWORDS, leading[:LEADING_KEYWORDS]
    keyed = df.withColumn("__folded", fold(F.col(text)))
    keyed = keyed.withColumn("__hit", _leading_hit(F.col("__folded"), leading, word_boundary))
    at_once = keyed.withColumn(name, F.coalesce(F.col("__hit.route"), F.lit(default))).drop("__folded", "__hit")
    if not more:
        return at_once
    settled = keyed.filter(F.col("__hit").isNotNull()).withColumn(name, F.coalesce(F.col("__hit.route"), F.lit(default)))
    others = keyed.filter(F.col("__hit").isNull()).withColumn("__text", F.md5("__folded"))
    grams = others.select("__text", F.explode(_grams(F.col("__folded"))).alias("gram"))
    left = named.filter(~F.col("keyword").isin([r["keyword"] for r in leading]))
    found = grams.join(keyword_keys(left), "gram").groupBy("__text").agg(
        F.collect_set(F.struct("rule", "keyword")).alias("__found")
    )
    hits = F.filter("__found", lambda r: _hit(F.col("__folded"), r["keyword"], word_boundary))
    best = F.array_min(F.transform(hits, lambda r: r["rule"]))["route"]
    joined = others.join(found, "__text", "left").withColumn(name, F.coalesce(best, F.lit(default)))
    return settled.drop("__folded", "__hit").unionByName(joined.drop("__folded", "__hit", "__text", "__found"))


def _leading_hit(folded: Column, leading: list[Row], word_boundary: bool) -> Column:
    """A struct with the route of the first of some ordered rules (priority, route, keyword) that a text holds, else null."""
    by_rule: dict[tuple, list[str]] = {}
    for row in leading:
        by_rule.setdefault((row["priority"], row["route"]), []).append(row["keyword"])
    chain = F
    for (_, route_name), words in by_rule.items():
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: _hit(folded, w, word_boundary))
        chain = chain.when(hit, F.struct(F.lit(route_name).cast("string").alias("route")))
    return F.lit(None).cast("struct<route: string>") if chain is F else chain


def expand_sources(expected: Column, both: str, sources: list[str]) -> Column:
    """One row per named source; the 'both' value stands for all of them."""
    return F.explode(F.when(expected == both, F.array(*[F.lit(s) for s in sources])).otherwise(F.array(expected)))


def routing_accuracy(routed: DataFrame, routed_col: str, expected_col: str, by: list[str]) -> DataFrame:
    """Share of rows whose routed value equals the expected one, per group."""
    match = F.coalesce(F.col(routed_col) == F.col(expected_col), F.lit(False)).cast("bigint")
    return (
        routed.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("questions"), F.sum(match).alias("matched"))
        .withColumn("accuracy", F.col("matched") / F.col("questions"))
    )
