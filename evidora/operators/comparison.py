"""Side-by-side comparison of sources and catalog lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def side_by_side(
    df: DataFrame, topic: str, org: str, organizations: dict[str, str], content: Column, score: str, key: str
) -> DataFrame:
    """Best text per topic and organization, one column each, and whether all sides are present.

    ``organizations`` maps a value of ``org`` to the name of its column. The best row is found on
    narrow columns; texts are fetched for the winners only.
    """
    wanted = df.filter(F.col(org).isin(list(organizations)))
    winners = wanted.groupBy(topic, org).agg(F.max_by(key, F.struct(score, key)).alias(key)).select(key)
    best = (
        wanted.join(winners, key, "left_semi").select(topic, org, content.alias("content"))
        .groupBy(topic)
        .pivot(org, list(organizations))
        .agg(F.first("content"))
    )
    # Topics that none of the organizations covers stay, with empty sides.
    best = df.select(topic).distinct().join(best, topic, "left")
    sides = [F.col(f"`{value}`").alias(name) for value, name in organizations.items()]
    present = F.lit(True)
    for name in organizations.values():
        present = present & F.col(name).isNotNull()
    return best.select(topic, *sides).withColumn("both_present", present)


def shared_values(df: DataFrame, topic: str, org: str, pair: tuple[str, str], value: str) -> DataFrame:
    """Number of values each side has per topic and how many are common to both."""
    left, right = pair
    seen = (
        df.filter(F.col(org).isin(left, right))
        .groupBy(topic, value)
        .agg(
            F.max((F.col(org) == left).cast("int")).alias("on_left"),
            F.max((F.col(org) == right).cast("int")).alias("on_right"),
        )
    )
    return seen.groupBy(topic).agg(
        F.sum("on_left").alias("left_values"),
        F.sum("on_right").alias("right_values"),
        F.sum(F.col("on_left") * F.col("on_right")).alias("shared_values"),
    )


def normal_code(name: Column) -> Column:
    """Code form of a source name: upper case, letters and digits only."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def to_catalog(df: DataFrame, source: str, catalog: DataFrame, code: str, columns: list[str], separator: str = " / ") -> DataFrame:
    """Split a multi-valued source and look every part up in the catalog; unknown parts stay with nulls.

    Catalog entries whose codes read the same are one entry, the first by code; `colliding_codes` lists them."""
    parts = df.withColumn("source_part", F.explode(F.split(F.col(source), separator.replace("/", "[/]"))))
    keyed = parts.withColumn("__code", normal_code(F.col("source_part")))
    known = catalog.groupBy(normal_code(F.col(code)).alias("__code")).agg(
        F.min_by(F.struct(*columns), F.col(code)).alias("__entry")
    )
    joined = keyed.join(known, "__code", "left")
    return joined.select(*parts.columns, *(F.col("__entry")[c].alias(c) for c in columns))


def colliding_codes(catalog: DataFrame, code: str) -> DataFrame:
    """Codes of the catalog that read the same, for a report."""
    same = catalog.groupBy(normal_code(F.col(code)).alias("normal_code")).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return same.filter(F.size("codes") > 1)
