"""Evaluation report: one row per measure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.operators.audit import overcertain, refuses


def measure(name: str, df: DataFrame, value: Column) -> DataFrame:
    """One report row: the number of rows measured and the value."""
    return df.agg(F.count(F.lit(1)).alias("measured"), value.alias("value")).select(
        F.lit(name).alias("measure"), "measured", "value"
    )


def grounding_measures(df: DataFrame, text: str, flagged: Column) -> DataFrame:
    """Report rows of a table of answers in one pass: share of over-certain answers, of refusals, and of answers whose
    refusal agrees with the insufficient-evidence flag."""
    refused = refuses(F.col(text))
    names = ["overcertain_share", "refusal_share", "refusal_agreement"]
    counts = df.agg(
        F.count(F.lit(1)).alias("measured"),
        F.count_if(overcertain(F.col(text)) > 0).alias(names[0]),
        F.count_if(refused).alias(names[1]),
        F.count_if(F.coalesce(refused, F.lit(False)) == flagged).alias(names[2]),
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("measure"), "measured", F.round(F.try_divide(F.col(n), F.col("measured")), 6).alias("value"))
            for n in names
        ]
    )
    return counts.select(F.inline(rows))


def accuracy_by_groups(df: DataFrame, routed: str, expected: str, by: list[str]) -> DataFrame:
    """Accuracy for every combination of the groups and their totals, in one pass; `level` tells which groups a row sums over
    (as `grouping_id` does), so that a null group differs from a total."""
    match = F.coalesce(F.col(routed) == F.col(expected), F.lit(False))
    return (
        df.cube(*by)
        .agg(F.grouping_id(*by).cast("long").alias("level"), F.count(F.lit(1)).alias("questions"), F.count_if(match).alias("matched"))
        .withColumn("accuracy", F.round(F.col("matched") / F.col("questions"), 6))
    )


def evaluation_report(*measures: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, measures)
