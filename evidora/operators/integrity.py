"""Ownership, domains, keys: row policies, cascades, orphans, duplicates, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def owned_by(df: DataFrame, owner: str, user: Column) -> DataFrame:
    """Rows of one user; a plain predicate, so it reaches the scan."""
    return df.filter(F.col(owner) == user)


def owned_by_any(df: DataFrame, owner: str, grants: DataFrame, user: str) -> DataFrame:
    """Rows whose owner appears in a grants table."""
    return df.join(grants.select(F.col(user).alias(owner)).distinct(), owner, "left_semi")


def check_writes(rows: DataFrame, owner: str, actor: str) -> DataFrame:
    """Mark each row of a write batch: only rows the actor owns are accepted."""
    return rows.withColumn("accepted", F.coalesce(F.col(owner) == F.col(actor), F.lit(False)))


def domain_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the domain with their row counts; null passes, as in a CHECK constraint."""
    return (
        df.filter(~F.col(column).isin(allowed))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def delete_by_id(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.filter(~F.col(key).eqNullSafe(value))


def delete_by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def cascade(doomed: DataFrame, parent_key: str, children: DataFrame, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Split children of deleted parents from the rest: (kept, deleted)."""
    keys = doomed.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(keys, child_key, "left_anti"), children.join(keys, child_key, "left_semi")


def orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing; a null reference is no violation."""
    keys = parents.select(F.col(parent_key).alias(child_key))
    return children.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def find_or_first(
    df: DataFrame, key: str, options: DataFrame, option_key: str, columns: list[str], sort: list[Column]
) -> DataFrame:
    """Look each key up among the options; a miss takes the first option in the stated order."""
    first = options.orderBy(*sort).limit(1)
    found = options.select(F.col(option_key), *columns, F.lit(True).alias("__found"))
    found = found.withColumnRenamed(option_key, "__key")
    joined = df.join(found, df[key].eqNullSafe(found["__key"]), "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("__found"), F.col(c)).otherwise(first.select(c).scalar()).alias(c)
            for c in columns
        ],
        F.coalesce(F.col("__found"), F.lit(False)).alias("found"),
    )
