"""Top-k, limits, list order and list concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame, keys: list[str], sort: list[Column], k: int, *, rank: str = "rank", row_key: str | None = None
) -> DataFrame:
    """First k rows of every group. The rank filter is applied before the shuffle as well,
    so a task sends at most k rows per group.

    Give ``row_key`` (unique) when rows are wide: ranks are then worked out on the sort columns
    alone, and the wide columns are fetched for the rows that stay.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    by_sort = Window.partitionBy(*keys).orderBy(*sort)
    ranked = df.withColumn(rank, F.row_number().over(by_sort)).filter(F.col(rank) <= k)
    ranked = ranked.withColumn(rank, F.col(rank).cast("bigint"))
    return ranked if row_key is None else df.join(ranked.select(row_key, rank), row_key)


def list_index(df: DataFrame, keys: list[str], order: list[str], *, index: str = "index") -> DataFrame:
    """1-based position of every row in its list."""
    return df.withColumn(index, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def limit_k(df: DataFrame, sort: list[Column], k: int) -> DataFrame:
    if k < 0:
        raise ValueError("k must not be negative")
    return df.orderBy(*sort).limit(k)


def pick_positions(df: DataFrame, sort: list[Column], positions: list[int], *, name: str = "position") -> DataFrame:
    """Rows at 0-based positions of the sorted table; sorts only as far as the last one."""
    first_rows = limit_k(df, sort, max(positions) + 1)
    numbered = first_rows.withColumn(name, (F.row_number().over(Window.orderBy(*sort)) - 1).cast("bigint"))
    return numbered.filter(F.col(name).isin(positions))


def newest_first(df: DataFrame, created: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(created).desc(), F.col(tie))


def pinned_first(df: DataFrame, pinned: Column, updated: str, tie: str) -> DataFrame:
    return df.orderBy(pinned.desc(), F.col(updated).desc(), F.col(tie))


def concat_lists(*lists: DataFrame, part: str = "list_no") -> DataFrame:
    """All rows of the lists, duplicates kept, with the number of the list they came from."""
    numbered = [df.withColumn(part, F.lit(i)) for i, df in enumerate(lists)]
    out = numbered[0]
    for df in numbered[1:]:
        out = out.unionByName(df)
    return out


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)
