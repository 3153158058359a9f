"""User settings as key/value rows laid over defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(users: DataFrame, defaults: dict[str, str | None], overrides: DataFrame, user: str) -> DataFrame:
    """Effective settings: a saved row wins even when its value is null; a missing row falls back.

    overrides has columns (user, key, value) with one row per user and key.
    """
    known = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    base = users.select(user, F.explode(known).alias("key", "default_value"))
    saved = overrides.select(user, "key", "value", F.lit(True).alias("saved"))
    joined = base.join(saved, [user, "key"], "left")
    return joined.select(
        user, "key",
        F.when(F.col("saved"), F.col("value")).otherwise(F.col("default_value")).alias("value"),
        F.coalesce("saved", F.lit(False)).alias("saved"),
    )
