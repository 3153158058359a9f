"""Counts, shares, latency rollups, and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.times import to_epoch_ms


def share_of_total(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Sum per group and its share of the grand total; the total is a scalar subquery."""
    total = df.agg(F.sum(amount)).scalar()
    return (
        df.groupBy(*keys).agg(F.sum(amount).alias("amount"))
        .withColumn("share", F.col("amount").cast("double") / total.cast("double"))
    )


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, with no group held in one aggregate buffer.

    Equal values are counted first, so the window over a group sorts its distinct values only; the values at the wanted
    positions are picked by a mergeable minimum.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"__upto": F.sum("__n").over(upto), "__total": F.sum("__n").over(group)})
    picks = []
    for name, point in points.items():
        at = (F.col("__total") - 1) * F.lit(point)
        picks += [
            F.min(F.when(F.col("__upto") > F.floor(at), F.col(value))).alias(f"__low_{name}"),
            F.min(F.when(F.col("__upto") > F.ceil(at), F.col(value))).alias(f"__high_{name}"),
        ]
    found = placed.groupBy(*keys).agg(F.max("__total").alias("__total"), *picks)
    out = []
    for name, point in points.items():
        at = (F.col("__total") - 1) * F.lit(point)
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *out)


def latency_rollup(df: DataFrame, keys: list[str], latency: str, tokens: Column) -> DataFrame:
    """Count, mean, extremes, median, 95th percentile and token total per group."""
    basic = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum(F.col(latency).cast("decimal(28,6)")).cast("double") / F.count(latency)).alias("mean_latency"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
        F.sum(tokens).alias("tokens"),
    )
    return basic.join(quantiles(df, keys, latency, {"p50_latency": 0.5, "p95_latency": 0.95}), keys)


def latency_rollup_approximate(df: DataFrame, keys: list[str], latency: str, tokens: Column, *, accuracy: int = 10_000) -> DataFrame:
    """The same rollup in one pass: mergeable quantile sketches, off by at most 1 / ``accuracy`` of the rank, without
    interpolation."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum(F.col(latency).cast("decimal(28,6)")).cast("double") / F.count(latency)).alias("mean_latency"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
        F.sum(tokens).alias("tokens"),
        F.percentile_approx(latency, 0.5, accuracy).alias("p50_latency"),
        F.percentile_approx(latency, 0.95, accuracy).alias("p95_latency"),
    )


#: Size of a stored quantile sketch; ranks read from it are off by about 0.4 %.
SKETCH_SIZE = 800


def latency_sketches(df: DataFrame, keys: list[str], latency: str, tokens: Column, period: Column) -> DataFrame:
    """One mergeable row per group and period: counts, sums, extremes and a quantile sketch, to be stored and merged later."""
    exact = F.col(latency).cast("decimal(28,6)")
    return df.groupBy(*keys, period.alias("period")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(latency).alias("measured"),
        F.sum(exact).alias("latency_sum"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
        F.sum(tokens).alias("tokens"),
        F.kll_sketch_agg_double(F.col(latency).cast("double"), SKETCH_SIZE).alias("sketch"),
    )


def merged_sketches(rows: DataFrame, keys: list[str], period: Column | None = None) -> DataFrame:
    """Stored rows merged to coarser periods, or over all of them; merging merged rows again gives the same counts."""
    by = [F.col(k) for k in keys] + ([] if period is None else [period.alias("period")])
    return rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("requests", "measured", "latency_sum", "tokens")],
        F.min("min_latency").alias("min_latency"),
        F.max("max_latency").alias("max_latency"),
        F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"),
    )


def sketched_rollup(rows: DataFrame, points: dict[str, float]) -> DataFrame:
    """The rollup that stored rows give: mean and quantiles beside the counts; nulls where nothing was measured."""
    some = F.col("measured") > 0
    quantiles = {n: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p))) for n, p in points.items()}
    mean = F.try_divide(F.col("latency_sum").cast("double"), F.col("measured"))
    return rows.withColumns({"mean_latency": mean, **quantiles}).drop("sketch", "latency_sum")


def rank_error(rolled: DataFrame, df: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """How far the rank of each quantile lies from the wanted one, as a share of the group's values."""
    joined = df.select(key, F.col(value).alias("__value")).join(rolled.select(key, *points), key)
    n = F.count("__value")
    errors = []
    for name, point in points.items():
        below, upto = F.count_if(F.col("__value") < F.col(name)), F.count_if(F.col("__value") <= F.col(name))
        errors.append(F.greatest(below / n - point, point - upto / n, F.lit(0.0)).alias(f"{name}_error"))
    return joined.groupBy(key).agg(*errors)


def latency_spans(df: DataFrame, request: list[str], step: str, ts: str, spans: dict[str, tuple[str, str]]) -> DataFrame:
    """Milliseconds between the first start event and the last end event of each span per request."""
    ms = to_epoch_ms(F.col(ts))
    return df.groupBy(*request).agg(
        *[
            (F.max(F.when(F.col(step) == end, ms)) - F.min(F.when(F.col(step) == start, ms))).alias(name)
            for name, (start, end) in spans.items()
        ]
    )


def precision_at_k(found: DataFrame, query: str, relevant: Column, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Relevant results among the first k, divided by k even when fewer were found.

    ``queries`` lists all queries; those without any result then count with 0.0.
    """
    hits = F.sum(F.coalesce(relevant, F.lit(False)).cast("bigint"))
    rated = found.groupBy(query).agg((hits / F.lit(k)).alias("precision_at_k"))
    if queries is None:
        return rated
    return queries.select(query).distinct().join(rated, query, "left").fillna(0.0, ["precision_at_k"])


def support_share(
    claims: DataFrame, owner: str, claim: str, evidence: DataFrame, passage: str, *, evidence_owner: str | None = None
) -> DataFrame:
    """Share of each owner's claims found among the evidence passages; with ``evidence_owner``, only among its own.

    Passages are first cut down to those that some claim states, then made distinct: with few
    claims the corpus is filtered where it is scanned, and repeated passages cannot multiply rows.
    """
    on = [claim] if evidence_owner is None else [owner, claim]
    stated = claims.select(*on).distinct()
    own = [] if evidence_owner is None else [F.col(evidence_owner).alias(owner)]
    known = (
        evidence.select(*own, F.col(passage).alias(claim)).join(stated, on, "left_semi")
        .distinct().withColumn("__hit", F.lit(1))
    )
    return (
        claims.join(known, on, "left")
        .groupBy(owner)
        .agg(
            F.count(F.lit(1)).alias("claims"),
            F.count("__hit").alias("supported"),
            (F.count("__hit") / F.count(F.lit(1))).alias("faithfulness"),
        )
    )


def token_budget(df: DataFrame, request: str, order: str, tokens: Column, window: int | Column) -> DataFrame:
    """Running token sum per request and whether a message still fits the model window."""
    upto = Window.partitionBy(request).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("tokens", tokens).withColumn("running_tokens", F.sum("tokens").over(upto))
    return summed.withColumn("fits", F.col("running_tokens") <= window)


def unequal_lists(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows whose parallel lists differ in length."""
    return df.withColumn("first_size", F.size(first)).withColumn("second_size", F.size(second)).filter(
        F.col("first_size") != F.col("second_size")
    )
