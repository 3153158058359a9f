"""Evidence records: ranked chunk lists, scores, citations, prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora import constants as K
from evidora.functions.payloads import citation
from evidora.functions.scores import insufficient, mean_in_order, round_half_up
from evidora.functions.text import evidence_block
from evidora.operators.markdown import once
from evidora.operators.ranking import top_k_per_group


# Largest number of chunk ids, and of chunks in evidence records, that is broadcast.
BROADCAST_CHUNKS = 4_000


def collect_ranked(df: DataFrame, keys: list[str], rank: str, columns: list[str], *, into: str = "chunks") -> DataFrame:
    """One list per group in rank order. Meant for groups already cut to k rows."""
    entry = F.struct(F.col(rank), *[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(into))


def score_evidence(
    df: DataFrame, chunks: str = "chunks", score: str = "similarity_score", *, threshold: float = K.EVIDENCE_THRESHOLD
) -> DataFrame:
    """Mean similarity, grounded score and the insufficient-evidence flag of a chunk list."""
    listed = F.coalesce(F.transform(F.col(chunks), lambda c: c[score]), F.array().cast("array<double>"))
    return (
        df.withColumn("mean_similarity", mean_in_order(listed))
        .withColumn("grounded_score", round_half_up(F.col("mean_similarity")))
        .withColumn("is_insufficient_evidence", insufficient(F.col("mean_similarity"), threshold))
    )


def citations_of(chunks: Column) -> Column:
    """Citation list of a chunk list, in the same order."""
    return F.transform(
        chunks,
        lambda c: citation(
            c["id"], c["source"], c["section"], c["page"], c["content"], c["similarity_score"],
            c["recommendation_strength"],
        ),
    )


def context_of(chunks: Column, separator: str = "\n---\n") -> Column:
    """Prompt context: numbered evidence blocks of a ranked list, joined in order."""
    blocks = F.transform(
        chunks, lambda c, i: evidence_block(i + 1, c["source"], c["section"], c["page"], c["content"])
    )
    return F.array_join(blocks, separator)


def evidence_per_route(
    chunks: DataFrame,
    *,
    k: int = K.TOP_K,
    order_by: str = "list",
    routes: list[str] | None = None,
    threshold: float = K.EVIDENCE_THRESHOLD,
    default_route: str = K.DEFAULT_ROUTE,
    default_parts: list[str] = K.DEFAULT_ROUTE_PARTS,
) -> DataFrame:
    """Evidence record per route, from chunks (id, route, ord, ..., similarity_score).

    ``order_by='list'`` keeps the stored order, ``'score'`` puts the best chunk first. Each route
    is cut to k rows before anything is collected; the default route is the concatenation of the
    lists of ``default_parts``. Naming the wanted ``routes`` bounds the number of chunks to fetch.
    """
    columns = ["id", "title", "content", "source", "section", "page", "similarity_score", "recommendation_strength"]
    sort = (
        [F.col("ord"), F.col("id")] if order_by == "list" else [F.col("similarity_score").desc(), F.col("id")]
    )
    narrow = chunks.select("id", "route", "ord", "similarity_score")
    first_k = top_k_per_group(narrow, ["route"], sort, k, rank="part_rank")
    # Chunks of the default parts go into two lists: their own and the default one.
    part = F.lit(0)
    for i, name in enumerate(default_parts):
        part = F.when(F.col("route") == name, i).otherwise(part)
    # Chunks filed under the default route itself belong to no list.
    lists = (
        F.when(F.col("route").isin(default_parts), F.array("route", F.lit(default_route)))
        .when(F.col("route") != default_route, F.array("route"))
    )
    spread = first_k.withColumn("part", part).withColumn("list", F.explode(lists))
    by_list = [F.col("part"), F.col("part_rank")] if order_by == "list" else sort
    chosen = top_k_per_group(spread, ["list"], by_list, k).select("id", F.col("list").alias("route"), "rank")
    if routes is not None:
        # The filter is on the exploded name, so the route of a chunk is not worked out twice for it.
        chosen = chosen.filter(F.col("route").isin([*routes, default_route]))
        if (len(routes) + 1) * k <= BROADCAST_CHUNKS:
            chosen = F.broadcast(chosen)
    listed = chunks.select(*columns).join(chosen, "id")
    record = score_evidence(collect_ranked(listed, ["route"], "rank", columns), threshold=threshold)
    return record.withColumn("citations", citations_of(F.col("chunks"))).withColumn(
        "context", context_of(F.col("chunks"))
    )


def within_budget(df: DataFrame, chunks: str, text: str, budget: Column, tokens) -> DataFrame:
    """Longest prefix of a ranked list whose running token sum fits the budget."""
    def running_sums(sizes: Column) -> Column:
        return F.transform(
            sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
        )

    sizes = F.transform(F.col(chunks), lambda c: tokens(c[text]))
    fitting = F.filter("running_tokens", lambda t: t <= budget)
    return (
        df.withColumn("running_tokens", once(sizes, running_sums))
        .withColumn("chunks_used", F.size(fitting))
        .withColumn("tokens_used", F.coalesce(F.array_max(fitting), F.lit(0)))
    )
