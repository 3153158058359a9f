"""Vector evidence: question vector -> nearest chunks -> evidence record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora import constants as K
from evidora.operators.evidence import collect_ranked, score_evidence
from evidora.operators.vectors import approx_top_k, exact_top_k


def vector_evidence(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    k: int = K.TOP_K,
    chunk_threshold: float | None = None,
    threshold: float = K.EVIDENCE_THRESHOLD,
    approximate: bool = False,
    **search,
) -> DataFrame:
    """Evidence record per query: queries (query_id, query_vec), chunks (chunk_id, chunk_vec).

    ``chunk_threshold`` drops weak chunks. They rank below the strong ones, so filtering the k best
    gives the same rows as filtering all chunks first. A query without chunks keeps an empty list,
    mean 0.0 and the insufficient flag.
    """
    find = approx_top_k if approximate else exact_top_k
    found = find(queries, chunks, k, **search)
    if chunk_threshold is not None:
        found = found.filter(F.col("score") > chunk_threshold)
    listed = collect_ranked(
        found.withColumnRenamed("score", "similarity_score"), ["query_id"], "rank", ["chunk_id", "similarity_score"]
    )
    kept = queries.select("query_id").join(listed, "query_id", "left")
    kept = kept.withColumn("chunks", F.coalesce("chunks", F.array().cast(listed.schema["chunks"].dataType)))
    return score_evidence(kept, threshold=threshold)
