"""Keyword evidence: question -> route -> evidence record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora import constants as K
from evidora.functions.text import has_text
from evidora.operators.evidence import evidence_per_route
from evidora.operators.routing import DEFAULT_RULES, Rule, with_route
from evidora.session import written


def keyword_evidence(
    questions: DataFrame,
    chunks: DataFrame,
    text: str,
    *,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    k: int = K.TOP_K,
    order_by: str = "list",
    threshold: float = K.EVIDENCE_THRESHOLD,
    default_parts: list[str] = K.DEFAULT_ROUTE_PARTS,
    comparison: DataFrame | None = None,
) -> DataFrame:
    """Evidence record per question with text.

    The record depends on the route alone, so it is made once per route (at most rules + 1 rows of at most k chunks) and
    written; questions join it by route. A route without chunks gets the empty
    record. ``comparison`` (route, comparison) adds the side-by-side record of a route.
    """
    routed = with_route(questions.filter(has_text(F.col(text))), text, rules)
    routes = sorted({r.route for r in rules})
    records = evidence_per_route(
        chunks, k=k, order_by=order_by, routes=routes, threshold=threshold, default_parts=default_parts
    )
    if comparison is not None:
        records = records.join(comparison, "route", "full_outer")
    # Written down, so that the join knows the size of the records: small ones are broadcast, others dealt by route.
    out = routed.join(written(records, "records"), "route", "left")
    out = out.select(*routed.columns, *(c for c in records.columns if c != "route"))
    return out.withColumns(
        {
            "context": F.coalesce("context", F.lit("")),
            "mean_similarity": F.coalesce("mean_similarity", F.lit(0.0)),
            "grounded_score": F.coalesce("grounded_score", F.lit(0.0)),
            "is_insufficient_evidence": F.coalesce("is_insufficient_evidence", F.lit(0.0 < threshold)),
        }
    )
