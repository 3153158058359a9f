"""Score arithmetic: half-up rounding, percentages, bands, ordered means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidora import constants as K


def round_half_up(value: Column, places: int = 2) -> Column:
    """Round half towards plus infinity on the binary value, unlike the decimal rounding of ``F.round``."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def percentage(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")


def score_band(score: Column) -> Column:
    """Band of the rounded percentage."""
    percent = percentage(score)
    band = None
    for lowest, label in K.SCORE_BANDS:
        hit = percent >= lowest
        band = F.when(hit, label) if band is None else band.when(hit, label)
    return F.when(score.isNotNull(), band.otherwise(K.LOWEST_BAND))


def mean_in_order(scores: Column) -> Column:
    """Mean of a bounded score list, added up in list order; 0.0 for an empty or missing list. Null scores are passed over."""
    scores = F.filter(scores, lambda s: s.isNotNull())
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    return F.coalesce(F.when(F.size(scores) > 0, total / F.size(scores)), F.lit(0.0))


def visible_parts(citations: Column, lang: Column, value: Column, *, translated: str = "ar") -> Column:
    """Which parts of a message are shown: citations if there are any, the translation of a question in the language that is
    translated, a measured value if it is there."""
    return F.struct(
        F.coalesce(F.size(citations) > 0, F.lit(False)).alias("citations"),
        F.coalesce(lang == translated, F.lit(False)).alias("translation"),
        value.isNotNull().alias("value"),
    )


def insufficient(mean: Column, threshold: float = K.EVIDENCE_THRESHOLD) -> Column:
    """Too little evidence: the unrounded mean lies under the threshold."""
    return mean < F.lit(threshold)
