"""Rubric scores, statuses, calibrated confidence, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GREEN_FROM, YELLOW_FROM, ROUTE_FROM = 70, 40, 0.70
DIMENSIONS = ("severity", "frequency", "functional", "coping")


def total(*dimensions: Column) -> Column:
    """Sum of the rubric's dimensions (P1); a missing one counts as 0."""
    out = F.lit(0)
    for d in dimensions:
        out = out + F.coalesce(d, F.lit(0))
    return out


def status(score: Column) -> Column:
    """GREEN from 70, YELLOW from 40, else RED (P2, P27); null for null."""
    return F.when(score >= GREEN_FROM, "GREEN").when(score >= YELLOW_FROM, "YELLOW").when(score.isNotNull(), "RED")


def consistency(state: Column, polarity: Column) -> Column:
    """How well status and polarity agree; 0.5 where the table has no entry."""
    s, p = F.upper(state), F.lower(polarity)
    return (
        F.when((s == "RED") & (p == "negative") | (s == "GREEN") & (p == "positive"), 1.0)
        .when((s == "YELLOW") & p.isin("positive", "negative", "mixed"), 0.8)
        .when((s == "RED") & (p == "positive") | (s == "GREEN") & (p == "negative"), 0.0)
        .otherwise(0.5)
    )


def confidence(raw: Column, evidence_words: Column, state: Column, polarity: Column) -> Column:
    """Composite confidence (P3): 0.30 raw, 0.30 evidence density (4 words are full), 0.40 consistency; two digits, within 0 and 1."""
    density = F.least(F.coalesce(evidence_words, F.lit(0)) / 4.0, F.lit(1.0))
    # sums like 0.6949999999 stand for 0.695
    value = F.round(F.round(0.30 * raw + 0.30 * density + 0.40 * consistency(state, polarity), 9), 2)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def unsure(confidences: Column) -> Column:
    """Whether any confidence of an array is below the routing threshold (P5)."""
    return F.exists(confidences, lambda c: c < ROUTE_FROM)


def route_after_safety(safety: Column) -> Column:
    """A missing status counts as SAFE."""
    s = F.coalesce(safety, F.lit("SAFE"))
    return F.when(s == "HIGH_RISK", "emergency_response").when(s == "UNAVAILABLE", "service_unavailable").otherwise("extractor")


def route_after_assessment(flagged: Column, confidences: Column) -> Column:
    """A missing confidence counts as 1.0."""
    none = confidences.isNull() | (F.size(confidences) == 0)
    low = F.exists(confidences, lambda c: F.coalesce(c, F.lit(1.0)) < ROUTE_FROM)
    return F.when(F.coalesce(flagged, F.lit(False)) | none | low, "questioner").otherwise("advisor")


def derived_route(safety: Column, flagged: Column, confidences: Column) -> Column:
    """P8, as derived from stored turns: UNAVAILABLE asks again; a confidence that is null or no number counts as 0.0."""
    none = confidences.isNull() | (F.size(confidences) == 0)
    low = F.exists(confidences, lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0)) < ROUTE_FROM)
    return (
        F.when(safety == "HIGH_RISK", "emergency_response")
        .when((safety == "UNAVAILABLE") | F.coalesce(flagged, F.lit(False)) | none | low, "questioner")
        .otherwise("advisor")
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 for division by zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)
