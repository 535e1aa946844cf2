"""Ranks, activity scores and tempo verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in rank order with their weights.
SEVERITIES = ("Unknown", "Low", "Medium", "High", "Critical")
WEIGHTS = (0.5, 1.0, 2.0, 4.0, 8.0)
SATURATION = 30.0
# Reporting windows as (token, hours, hours of a bucket).
WINDOWS = (("24h", 24, 1), ("7d", 168, 6), ("30d", 720, 24), ("90d", 2160, 24))


def severity_name(rank) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def severity_rank(name) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), name) - 1).cast("int")


def severity_weight(rank) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), rank + 1)


def severity_from_deaths(deaths) -> Column:
    return F.when(deaths >= 25, "Critical").when(deaths >= 5, "High").when(deaths >= 1, "Medium").otherwise("Low")


def contribution(rank, age_hours, evidence, confidence, window_hours) -> Column:
    """One incident's part of the activity rate, before division by days."""
    decay = F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / (window_hours / 4.0))
    backed = F.least(F.lit(3.0), 1 + 0.5 * F.log2(F.greatest(evidence, F.lit(1)).cast("double")))
    sure = 0.4 + 0.6 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return severity_weight(rank) * decay * backed * sure


def score(rate) -> Column:
    return 100 * (1 - F.exp(-rate / SATURATION))


def band(value) -> Column:
    return F.when(value < 15, "Low").when(value < 40, "Moderate").when(value < 70, "Elevated").otherwise("High")


def tempo(now, before, sources_now, sources_before, least: int = 5, material: float = 0.2) -> Column:
    """Whether reporting rose, or only its coverage."""
    change = lambda a, b: F.when(b == 0, 0.0).otherwise((a - b) / b)
    events, sources = change(now, before), change(sources_now, sources_before)
    each = change(now / sources_now, before / sources_before)
    return (
        F.when(before == 0, "NoBaseline")
        .when((now < least) | (before < least), "TooThin")
        .when((events <= -material) & (sources <= -material), "NotStated")
        .when((events >= material) & (sources >= material), F.when(each >= material, "Rising").otherwise("NotStated"))
        .when(F.abs(events) < material, "Steady")
        .when(events > 0, "Rising")
        .otherwise("Falling")
    )
