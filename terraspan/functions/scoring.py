"""Scores of search results, feedback, completeness and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraspan.functions.rules import between_0_and_1, cascade

#: Shares of the composite score.
SHARES = {"similarity": 0.50, "metadata": 0.25, "temporal": 0.15, "quality": 0.10}
CONFIRMED_GAIN, REJECTED_LOSS, CONCEPT_GAIN, CONCEPT_LEAST = 0.05, -0.10, 0.02, 2
#: Dollars per million tokens (input, output), and the factor of the baseline.
ACTUAL_PRICE, BASELINE_PRICE, BASELINE_FACTOR = (0.075, 0.30), (1.25, 5.00), 3


def unit_similarity(cosine: Column) -> Column:
    """Cosine from [-1, 1] to [0, 1]."""
    return between_0_and_1((cosine + 1) / 2)


def metadata_score(sensor_hit: Column, modality_hit: Column) -> Column:
    gain = F.when(sensor_hit, 0.3).otherwise(0.0) + F.when(modality_hit, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + gain)


def temporal_score(ts: Column, start: Column, end: Column) -> Column:
    """1 for a time inside the window (either end may be open), else 0.5."""
    inside = ts.isNotNull() & (start.isNotNull() | end.isNotNull())
    inside = inside & F.coalesce(ts >= start, F.lit(True)) & F.coalesce(ts <= end, F.lit(True))
    return F.when(inside, 1.0).otherwise(0.5)


def quality_score(completeness: Column) -> Column:
    """Completeness as a share; 0 and null count as 70."""
    return F.coalesce(F.nullif(completeness, F.lit(0)), F.lit(70)) / 100.0


def quality_band(score: Column) -> Column:
    return cascade([(score >= 0.75, "USABLE"), (score >= 0.5, "DEGRADED")], "UNUSABLE")


def composite(similarity: Column, metadata: Column, temporal: Column, quality: Column) -> Column:
    s = SHARES
    return similarity * s["similarity"] + metadata * s["metadata"] + temporal * s["temporal"] + quality * s["quality"]


def feedback_adjustment(decision: Column, confirmed: Column, rejected: Column) -> Column:
    """Change of a score by the scene's own latest decision, else by the
    confirmations and rejections of its concept."""
    concept = (confirmed > rejected) & (confirmed >= CONCEPT_LEAST)
    return cascade([(decision == "CONFIRMED", CONFIRMED_GAIN), (decision == "REJECTED", REJECTED_LOSS), (concept, CONCEPT_GAIN)], 0.0)


def completeness(width: Column, height: Column, bands: Column, crs: Column, transform: Column, bounds: Column, date: Column, sensor: Column) -> Column:
    """Metadata completeness, 0 to 100."""
    parts = [
        ((width > 0) & (height > 0), 20), (bands > 0, 15), (crs.isNotNull() & (crs != "unavailable"), 25),
        (transform.isNotNull(), 15), (bounds.isNotNull(), 10), (date.isNotNull(), 10), (sensor.isNotNull() & (sensor != "UNKNOWN"), 5),
    ]
    out = F.lit(0)
    for condition, points in parts:
        out = out + F.when(condition, points).otherwise(0)
    return out


def token_cost(n_in: Column, n_out: Column) -> Column:
    """struct(actual, baseline, saving_pct) in dollars."""
    actual = (n_in * ACTUAL_PRICE[0] + n_out * ACTUAL_PRICE[1]) / 1e6
    baseline = (n_in * BASELINE_PRICE[0] + n_out * BASELINE_PRICE[1]) * BASELINE_FACTOR / 1e6
    saving = F.when(baseline > 0, (1 - actual / baseline) * 100).otherwise(F.lit(0.0))
    return F.struct(actual.alias("actual"), baseline.alias("baseline"), saving.alias("saving_pct"))
