"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453
HALF_LIFE_DAYS = 30.0
#: The smoothing prior of popularity and the rows that it counts for.
PRIOR_MEAN, PRIOR_ROWS = 0.35, 5.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def tier_score(tier: Column) -> Column:
    """Editorial score of a quality tier; no tier counts as the lowest."""
    return F.when(tier == 5, 1.0).when(tier == 4, 0.8).when(tier == 3, 0.6).when(tier == 2, 0.35).otherwise(0.1)


def age_days(ts: Column, now: Column) -> Column:
    """Age in days, fractions included; the future has age 0."""
    return F.greatest(F.timestamp_diff("MICROSECOND", ts, now) / 86_400e6, F.lit(0.0))


def decay(ts: Column, now: Column) -> Column:
    """Weight that halves every thirty days."""
    return F.exp(-LN2 * age_days(ts, now) / HALF_LIFE_DAYS)


def read_ratio(visible_ms: Column, read_seconds: Column) -> Column:
    return F.least(visible_ms / F.greatest(read_seconds * 1000, F.lit(1000)), F.lit(1.5))


def feedback_score(c: dict[str, Column]) -> Column:
    """-1 to 2 from a user's counts on a content; counts work once, reading by its ratio."""
    once = lambda x: F.least(x, F.lit(1))
    total = 0.20 * once(c["open"]) + 0.60 * c["read_ratio"] + 0.40 * once(c["save"]) + 0.30 * once(c["favorite"]) + 0.40 * once(c["mark_read"]) - 0.50 * once(c["dismiss"])
    return clamp(total, -1.0, 2.0)


def _share(x: Column, cap: float) -> Column:
    return F.least(x, F.lit(cap)) / cap


def _smoothed(raw: Column, n: Column) -> Column:
    """Mean of the signals, pulled to the prior while there are few, 0 to 1."""
    return F.least(F.lit(1.0), (F.greatest(F.lit(0.0), raw) * n + PRIOR_MEAN * PRIOR_ROWS) / F.greatest(n + PRIOR_ROWS, F.lit(1.0)))


def content_halo(c: dict[str, Column]) -> Column:
    raw = 0.15 * _share(c["open"], 10) + 0.35 * _share(c["read_ratio"], 1.5) + 0.25 * _share(c["save"], 10) + 0.20 * _share(c["mark_read"], 10) - 0.20 * _share(c["dismiss"], 10)
    return _smoothed(raw, c["signals"])


def source_halo(c: dict[str, Column]) -> Column:
    raw = (
        0.15 * _share(c["open"], 20)
        + 0.25 * _share(c["visible_ms"], 600_000)
        + 0.20 * _share(c["save"], 20)
        + 0.15 * _share(c["mark_read"], 20)
        + 0.25 * _share(c["subscribe"], 10)
        - 0.15 * _share(c["dismiss"], 20)
        - 0.20 * _share(c["unsubscribe"], 10)
    )
    return _smoothed(raw, c["signals"])


def positive(score: Column) -> Column:
    """An affinity between 0 and 2 as a number between 0 and 1."""
    return clamp(score, 0.0, 2.0) / 2


def freshness(ts: Column, now: Column, days: float = 30.0) -> Column:
    """1 now, 0 after so many days, by whole seconds."""
    age = F.greatest(F.floor(F.timestamp_diff("MICROSECOND", ts, now) / 1e6) / 86_400.0, F.lit(0.0))
    return clamp((days - age) / days, 0.0, 1.0)


def recent_activity(n: Column) -> Column:
    return clamp(n.cast("double"), 0.0, 20.0) / 20


def repeat_penalty(mark_read: Column, ratio: Column) -> Column:
    return F.when((mark_read > 0) | (ratio >= 0.8), 0.35).otherwise(0.0)


def content_score(p: dict[str, Column]) -> Column:
    """Sum of the weighted parts less the penalty; never below 0."""
    total = (
        0.22 * p["topic_match"]
        + 0.16 * p["source_affinity"]
        + 0.10 * p["content_halo"]
        + 0.07 * p["source_halo"]
        + 0.08 * p["editorial_score"]
        + 0.18 * p["curated_score"]
        + 0.08 * p["freshness"]
        + 0.08 * p["subscribed_boost"]
        + 0.03 * p["exploration_boost"]
    )
    return F.greatest(total - p["repeat_penalty"], F.lit(0.0))


def source_score(p: dict[str, Column]) -> Column:
    return 0.32 * p["topic_match"] + 0.20 * p["editorial_score"] + 0.18 * p["source_halo"] + 0.12 * p["similarity"] + 0.10 * p["recent_activity"] + F.lit(0.08)


def preview_score(p: dict[str, Column]) -> Column:
    return 0.50 * p["topic_match"] + 0.30 * p["editorial_score"] + 0.10 * p["source_halo"] + 0.10 * p["recent_activity"]
