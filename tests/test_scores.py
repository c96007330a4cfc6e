import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring as S


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def counts(**n):
    return {k: F.lit(v) for k, v in n.items()}


def test_feedback_is_clamped_and_counts_once(spark):
    zero = dict.fromkeys(("open", "save", "favorite", "mark_read", "dismiss"), 0)
    assert value(spark, S.feedback_score(counts(**zero, read_ratio=0.0))) == 0
    assert value(spark, S.feedback_score(counts(**(zero | {"dismiss": 9}), read_ratio=0.0))) == -0.5
    assert value(spark, S.feedback_score(counts(open=5, save=2, favorite=1, mark_read=1, dismiss=0, read_ratio=1.5))) == 2.0


def test_a_day_without_signals_has_the_prior(spark):
    zero = dict.fromkeys(("open", "save", "mark_read", "dismiss", "signals"), 0)
    assert value(spark, S.content_halo(counts(**zero, read_ratio=0.0))) == pytest.approx(0.35)
    assert value(spark, S.source_halo(counts(**zero, visible_ms=0, subscribe=0, unsubscribe=0))) == pytest.approx(0.35)


def test_decay_halves_in_thirty_days_and_spares_the_future(spark):
    now = F.to_timestamp(F.lit("2024-01-31"))
    assert value(spark, S.decay(F.to_timestamp(F.lit("2024-01-01")), now)) == pytest.approx(0.5)
    assert value(spark, S.decay(F.to_timestamp(F.lit("2025-01-01")), now)) == 1.0
    assert value(spark, S.freshness(F.to_timestamp(F.lit("2024-01-16")), now)) == pytest.approx(0.5)


def test_scores_reward_each_part(spark):
    names = ("topic_match", "source_affinity", "content_halo", "source_halo", "editorial_score", "curated_score", "freshness", "subscribed_boost", "exploration_boost")
    none = dict.fromkeys(names, 0.0) | {"repeat_penalty": 0.0}
    for n in names:
        assert value(spark, S.content_score(counts(**(none | {n: 1.0})))) > 0
    assert value(spark, S.content_score(counts(**(none | {"repeat_penalty": 0.35})))) == 0
    assert math.isclose(value(spark, S.content_score(counts(**(dict.fromkeys(names, 1.0) | {"repeat_penalty": 0.0})))), 1.0)
    assert [value(spark, S.tier_score(F.lit(t).cast("int"))) for t in (5, 4, 3, 2, 1, None)] == [1.0, 0.8, 0.6, 0.35, 0.1, 0.1]
