"""Scores of candidates, and the diverse head of each user's ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scoring as S
from tidemark.operators.candidates import BUCKETS

#: Picks until caps loosen, then caps (before, after) by source and topic.
EARLY = 10
SOURCE_CAPS, TOPIC_CAPS, SOURCE_TOPIC_CAPS = (2, 4), (3, 5), (2, 4)


def scored_content(candidates: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """Candidates that weren't dismissed, with score parts and score."""
    follows = subscriptions.groupBy("user_id").agg(F.collect_set("source_id").alias("follows"))
    rows = candidates.filter("dismiss_count = 0").join(follows, "user_id", "left")
    boost = F.when(F.col("subscribed") | F.coalesce(F.array_contains("follows", F.col("source_id")), F.lit(False)), 1.0).otherwise(0.0)
    parts = {
        "topic_match": S.positive(F.col("topic_score")),
        "source_affinity": S.positive(F.col("source_affinity_score")),
        "content_halo": F.col("content_halo_score"),
        "source_halo": F.col("source_halo_score"),
        "editorial_score": F.col("editorial_score"),
        "curated_score": F.col("curated_score"),
        "freshness": S.freshness(F.col("published_at"), now),
        "subscribed_boost": boost,
        "exploration_boost": 1.0 - boost,
        "repeat_penalty": S.repeat_penalty(F.col("mark_read_count"), F.col("read_ratio")),
    }
    named = rows.select("user_id", "content_id", "source_id", "primary_topic_slug", "published_at", *BUCKETS, F.struct(*(v.alias(k) for k, v in parts.items())).alias("parts"))
    return named.withColumn("score", S.content_score({k: F.col(f"parts.{k}") for k in parts}))


def content_order() -> list[Column]:
    """By score to nine places; ties by the order of the buckets, then newest first."""
    return [F.desc(F.round("score", 9)), *(F.desc(b) for b in ("subscribed", "saved_adjacent", "discovery", "trending", "evergreen")), F.desc("published_at"), F.desc("content_id")]


def scored_sources(candidates: DataFrame) -> DataFrame:
    parts = {"topic_match": S.positive(F.col("topic_score")), "editorial_score": F.col("editorial_score"), "source_halo": F.col("source_halo_score"), "similarity": F.col("similarity_score"), "recent_activity": S.recent_activity(F.col("recent_activity_count"))}
    return candidates.withColumn("score", S.source_score(parts))


def scored_preview(candidates: DataFrame) -> DataFrame:
    parts = {"topic_match": S.positive(F.col("topic_score")), "editorial_score": F.col("editorial_score"), "source_halo": F.col("source_halo_score"), "recent_activity": S.recent_activity(F.col("recent_activity_count"))}
    return candidates.withColumn("score", S.preview_score(parts))


def source_order() -> list[Column]:
    return [*(F.desc(F.round(c, 9)) for c in ("score", "topic_score", "editorial_score", "source_halo_score")), F.desc("recent_activity_count"), F.asc("source_id")]


def _same(key: str, row: Column) -> Callable[[Column], Column]:
    return lambda other: other[key] == row[key]


def diverse(ranked: DataFrame, user: str, item: str, order: list[Column], limit: int, caps: dict[str, tuple[int, int]], carried: tuple[str, ...] = ()) -> DataFrame:
    """The first picks of each user under caps by key, then what was passed over, in order: (user, item, position, score).

    caps: column -> (cap before EARLY picks, cap after). A null key is never capped. A user's candidates are at most a
    few buckets of 200, so one array a user holds them; the walk over it is a native fold. Picks keep the columns carried.
    """
    w = Window.partitionBy(user).orderBy(*order)
    keys = list(caps)
    fields = [F.col(item).alias("item"), F.col("score").alias("score"), *(F.col(k).cast("string").alias(k) for k in keys), *carried]
    rows = ranked.withColumn("n", F.row_number().over(w)).groupBy(user).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", *fields))), lambda x: F.struct(*(x[f] for f in ("item", "score", *keys, *carried)))).alias("rows"))
    none = F.filter("rows", lambda x: F.lit(False))

    def step(state: Column, row: Column) -> Column:
        picked, passed = state["picked"], state["passed"]
        fits = F.lit(True)
        for k, (early, late) in caps.items():
            same = F.size(F.filter(picked, _same(k, row)))
            fits = fits & (row[k].isNull() | (same < F.when(F.size(picked) < EARLY, early).otherwise(late)))
        full = F.size(picked) >= limit
        one = F.array(row)
        return F.struct(F.when(~full & fits, F.concat(picked, one)).otherwise(picked).alias("picked"), F.when(~full & ~fits, F.concat(passed, one)).otherwise(passed).alias("passed"))

    folded = F.aggregate("rows", F.struct(none.alias("picked"), none.alias("passed")), step, lambda s: F.slice(F.concat(s["picked"], s["passed"]), 1, limit))
    return rows.select(user, F.posexplode(folded).alias("position", "row")).select(user, F.col("row.item").alias(item), "position", F.col("row.score").alias("score"), *(F.col(f"row.{c}").alias(c) for c in carried))


def diverse_content(scored: DataFrame, limit: int = 20, carried: tuple[str, ...] = ()) -> DataFrame:
    return diverse(scored, "user_id", "content_id", content_order(), limit, {"source_id": SOURCE_CAPS, "primary_topic_slug": TOPIC_CAPS}, carried)


def diverse_sources(scored: DataFrame, limit: int = 20) -> DataFrame:
    return diverse(scored, "user_id", "source_id", source_order(), limit, {"primary_topic_slug": SOURCE_TOPIC_CAPS})


def serve_headers(users: DataFrame, surface: str, algorithm: str, limit: int, now: Column, topic: str | None = None) -> DataFrame:
    """One row for each serve: id, user, surface, algorithm and the request as JSON. users: user_id, languages."""
    asked = {"limit": F.lit(limit), "preferred_languages": F.col("languages")} | ({"topic_slug": F.lit(topic)} if topic else {})
    return users.select(_serve_id(surface, now), "user_id", F.lit(surface).alias("surface"), F.lit(algorithm).alias("algorithm"), F.to_json(F.struct(*(c.alias(k) for k, c in asked.items()))).alias("request_context"), now.alias("served_at"))


def _serve_id(surface: str, now: Column) -> Column:
    return F.xxhash64("user_id", F.lit(surface), now).alias("serve_id")


def serve_log(picks: DataFrame, scored: DataFrame, surface: str, item: str, algorithm: str, now: Column) -> DataFrame:
    """One row for each item served, with the breakdown of its score as JSON."""
    return served(picks.join(scored.select("user_id", item, *(["parts"] if "parts" in scored.columns else [])), ["user_id", item]), surface, item, algorithm, now)


def served(rows: DataFrame, surface: str, item: str, algorithm: str, now: Column) -> DataFrame:
    """``serve_log`` of picks that bring the parts of their scores, if there are any, themselves."""
    breakdown = F.to_json("parts") if "parts" in rows.columns else F.lit("{}")
    return rows.select(_serve_id(surface, now), "user_id", F.lit(surface).alias("surface"), F.lit(algorithm).alias("algorithm"), "position", item, "score", breakdown.alias("score_breakdown"), now.alias("served_at"))
