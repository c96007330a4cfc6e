"""Queries of the recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.affinity import user_content_feedback
from tidemark.operators import candidates, rerank, rollup, topics
from tidemark.plans.oracle import NOW, over, picks
from tidemark.plans.recommend import Recommender
from tidemark.plans.registry import r6, register, sql6
from tidemark.sources import entities as E
from tidemark.sources.tables import table

_DAILY = "impression_count, open_count, save_count, favorite_count, mark_read_count, dismiss_count, heartbeat_count, visible_ms, last_interacted_at"


@register("a5a_content_feedback_daily", over(f"SELECT user_id, content_id, signal_date, source_id, {_DAILY} FROM feedback_daily"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).feedback_daily


@register("a5b_source_signals_daily", over("SELECT * FROM signals_daily"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).signals_daily


@register("a5c_content_halo_counts", over("SELECT * FROM content_daily"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollup.content_halo_daily(E.events(spark, d))


@register("a5d_source_halo_counts", over("SELECT * FROM source_daily"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollup.source_halo_daily(E.events(spark, d), E.content_keys(spark, d))


@register("a5e_dirty_targets", over("SELECT kind, id, min(occurred_at) AS first_marked_at, max(occurred_at) AS last_marked_at FROM (SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS id, occurred_at FROM owned UNION ALL SELECT 'content', CAST(content_id AS VARCHAR), occurred_at FROM owned UNION ALL SELECT 'source', source_id, occurred_at FROM owned) WHERE id IS NOT NULL GROUP BY kind, id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollup.dirty_targets(E.events(spark, d), E.content_keys(spark, d))


@register("a5_rollup_merge", over(f"SELECT user_id, content_id, signal_date, source_id, {_DAILY} FROM feedback_daily"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two rollups of the log's halves, merged: the same as one of the whole."""
    events, content = E.events(spark, d), E.content_keys(spark, d)
    old, new = (rollup.content_feedback_daily(events.filter(f"id % 2 = {k}"), content) for k in (0, 1))
    return rollup.merged(old, new, ["user_id", "content_id", "signal_date"])


@register("a7_user_content_feedback", over(f"SELECT user_id, content_id, source_id, impression_count, open_count, save_count, dismiss_count, visible_ms, {sql6('read_ratio', 'score')}, last_interacted_at FROM feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    f = Recommender(spark, d).feedback
    return f.select("user_id", "content_id", "source_id", "impression_count", "open_count", "save_count", "dismiss_count", "visible_ms", *r6("read_ratio", "score"), "last_interacted_at")


@register("a8_user_source_affinity", over(f"SELECT user_id, source_id, {sql6('score')}, signals, last_interacted_at FROM source_affinity"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).source_affinity.select("user_id", "source_id", *r6("score"), "signals", "last_interacted_at")


@register("a9_user_topic_affinity", over(f"SELECT user_id, topic_id, {sql6('score')}, signals, last_interacted_at FROM topic_affinity"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).topic_affinity.select("user_id", "topic_id", *r6("score"), "signals", "last_interacted_at")


@register("a10_content_halo", over(f"SELECT content_id, halo_date, signals, {sql6('score')} FROM content_halo"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).content_halo.select("content_id", "halo_date", "signals", *r6("score"))


@register("a11_source_halo", over(f"SELECT source_id, halo_date, signals, {sql6('score')} FROM source_halo"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).source_halo.select("source_id", "halo_date", "signals", *r6("score"))


@register("a12_refresh_dirty", over(f"SELECT user_id, content_id, {sql6('score')} FROM feedback WHERE user_id IN (SELECT user_id FROM ev GROUP BY user_id HAVING max(occurred_at) >= {NOW} - INTERVAL 2 DAY)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Feedback of the users that late events touched: a semi-join to the dirty set ahead of the rollup."""
    r = Recommender(spark, d)
    dirty = rollup.dirty_targets(r.events, r.keys).filter(F.col("last_marked_at") >= r.now - F.expr("INTERVAL 2 DAYS")).filter("kind = 'user'").select(F.col("id").cast("long").alias("user_id"))
    daily = rollup.content_feedback_daily(r.events.join(dirty, "user_id", "left_semi"), r.keys)
    return user_content_feedback(daily, r.content, r.now).select("user_id", "content_id", *r6("score"))


@register("a13_user_context", over("SELECT user_id, array_to_string(languages, ',') AS languages, array_to_string(subscribed, ',') AS subscribed, array_to_string(top_topics, ',') AS top_topics, array_to_string(top_sources, ',') AS top_sources FROM context"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).context.select("user_id", *(F.array_join(c, ",").alias(c) for c in ("languages", "subscribed", "top_topics", "top_sources")))


@register("a14_content_buckets", over("SELECT * FROM buckets"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).buckets


_SIX = ("topic_score", "source_affinity_score", "content_halo_score", "source_halo_score", "editorial_score", "curated_score", "read_ratio")


@register("a14_content_candidates", over(f"SELECT user_id, content_id, source_id, subscribed, discovery, saved_adjacent, trending, evergreen, {sql6(*_SIX)}, primary_topic_slug, dismiss_count, mark_read_count FROM candidates"))
def _(spark: SparkSession, d: str) -> DataFrame:
    c = Recommender(spark, d).content_candidates
    return c.select("user_id", "content_id", "source_id", *candidates.BUCKETS, *r6(*_SIX), "primary_topic_slug", "dismiss_count", "mark_read_count")


@register("m5_scored_content", over(f"SELECT user_id, content_id, {sql6('score')} FROM scored"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).scored_content.select("user_id", "content_id", *r6("score"))


@register("a15_recommend_content", picks("scored", "content_id", "round(score, 9) DESC, subscribed DESC, saved_adjacent DESC, discovery DESC, trending DESC, evergreen DESC, published_at DESC, content_id DESC", {"source_id": (2, 4), "primary_topic_slug": (3, 5)}))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).recommend_content().select("user_id", "content_id", "position", *r6("score"))


@register("a16_topic_candidates", over("SELECT user_id, content_id, topic_id FROM (SELECT c.user_id, c.content_id, 'n' || (c.user_id % 25) AS topic_id, c.source_id FROM candidates c) x WHERE EXISTS (SELECT 1 FROM content_topics t WHERE t.content_id = x.content_id AND t.topic_id = x.topic_id) OR EXISTS (SELECT 1 FROM source_topics t WHERE t.source_id = x.source_id AND t.topic_id = x.topic_id)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    r = Recommender(spark, d)
    wanted = r.users.select("user_id", F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string")).alias("topic_id"))
    return candidates.of_topic(r.content_candidates, wanted, r.content_topics, r.source_topics).select("user_id", "content_id", "topic_id")


_SRC = ("topic_score", "source_halo_score", "similarity_score", "editorial_score")


@register("a17_source_candidates", over(f"SELECT user_id, source_id, {sql6(*_SRC)}, primary_topic_slug, recent_activity_count FROM source_candidates"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).source_candidates.select("user_id", "source_id", *r6(*_SRC), "primary_topic_slug", "recent_activity_count")


@register("m6_scored_sources", over("SELECT user_id, source_id, round(0.32e0*least(greatest(topic_score,0e0),2e0)/2 + 0.20e0*editorial_score + 0.18e0*source_halo_score + 0.12e0*similarity_score + 0.10e0*least(recent_activity_count,20)/20e0 + 0.08e0 + 1e-9, 6) AS score FROM source_candidates"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).scored_sources.select("user_id", "source_id", *r6("score"))


_SCORED_SOURCES = "(SELECT *, 0.32e0*least(greatest(topic_score,0e0),2e0)/2 + 0.20e0*editorial_score + 0.18e0*source_halo_score + 0.12e0*similarity_score + 0.10e0*least(recent_activity_count,20)/20e0 + 0.08e0 AS score FROM source_candidates)"


@register("a18_recommend_sources", picks(_SCORED_SOURCES, "source_id", "round(score, 9) DESC, round(topic_score, 9) DESC, round(editorial_score, 9) DESC, round(source_halo_score, 9) DESC, recent_activity_count DESC, source_id", {"primary_topic_slug": (2, 4)}))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).recommend_sources().select("user_id", "source_id", "position", *r6("score"))


@register("a19_source_preview", over(f"""SELECT source_id, primary_topic_slug, recent_activity_count, round(topic_score + 1e-9, 6) AS topic_score, round(1e-9 + 0.50e0*least(topic_score,2e0)/2 + 0.30e0*editorial_score + 0.10e0*source_halo_score + 0.10e0*least(recent_activity_count,20)/20e0, 6) AS score FROM (
    SELECT m.source_id, m.primary_topic_slug, m.topic_score, n AS recent_activity_count, editorial_score, coalesce(h.s, 0e0) AS source_halo_score FROM (
      SELECT source_id, least(sum(w), 2e0) AS topic_score, first(slug ORDER BY w DESC, slug) AS primary_topic_slug FROM (SELECT source_id, slug, confidence * pow(0.85e0, depth) AS w FROM source_topics k JOIN (SELECT descendant_id, min(depth) AS depth FROM closure WHERE ancestor_id IN ('r1', 'n3') GROUP BY descendant_id) x ON x.descendant_id = k.topic_id JOIN topics t ON t.id = k.topic_id) GROUP BY source_id) m
    JOIN (SELECT source_id, count(*) AS n FROM content WHERE published_at >= {NOW} - INTERVAL 30 DAY AND (language_code IS NULL OR language_code IN ('en', 'de')) GROUP BY source_id) r USING (source_id) JOIN sources s ON s.id = m.source_id
    LEFT JOIN (SELECT source_id, avg(score) AS s FROM source_halo WHERE halo_date >= CAST({NOW} AS DATE) - 30 GROUP BY source_id) h ON h.source_id = m.source_id)"""))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).preview(["r1", "n3"], ["en", "de"]).select("source_id", "primary_topic_slug", "recent_activity_count", *r6("topic_score", "score"))


@register("a20_subtopics", over("""SELECT a.user_id, a.topic_id, t.slug, p.slug AS parent_slug, round(a.score + 1e-9, 6) AS affinity_score,
    EXISTS (SELECT 1 FROM preferences x JOIN closure l ON l.ancestor_id = x.topic_id WHERE x.user_id = a.user_id AND l.descendant_id = a.topic_id) AS from_settings,
    EXISTS (SELECT 1 FROM feedback f JOIN content_topics k USING (content_id) WHERE f.user_id = a.user_id AND k.topic_id = a.topic_id) OR EXISTS (SELECT 1 FROM source_affinity f JOIN source_topics k USING (source_id) WHERE f.user_id = a.user_id AND k.topic_id = a.topic_id) AS from_behavior
    FROM topic_affinity a JOIN topics t ON t.id = a.topic_id JOIN topics p ON p.id = t.parent_id WHERE a.score > 0 AND NOT EXISTS (SELECT 1 FROM topics c WHERE c.parent_id = t.id)"""))
def _(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(spark, d).subtopics.withColumn("affinity_score", F.round(F.col("affinity_score") + 1e-9, 6))


@register("a21_topic_tree", over("SELECT r.id, r.slug, r.label, coalesce(string_agg(c.slug, ',' ORDER BY c.slug), '') AS children FROM topics r LEFT JOIN topics c ON c.parent_id = r.id WHERE r.parent_id IS NULL GROUP BY r.id, r.slug, r.label"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.tree(E.topics(spark, d)).withColumn("children", F.array_join("children", ","))


@register("a22_topic_closure", over("SELECT * FROM closure"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.closure(E.topics(spark, d))


@register("a22_topic_cycles", "SELECT 'r' || r_regionkey AS id FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'n' || min(n_nationkey) FROM nation WHERE n_regionkey < 3 GROUP BY n_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of three regions each stands below its own first nation."""
    first = table(spark, d, "nation").filter("n_regionkey < 3").groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id")).agg(F.concat(F.lit("n"), F.min("n_nationkey").cast("string")).alias("below"))
    tree = E.topics(spark, d).join(first, "id", "left").select("id", F.coalesce("below", "parent_id").alias("parent_id"))
    return topics.cycles(tree)


@register("a24_backfill_topics", over("SELECT content_id, topic_id, round(confidence + 1e-9, 6) AS confidence FROM content_topics WHERE content_id % 2 = 0 UNION ALL SELECT c.id, topic_id, round(confidence * 0.8e0 + 1e-9, 6) FROM content c JOIN source_topics s ON s.source_id = c.source_id WHERE c.id % 2 = 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    have = E.content_topics(spark, d).filter("content_id % 2 = 0")
    return topics.backfill_content_topics(E.content_keys(spark, d), have, E.source_topics(spark, d)).select("content_id", "topic_id", *r6("confidence"))


@register("a25_seed_halo", over("SELECT content_id, halo_date, round(max(score) + 1e-9, 6) AS score FROM (SELECT content_id, halo_date, score FROM content_halo UNION ALL SELECT content_id, DATE '2024-01-15', curated_score FROM curated) GROUP BY content_id, halo_date"))
def _(spark: SparkSession, d: str) -> DataFrame:
    r = Recommender(spark, d)
    seeds = r.curated.select("content_id", F.to_date(F.lit("2024-01-15")).alias("halo_date"), F.col("curated_score").alias("score"))
    return rollup.seeded_halo(r.content_halo, seeds).select("content_id", "halo_date", *r6("score"))


@register("a26_replace_topics", over("SELECT content_id, topic_id, confidence FROM content_topics UNION ALL SELECT c.content_id, 'r1', 0.95e0 FROM curated c WHERE NOT EXISTS (SELECT 1 FROM content_topics t WHERE t.content_id = c.content_id AND t.topic_id = 'r1')"))
def _(spark: SparkSession, d: str) -> DataFrame:
    r = Recommender(spark, d)
    return topics.replace_topics(r.content_topics, r.curated.select("content_id", F.array(F.lit("r1")).alias("topics")))


@register("a27_serve_log")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = Recommender(spark, d)
    return rerank.served(r.recommend_content(10, ("parts",)), "content", "content_id", "v1", r.now)


@register("a28_halo_by_users", over("SELECT content_id, CAST(occurred_at AS DATE) AS halo_date, count(DISTINCT user_id) FILTER (WHERE event_type = 'open') AS openers, count(DISTINCT user_id) FILTER (WHERE event_type = 'save') AS savers FROM ev WHERE content_id IS NOT NULL GROUP BY ALL"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The full rebuild's counts, which go by distinct users."""
    n = lambda k: F.count_distinct(F.when(F.col("event_type") == k, F.col("user_id")))
    return E.events(spark, d).filter("content_id IS NOT NULL").groupBy("content_id", F.to_date("occurred_at").alias("halo_date")).agg(n("open").alias("openers"), n("save").alias("savers"))
