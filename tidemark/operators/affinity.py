"""What users like: feedback on contents, affinity to sources and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scoring as S

WINDOW_DAYS = 90
_NAMES = ("impression", "open", "save", "favorite", "mark_read", "dismiss")


def _recent(daily: DataFrame, now: Column) -> DataFrame:
    return daily.filter(F.col("signal_date") >= F.date_sub(F.to_date(now), WINDOW_DAYS))


def user_content_feedback(daily: DataFrame, content: DataFrame, now: Column) -> DataFrame:
    """Counts of the last ninety days by user and content, with read ratio and score; rows without any count are left out."""
    sums = _recent(daily, now).groupBy("user_id", "content_id").agg(F.max("source_id").alias("source_id"), *(F.sum(f"{n}_count").alias(f"{n}_count") for n in (*_NAMES, "heartbeat")), F.sum("visible_ms").alias("visible_ms"), F.max("last_interacted_at").alias("last_interacted_at"))
    some = sum((F.col(f"{n}_count") for n in (*_NAMES, "heartbeat")), F.lit(0)) > 0
    seconds = content.select(F.col("id").alias("content_id"), "estimated_read_seconds")
    rows = sums.filter(some).join(seconds, "content_id", "left").withColumn("read_ratio", S.read_ratio(F.col("visible_ms"), F.coalesce("estimated_read_seconds", F.lit(1))))
    score = S.feedback_score({n: F.col(f"{n}_count") for n in _NAMES} | {"read_ratio": F.col("read_ratio")})
    return rows.withColumn("score", score).drop("estimated_read_seconds")


def user_source_affinity(feedback: DataFrame, content: DataFrame, signals: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """Decayed feedback on a source's contents, decayed signals on the source, and a boost while subscribed."""
    owner = content.select(F.col("id").alias("content_id"), F.col("source_id").alias("owner"))
    read = feedback.filter("last_interacted_at IS NOT NULL").join(owner, "content_id", "left").withColumn("source_id", F.coalesce("source_id", "owner")).filter("source_id IS NOT NULL")
    by_content = read.groupBy("user_id", "source_id").agg(F.sum(F.col("score") * S.decay(F.col("last_interacted_at"), now)).alias("score"), F.count("*").alias("signals"), F.max("last_interacted_at").alias("last_interacted_at"))
    c = lambda n: F.greatest(F.col(f"{n}_count"), F.lit(0))
    weight = 0.90 * c("subscribe") - 0.90 * c("unsubscribe") - 0.60 * c("dismiss") + 0.15 * F.col("open_count") + 0.05 * F.col("impression_count")
    count = sum((F.col(f"{n}_count") for n in ("impression", "open", "dismiss", "subscribe", "unsubscribe")), F.lit(0))
    by_signal = _recent(signals, now).groupBy("user_id", "source_id").agg(F.sum(weight * S.decay(F.coalesce("last_interacted_at", now), now)).alias("score"), F.sum(count).alias("signals"), F.max("last_interacted_at").alias("last_interacted_at"))
    boost = subscriptions.select("user_id", "source_id", F.lit(0.25).alias("score"), F.lit(1).cast("long").alias("signals"), now.alias("last_interacted_at"))
    every = by_content.unionByName(by_signal).unionByName(boost)
    return every.groupBy("user_id", "source_id").agg(F.sum("score").alias("score"), F.sum("signals").alias("signals"), F.max("last_interacted_at").alias("last_interacted_at"))


def user_topic_affinity(preferences: DataFrame, feedback: DataFrame, source_affinity: DataFrame, content_topics: DataFrame, source_topics: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """Preferences flow down the tree, interest in contents and sources flows up, each weaker by depth."""
    down = preferences.join(links, preferences.topic_id == links.ancestor_id).select("user_id", F.col("descendant_id").alias("topic_id"), (F.col("weight") * 2 * F.pow(F.lit(0.8), "depth")).alias("score"), F.lit(1).cast("long").alias("signals"), now.alias("at"))
    read = feedback.filter("last_interacted_at IS NOT NULL").join(content_topics, "content_id").join(links, F.col("topic_id") == F.col("descendant_id"))
    up = read.select("user_id", F.col("ancestor_id").alias("topic_id"), (F.col("score") * F.col("confidence") * F.pow(F.lit(0.7), "depth") * S.decay(F.col("last_interacted_at"), now)).alias("score"), F.lit(1).cast("long").alias("signals"), F.col("last_interacted_at").alias("at"))
    met = source_affinity.join(source_topics, "source_id").join(links, F.col("topic_id") == F.col("descendant_id"))
    across = met.select("user_id", F.col("ancestor_id").alias("topic_id"), (F.col("score") * F.col("confidence") * F.pow(F.lit(0.75), "depth")).alias("score"), F.lit(1).cast("long").alias("signals"), F.col("last_interacted_at").alias("at"))
    return down.unionByName(up).unionByName(across).groupBy("user_id", "topic_id").agg(F.sum("score").alias("score"), F.sum("signals").alias("signals"), F.max("at").alias("last_interacted_at"))


def user_context(users: DataFrame, subscriptions: DataFrame, topic_affinity: DataFrame, source_affinity: DataFrame, top: int = 10) -> DataFrame:
    """Languages, subscribed sources, and the best topics and sources of each user, as arrays in order."""

    def best(rows: DataFrame, key: str, name: str) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc(key))
        few = rows.filter("score > 0").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top)
        return few.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", key))), lambda x: x[key]).alias(name))

    subscribed = subscriptions.groupBy("user_id").agg(F.array_sort(F.collect_set("source_id")).alias("subscribed"))
    rows = users.join(subscribed, "user_id", "left").join(best(topic_affinity, "topic_id", "top_topics"), "user_id", "left").join(best(source_affinity, "source_id", "top_sources"), "user_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("user_id", "languages", *(F.coalesce(c, none).alias(c) for c in ("subscribed", "top_topics", "top_sources")))
