"""Interaction events on their way into the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of events and the longest time of one heartbeat.
KINDS = ("impression", "open", "heartbeat", "save", "favorite", "mark_read", "dismiss", "subscribe", "unsubscribe", "serve")
MOST_VISIBLE_MS = 3_600_000


def validated(events: DataFrame, now: Column) -> DataFrame:
    """Events in normal form with ``reject``, the first reason against each or null.

    events: user_id, event_type, content_id, source_id, surface, visible_ms, occurred_at (Unix seconds), client_event_id.
    A content beats a source as the target; a missing time is now; a blank surface is none.
    """
    target = F.when(F.col("content_id").isNotNull(), "content").when(F.col("source_id").isNotNull(), "source")
    reject = (
        F.when(~F.coalesce(F.col("event_type").isin(*KINDS), F.lit(False)), "kind")
        .when(target.isNull(), "target")
        .when(F.trim(F.coalesce("client_event_id", F.lit(""))) == "", "client_event_id")
        .when((F.col("event_type") == "heartbeat") & ~(F.coalesce("visible_ms", F.lit(0)) > 0), "visible_ms")
        .when(~F.coalesce("visible_ms", F.lit(0)).between(0, MOST_VISIBLE_MS), "visible_ms")
    )
    surface = F.when(F.trim("surface") != "", F.trim("surface"))
    at = F.coalesce(F.timestamp_seconds("occurred_at"), now)
    return events.withColumns({"entity_type": target, "surface": surface, "occurred_at": at, "reject": reject})


def unknown_serves(events: DataFrame, serves: DataFrame) -> DataFrame:
    """Events that name a serve that was never logged (serves: serve_id)."""
    return events.filter("serve_id IS NOT NULL").join(serves.select("serve_id"), "serve_id", "left_anti").select(*events.columns)


def unknown_targets(events: DataFrame, content: DataFrame, sources: DataFrame) -> DataFrame:
    """Events whose content or source doesn't exist."""
    no_content = events.filter("content_id IS NOT NULL").join(content.select(F.col("id").alias("content_id")), "content_id", "left_anti")
    no_source = events.filter("content_id IS NULL AND source_id IS NOT NULL").join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return no_content.select(*events.columns).unionByName(no_source.select(*events.columns))


def accepted(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch that the log hasn't yet: each (user_id, client_event_id) once, the oldest, ties by the other columns."""
    keys = ["user_id", "client_event_id"]
    first = batch.groupBy(*keys).agg(F.min(F.struct("occurred_at", *(c for c in batch.columns if c not in (*keys, "occurred_at")))).alias("row"))
    return first.join(log.select(*keys), keys, "left_anti").select(*keys, "row.*").select(*batch.columns)


def subscription_transitions(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Events that changes of subscriptions (user_id, source_id) imply: subscribe and unsubscribe."""
    keys = ["user_id", "source_id"]
    came, went = new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti"), old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti")
    return came.withColumn("event_type", F.lit("subscribe")).unionByName(went.withColumn("event_type", F.lit("unsubscribe"))).withColumn("occurred_at", now)


def newly_dismissed(rows: DataFrame, now: Column) -> DataFrame:
    """``dismissals`` where each row brings its old state (was_dismissed_at; null for a new row too) with the new one."""
    return rows.filter("dismissed_at IS NOT NULL AND was_dismissed_at IS NULL").select("user_id", "content_id", F.lit("dismiss").alias("event_type"), now.alias("occurred_at"))


def dismissals(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """A dismiss event for each inbox row that is dismissed now and wasn't."""
    was = old.filter("dismissed_at IS NOT NULL").select("user_id", "content_id")
    return new.filter("dismissed_at IS NOT NULL").join(was, ["user_id", "content_id"], "left_anti").select("user_id", "content_id", F.lit("dismiss").alias("event_type"), now.alias("occurred_at"))


def transitions(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Events that changes of saved rows imply: save for a new row (not for one taken out of the archive), favorite, mark_read."""
    was = old.select("user_id", "content_id", F.col("read_state").alias("was_state"), F.col("is_favorited").alias("was_favorite"))
    rows = new.join(was, ["user_id", "content_id"], "left")
    saved = F.col("was_state").isNull()
    liked = F.col("is_favorited") & ~F.coalesce("was_favorite", F.lit(False))
    read = (F.col("read_state") == "read") & ~F.coalesce(F.col("was_state") == "read", F.lit(False))
    kinds = F.filter(F.array(F.when(saved, "save"), F.when(liked, "favorite"), F.when(read, "mark_read")), lambda k: k.isNotNull())
    return rows.select("user_id", "content_id", F.explode(kinds).alias("event_type"), now.alias("occurred_at"))
