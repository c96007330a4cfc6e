"""Daily rollups of interaction events, and popularity from them. Days are UTC days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring as S

_COUNTS = {"impression": "impression", "open": "open", "save": "save", "favorite": "favorite", "mark_read": "mark_read", "dismiss": "dismiss", "subscribe": "subscribe", "unsubscribe": "unsubscribe"}
CONTENT_SIGNALS = ("open", "heartbeat", "save", "mark_read", "dismiss")
SOURCE_SIGNALS = (*CONTENT_SIGNALS, "subscribe", "unsubscribe")


def _count(*kinds: str) -> Column:
    return F.count_if(F.col("event_type").isin(*kinds))


def _counts(*kinds: str) -> list[Column]:
    return [_count(k).alias(f"{k}_count") for k in kinds]


def _with_source(events: DataFrame, content: DataFrame) -> DataFrame:
    """Events with their own source, or else that of their content."""
    owner = content.select(F.col("id").alias("content_id"), F.col("source_id").alias("owner"))
    return events.join(owner, "content_id", "left").withColumn("source_id", F.coalesce("source_id", "owner")).drop("owner")


def content_feedback_daily(events: DataFrame, content: DataFrame) -> DataFrame:
    """Counts by user, content and day. Two sources of one key make one row, with the larger source."""
    rows = _with_source(events.filter("content_id IS NOT NULL"), content)
    return rows.groupBy("user_id", "content_id", F.to_date("occurred_at").alias("signal_date")).agg(
        F.max("source_id").alias("source_id"), *_counts("impression", "open", "save", "favorite", "mark_read", "dismiss", "heartbeat"), F.coalesce(F.sum("visible_ms"), F.lit(0)).alias("visible_ms"), F.max("occurred_at").alias("last_interacted_at")
    )


def source_signals_daily(events: DataFrame) -> DataFrame:
    """Counts by user, source and day of events that concern no content."""
    rows = events.filter("content_id IS NULL AND source_id IS NOT NULL")
    return rows.groupBy("user_id", "source_id", F.to_date("occurred_at").alias("signal_date")).agg(*_counts("impression", "open", "dismiss", "subscribe", "unsubscribe"), F.max("occurred_at").alias("last_interacted_at"))


def content_halo_daily(events: DataFrame) -> DataFrame:
    """Signals on a content by day, whoever they come from."""
    rows = events.filter("content_id IS NOT NULL")
    return rows.groupBy("content_id", F.to_date("occurred_at").alias("halo_date")).agg(_count(*CONTENT_SIGNALS).alias("signals"), *_counts("impression", "open", "save", "mark_read", "dismiss"), F.coalesce(F.sum("visible_ms"), F.lit(0)).alias("visible_ms"))


def source_halo_daily(events: DataFrame, content: DataFrame) -> DataFrame:
    """Signals on a source by day, those on its contents included."""
    rows = _with_source(events, content).filter("source_id IS NOT NULL")
    return rows.groupBy("source_id", F.to_date("occurred_at").alias("halo_date")).agg(_count(*SOURCE_SIGNALS).alias("signals"), *_counts("impression", "open", "save", "mark_read", "dismiss", "subscribe", "unsubscribe"), F.coalesce(F.sum("visible_ms"), F.lit(0)).alias("visible_ms"))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two rollups of the same shape as one: counts add up, timestamps and sources take the larger."""
    adds = [c for c in old.columns if c.endswith("_count") or c in ("visible_ms", "signals")]
    rest = [c for c in old.columns if c not in adds and c not in keys]
    both = old.unionByName(new.select(*old.columns))
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in adds), *(F.max(c).alias(c) for c in rest)).select(*old.columns)


def dirty_targets(events: DataFrame, content: DataFrame) -> DataFrame:
    """(kind, id, first_marked_at, last_marked_at) of the users, contents and sources that events touch."""
    rows = _with_source(events, content)
    marks = F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id")), F.struct(F.lit("content").alias("kind"), F.col("content_id").cast("string").alias("id")), F.struct(F.lit("source").alias("kind"), F.col("source_id").alias("id")))
    each = rows.select("occurred_at", F.explode(marks).alias("t")).select("occurred_at", "t.kind", "t.id").filter("id IS NOT NULL")
    return each.groupBy("kind", "id").agg(F.min("occurred_at").alias("first_marked_at"), F.max("occurred_at").alias("last_marked_at"))


def marked_dirty(dirty: DataFrame, targets: DataFrame, content: DataFrame, now: Column) -> DataFrame:
    """The dirty targets after marking (user_id, content_id, source_id; null: none); a content's source is marked with it."""
    marks = targets.select("user_id", "content_id", "source_id", now.alias("occurred_at"))
    return merged_dirty(dirty, dirty_targets(marks, content))


def merged_dirty(dirty: DataFrame, new: DataFrame) -> DataFrame:
    """Two lists of dirty targets as one: the first and the last time that each was marked."""
    return dirty.unionByName(new.select(*dirty.columns)).groupBy("kind", "id").agg(F.min("first_marked_at").alias("first_marked_at"), F.max("last_marked_at").alias("last_marked_at"))


#: Fixed value: targets of a kind that one refresh takes.
REFRESHED = 5_000


def to_refresh(dirty: DataFrame, most: int = REFRESHED) -> DataFrame:
    """The targets that the next refresh takes: of each kind those marked first, ties by id."""
    of = lambda kind: dirty.filter(F.col("kind") == kind).orderBy("first_marked_at", "id").limit(most)
    return of("user").unionByName(of("content")).unionByName(of("source"))


def refreshed(table: DataFrame, fresh: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """table with the rows of targets (their ids, as text) taken from fresh; a target without fresh rows loses its old ones."""
    ids = targets.select(F.col("id").alias("target")).distinct()
    is_one = F.col(key).cast("string") == F.col("target")
    return table.join(ids, is_one, "left_anti").unionByName(fresh.select(*table.columns).join(ids, is_one, "left_semi"))


def content_halo_by_users(events: DataFrame, content: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The halo of contents from the log of the last days alone, where a user's signals on a day count once."""
    recent = events.filter(F.col("content_id").isNotNull() & (F.col("occurred_at") >= now - F.make_dt_interval(F.lit(days))))
    known = recent.join(content.select(F.col("id").alias("content_id")), "content_id", "left_semi")
    daily = known.groupBy("content_id", F.to_date("occurred_at").alias("halo_date")).agg(
        F.countDistinct(F.when(F.col("event_type").isin(*CONTENT_SIGNALS), F.col("user_id"))).alias("signals"), *_counts("impression", "open", "save", "mark_read", "dismiss"), F.coalesce(F.sum("visible_ms"), F.lit(0)).alias("visible_ms")
    )
    return content_halo(daily, content)


def content_halo(daily: DataFrame, content: DataFrame) -> DataFrame:
    """daily with each day's popularity of a content."""
    seconds = content.select(F.col("id").alias("content_id"), "estimated_read_seconds")
    ratio = S.read_ratio(F.col("visible_ms"), F.coalesce("estimated_read_seconds", F.lit(1)))
    score = S.content_halo({"open": F.col("open_count"), "read_ratio": ratio, "save": F.col("save_count"), "mark_read": F.col("mark_read_count"), "dismiss": F.col("dismiss_count"), "signals": F.col("signals")})
    return daily.join(seconds, "content_id", "left").withColumn("score", score).drop("estimated_read_seconds")


def source_halo(daily: DataFrame) -> DataFrame:
    """daily with each day's popularity of a source."""
    names = ("open", "save", "mark_read", "dismiss", "subscribe", "unsubscribe")
    return daily.withColumn("score", S.source_halo({n: F.col(f"{n}_count") for n in names} | {"visible_ms": F.col("visible_ms"), "signals": F.col("signals")}))


def seeded_halo(halo: DataFrame, seeds: DataFrame) -> DataFrame:
    """halo with seed scores (content_id, halo_date, score) merged in; the larger score of a day stands."""
    both = halo.select("content_id", "halo_date", "score").unionByName(seeds.select("content_id", "halo_date", "score"))
    return both.groupBy("content_id", "halo_date").agg(F.max("score").alias("score"))


def average_halo(halo: DataFrame, key: str, now: Column, days: int) -> DataFrame:
    """Mean score of the last days by entity."""
    return halo.filter(F.col("halo_date") >= F.date_sub(F.to_date(now), days)).groupBy(key).agg(F.avg("score").alias("halo"))
