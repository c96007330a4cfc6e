"""The entities of a reading application, bound to the tables at hand.

Each function takes (spark, folder) and returns a DataFrame; columns that no table has are derived by fixed rules from
ids, so that every query has a deterministic input. ``AS_OF`` stands for "now" throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scoring import tier_score
from tidemark.operators.feeds import deliver
from tidemark.sources.tables import table

AS_OF = "2024-01-31 00:00:00"
WORD = r"[^\x20\x09-\x0D]+"
EVENT_TYPES = {"view": "impression", "click": "open", "purchase": "save", "signup": "subscribe", "error": "dismiss"}


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def _number(source: Column) -> Column:
    return F.regexp_extract(source, r"(\d+)", 1).cast("int")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Interaction events; a sign-up is a subscription to a source, everything else concerns a content."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in EVENT_TYPES.items() for x in pair)), F.col("event_type"))
    signup = F.col("event_type") == "signup"
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.when(~signup, k).alias("content_id"),
        F.when(signup, F.concat(F.lit("src"), (k % 20).cast("string"))).alias("source_id"),
        kind.alias("event_type"),
        F.round(F.col("value") * 1000).cast("long").alias("visible_ms"),
        F.col("ts").alias("occurred_at"),
    )


def content(spark: SparkSession, folder: str) -> DataFrame:
    words = F.regexp_count("text", F.lit(WORD))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("language_code"),
        F.greatest(F.lit(1), F.ceil(words / 220 * 60)).cast("int").alias("estimated_read_seconds"),
        (as_of() - F.make_dt_interval((F.col("doc_id") % 60).cast("int"))).alias("published_at"),
    )


def content_keys(spark: SparkSession, folder: str) -> DataFrame:
    """content without what needs the text."""
    return content(spark, folder).drop("estimated_read_seconds")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select(F.col("source").alias("id")).filter("id IS NOT NULL").distinct()
    tier = (1 + _number(F.col("id")) % 5).cast("int")
    return names.withColumn("quality_tier", tier).withColumn("editorial_score", tier_score(F.col("quality_tier")))


def topics(spark: SparkSession, folder: str) -> DataFrame:
    roots = table(spark, folder, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lower("r_name").alias("label"), F.lit(None).cast("string").alias("parent_id"))
    leaves = table(spark, folder, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lower("n_name").alias("label"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    return roots.unionByName(leaves).select("id", F.translate("label", " ", "-").alias("slug"), "label", "parent_id")


def content_topics(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, folder, "documents").select(i.alias("content_id"), F.concat(F.lit("n"), (i % 25).cast("string")).alias("topic_id"), (0.5 + (i % 5) / 10).alias("confidence"))


def source_topics(spark: SparkSession, folder: str) -> DataFrame:
    n = _number(F.col("id"))
    own = sources(spark, folder)
    first = own.select(F.col("id").alias("source_id"), F.concat(F.lit("n"), (n % 25).cast("string")).alias("topic_id"), (0.5 + (n % 5) / 10).alias("confidence"))
    second = own.select(F.col("id").alias("source_id"), F.concat(F.lit("n"), ((n * 7 + 3) % 25).cast("string")).alias("topic_id"), F.lit(0.4).alias("confidence"))
    return first.unionByName(second).groupBy("source_id", "topic_id").agg(F.max("confidence").alias("confidence"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Users with their preferred languages."""
    u = F.col("user_id")
    languages = F.when(u % 4 == 0, F.array(F.lit("en"))).when(u % 4 == 1, F.array(F.lit("de"), F.lit("en"))).otherwise(F.array().cast("array<string>"))
    return events(spark, folder).select("user_id").distinct().withColumn("languages", languages)


def topic_preferences(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("user_id")
    return users(spark, folder).filter(u % 3 == 0).select("user_id", F.concat(F.lit("r"), (u % 5).cast("string")).alias("topic_id"), F.lit(1.0).alias("weight"))


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).filter("event_type = 'subscribe'").select("user_id", "source_id").distinct()


def saved(spark: SparkSession, folder: str) -> DataFrame:
    u, c = F.col("user_id"), F.col("content_id")
    rows = events(spark, folder).filter("event_type = 'save'").groupBy("user_id", "content_id").agg(F.max("occurred_at").alias("updated_at"))
    return rows.select("user_id", "content_id", "updated_at", F.when((u + c) % 11 == 0, F.col("updated_at")).alias("archived_at"), F.when((u + c) % 3 == 0, "read").otherwise("unread").alias("read_state"), ((u + c) % 5 == 0).alias("is_favorited"))


def inbox(spark: SparkSession, folder: str, follows: DataFrame | None = None, entries: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """What each subscription has brought its user: a row for each content of its source, far more rows than any table has.

    No row of it is shuffled: what else is to be known of a row is brought to one of its sides first. follows: the
    subscriptions, with more columns that their rows get; entries: the contents (content_id, source_id, published_at), with
    more; marks: (user_id, content_id), which give their rows ``is_marked``.
    """
    follows = subscriptions(spark, folder) if follows is None else follows
    entries = inbox_entries(spark, folder) if entries is None else entries
    return inbox_states(deliver(follows, entries, marks))


def inbox_entries(spark: SparkSession, folder: str) -> DataFrame:
    return content_keys(spark, folder).select(F.col("id").alias("content_id"), "source_id", "published_at")


def inbox_states(pairs: DataFrame) -> DataFrame:
    """Rows of user and content with the columns that an inbox has of them."""
    u, c = F.col("user_id"), F.col("content_id")
    return pairs.withColumns(
        {
            "id": u * 1_000_000 + c,
            "delivered_at": F.col("published_at") + F.expr("INTERVAL 1 HOUR"),
            "dismissed_at": F.when((u + c) % 17 == 0, F.col("published_at")),
            "read_state": F.when((u + c) % 4 == 0, "read").otherwise("unread"),
        }
    )


def curated(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, folder, "labels").filter((F.col("quality") == 1) & (i % 7 == 0))
    return rows.select(i.alias("content_id"), (0.5 + (i % 5) / 10).alias("curated_score"), F.when(i % 2 == 0, (i % 10).cast("int")).alias("source_rank"))
