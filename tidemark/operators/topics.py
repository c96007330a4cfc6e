"""The topic tree: closure, cycles, listing, leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import language_codes
from tidemark.runtime import cut

def closure(topics: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, depth) with each topic as its own ancestor at depth 0, each pair at its least depth.

    The tree may be of any depth: each round goes one level up, until none finds a pair that wasn't there, so cycles end too.
    """
    parents = topics.select(F.col("id").alias("child"), "parent_id").filter("parent_id IS NOT NULL")
    level = topics.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("depth"))
    found = level
    depth = 0
    while True:
        depth += 1
        up = level.join(parents, F.col("ancestor_id") == F.col("child")).select(F.col("parent_id").alias("ancestor_id"), "descendant_id", F.lit(depth).alias("depth"))
        level = up.join(found.filter("depth > 0"), ["ancestor_id", "descendant_id"], "left_anti").distinct()
        # Each level is read by the next; deep trees don't make long plans.
        level = cut(level) if depth % 4 == 0 else level
        if level.isEmpty():
            return found.groupBy("ancestor_id", "descendant_id").agg(F.min("depth").alias("depth"))
        found = found.unionByName(level)


def rejected_parents(topics: DataFrame, moves: DataFrame) -> DataFrame:
    """Of moves (id, parent_id) of topics those that would make a cycle; moves are judged one by one, against the tree as it is."""
    links = closure(topics)
    below = links.select(F.col("ancestor_id").alias("id"), F.col("descendant_id").alias("parent_id"))
    return moves.join(below, ["id", "parent_id"], "left_semi")


def cycles(topics: DataFrame) -> DataFrame:
    """Topics that are their own ancestors: those that a parent's ancestors lead back to."""
    links = closure(topics).select("ancestor_id", F.col("descendant_id").alias("parent_id"))
    return topics.select("id", "parent_id").join(links, "parent_id").filter(F.col("ancestor_id") == F.col("id")).select("id").distinct()


def tree(topics: DataFrame) -> DataFrame:
    """Roots with their children by slug."""
    children = topics.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("slug")).alias("children"))
    return topics.filter("parent_id IS NULL").join(children, "id", "left").select("id", "slug", "label", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def subtopics(topics: DataFrame, links: DataFrame, affinity: DataFrame, preferences: DataFrame, feedback: DataFrame, source_affinity: DataFrame, content_topics: DataFrame, source_topics: DataFrame) -> DataFrame:
    """Leaf topics that a user likes, and whether settings or behaviour brought them."""
    parent = topics.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    inner = topics.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    leaves = topics.filter("parent_id IS NOT NULL").join(inner, "id", "left_anti").join(parent, "parent_id").select(F.col("id").alias("topic_id"), "slug", "parent_slug")
    chosen = preferences.join(links, preferences.topic_id == links.ancestor_id).select("user_id", F.col("descendant_id").alias("topic_id")).distinct().withColumn("from_settings", F.lit(True))
    read = feedback.filter("last_interacted_at IS NOT NULL").join(content_topics, "content_id").select("user_id", "topic_id")
    met = source_affinity.filter("last_interacted_at IS NOT NULL OR signals > 0 OR score <> 0").join(source_topics, "source_id").select("user_id", "topic_id")
    behaved = read.unionByName(met).distinct().withColumn("from_behavior", F.lit(True))
    rows = affinity.filter("score > 0").join(leaves, "topic_id").join(chosen, ["user_id", "topic_id"], "left").join(behaved, ["user_id", "topic_id"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("user_id", "topic_id", "slug", "parent_slug", F.col("score").alias("affinity_score"), flag("from_settings"), flag("from_behavior"))


def backfill_content_topics(content: DataFrame, content_topics: DataFrame, source_topics: DataFrame, overwrite: bool = False, factor: float = 0.8) -> DataFrame:
    """content_topics with what contents inherit from their sources; contents with topics keep theirs unless overwrite."""
    inherited = content.select(F.col("id").alias("content_id"), "source_id").join(source_topics, "source_id").select("content_id", "topic_id", (F.col("confidence") * factor).alias("confidence"))
    if overwrite:
        kept = content_topics.join(inherited.select("content_id").distinct(), "content_id", "left_anti")
        return kept.unionByName(inherited)
    return content_topics.unionByName(inherited.join(content_topics.select("content_id").distinct(), "content_id", "left_anti"))


def replace_preferences(preferences: DataFrame, chosen: DataFrame, weight: float = 1.0) -> DataFrame:
    """Users of chosen (user_id, topics) prefer those topics in place of what they had; others keep theirs."""
    rest = preferences.join(chosen.select("user_id"), "user_id", "left_anti").select("user_id", "topic_id", "weight")
    return rest.unionByName(chosen.select("user_id", F.explode(F.array_distinct("topics")).alias("topic_id"), F.lit(weight).alias("weight")))


def languages_updated(preferences: DataFrame, changes: DataFrame) -> DataFrame:
    """Preferred languages (user_id, languages) after changes: users of changes have theirs, in normal form, others keep theirs."""
    new = changes.select("user_id", language_codes(F.col("languages")).alias("languages"))
    return preferences.join(new.select("user_id"), "user_id", "left_anti").select("user_id", "languages").unionByName(new)


def replace_topics(content_topics: DataFrame, chosen: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Curated topics (content_id, topics) in place of those at the same confidence; other rows stay and win ties."""
    rest = content_topics.join(chosen.select("content_id"), "content_id", "left_semi").filter(F.col("confidence") != confidence).unionByName(content_topics.join(chosen.select("content_id"), "content_id", "left_anti"))
    new = chosen.select("content_id", F.explode(F.array_distinct("topics")).alias("topic_id"), F.lit(confidence).alias("confidence"))
    return rest.unionByName(new.join(rest.select("content_id", "topic_id"), ["content_id", "topic_id"], "left_anti"))
