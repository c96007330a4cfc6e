"""Feeds: discovery, entries, new ones, delivery to subscribers."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.urls import canonical_url, host
from tidemark.runtime import bites, ship
from tidemark.schemas import FEED

#: Entries of a feed that count, entries of a first delivery, tries, seconds until the next look.
MOST_ENTRIES, BACKFILL, MOST_TRIED = 100, 30, 8
NEXT_SECONDS = {"success": 3_600, "unchanged": 3_600, "no_feed": 21_600, "retryable": 60, "failed": 3_600}
FEED_KINDS = ("rss", "atom", "xml")
COMMON_PATHS = ("/feed", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/index.xml")


def feed_candidates(pages: DataFrame) -> DataFrame:
    """Where a site's feed may be: (page_id, feed_url, score), the best eight of each page.

    pages: page_id, host, root (its address) and links (rel, type, href). An alternate link counts if its type names rss,
    atom or xml; hosts are the same only if they are equal.
    """
    root = F.rtrim("root", F.lit("/"))
    linked = pages.select("page_id", "host", "root", F.explode(F.filter("links", lambda x: x["rel"].contains("alternate") & (F.trim(x["href"]) != ""))).alias("link"))
    href, kind = F.trim(F.col("link.href")), F.lower(F.coalesce(F.col("link.type"), F.lit("")))
    full = canonical_url(F.when(href.rlike(r"(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(F.concat(root, F.lit("/"), F.ltrim(href, F.lit("/")))))
    typed = linked.withColumn("feed_url", full).filter(F.exists(F.array(*map(F.lit, FEED_KINDS)), lambda k: kind.contains(k)) & F.col("feed_url").isNotNull())
    named = F.exists(F.array(F.lit("feed"), F.lit("rss"), F.lit("atom")), lambda k: F.col("feed_url").contains(k))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = 100 + points(host(F.col("feed_url")) == F.col("host"), 20) + points(kind.contains("rss"), 10) + points(kind.contains("atom"), 8) + points(named, 5)
    guessed = pages.select("page_id", F.explode(F.array(*(F.concat(root, F.lit(p)) for p in COMMON_PATHS))).alias("feed_url"), F.lit(50).alias("score"))
    best = typed.select("page_id", "feed_url", score.alias("score")).unionByName(guessed).groupBy("page_id", "feed_url").agg(F.max("score").alias("score"))
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "feed_url")
    return best.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MOST_TRIED).drop("n")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _feed(xml: str) -> dict | None:
    """RSS, RDF or Atom, whatever namespaces they use; None for what isn't XML."""
    try:
        root = ET.fromstring((xml or "").strip())
    except ET.ParseError:
        return None
    atom = _local(root.tag) == "feed"
    channel = root if atom else next((c for c in root if _local(c.tag) == "channel"), root)

    def text(node, *names: str) -> str | None:
        for name in names:
            for child in node:
                if _local(child.tag) == name and "".join(child.itertext()).strip():
                    return " ".join("".join(child.itertext()).split())
        return None

    entries = []
    for k, item in enumerate([x for x in root.iter() if _local(x.tag) == ("entry" if atom else "item")][:MOST_ENTRIES]):
        link = next((x.get("href") for x in item if _local(x.tag) == "link" and x.get("rel", "alternate") == "alternate" and x.get("href")), None) or text(item, "link")
        if link:
            entries.append({"entry_key": text(item, "guid", "id") or f"{link}#{k}", "url": link, "title": text(item, "title"), "author": text(item, "creator", "author"), "summary": text(item, "description", "summary"), "published": text(item, "pubdate", "published", "updated", "date")})
    return {"kind": "atom" if atom else "rss", "title": text(channel, "title"), "entries": entries}


def _feeds(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        for a, b in bites(len(t or "") for t in texts):
            yield pd.DataFrame([_feed(t) or {"kind": None, "title": None, "entries": None} for t in texts.iloc[a:b]], columns=["kind", "title", "entries"])


def read_feed(xml: Column) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf(FEED)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _feeds(batches)

    return read(xml)


def first_of_key(entries: DataFrame, feed: str = "feed_id", key: str = "entry_key", place: str = "place") -> DataFrame:
    """Of a feed's entries with one key the first."""
    rest = [c for c in entries.columns if c not in (feed, key)]
    return entries.groupBy(feed, key).agg(F.min_by(F.struct(*rest), F.col(place)).alias("r")).select(feed, key, "r.*")


def new_entries(entries: DataFrame, known: DataFrame) -> DataFrame:
    return entries.join(known.select("feed_id", "entry_key"), ["feed_id", "entry_key"], "left_anti")


def seen(known: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Known entries after a look: new ones added, the others' last sight refreshed."""
    met = entries.select("feed_id", "entry_key", "content_id").distinct().withColumn("met", F.lit(True))
    rows = known.join(met.withColumnRenamed("content_id", "new_id"), ["feed_id", "entry_key"], "full")
    return rows.select("feed_id", "entry_key", F.coalesce("content_id", "new_id").alias("content_id"), F.when(F.col("met"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))


def missing_content(entries: DataFrame, content: DataFrame) -> DataFrame:
    """Addresses of entries that no content has yet."""
    return entries.select("canonical_url", "source_id").filter("canonical_url IS NOT NULL").groupBy("canonical_url").agg(F.min("source_id").alias("source_id")).join(content.select("canonical_url"), "canonical_url", "left_anti")


def content_added(content: DataFrame, entries: DataFrame, new_id: Column) -> DataFrame:
    """content (id, canonical_url, source_id) with the entries' addresses that it hasn't; contents without a source get their entry's."""
    wanted = entries.filter("canonical_url IS NOT NULL").groupBy("canonical_url").agg(F.min("source_id").alias("entry_source"))
    linked = content.join(wanted, "canonical_url", "left").select("id", "canonical_url", F.coalesce("source_id", "entry_source").alias("source_id"))
    added = missing_content(entries, content).select(new_id.alias("id"), "canonical_url", "source_id")
    return linked.unionByName(added)


def promoted(feeds: DataFrame, newly: DataFrame) -> DataFrame:
    """feeds after those of newly (source_id, feed_url) became the primary ones of their sources, and the others of these sources were demoted."""
    new = newly.select("source_id", F.col("feed_url").alias("main_url"))
    return feeds.join(new, "source_id", "left").withColumn("is_primary", F.when(F.col("main_url").isNotNull(), F.col("feed_url") == F.col("main_url")).otherwise(F.col("is_primary"))).select(*feeds.columns)


def without_feeds(feeds: DataFrame, gone: DataFrame) -> DataFrame:
    """feeds without those of gone (feed_url); a source that loses its primary feed gets the oldest of the rest, primary ones first."""
    left = feeds.join(gone.select("feed_url"), "feed_url", "left_anti")
    main = primary_feed(left).select("source_id", F.col("feed_url").alias("main_url"))
    return left.join(main, "source_id").withColumn("is_primary", F.col("feed_url") == F.col("main_url")).select(*feeds.columns)


def refreshed(sources: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """sources (source_id, status, last_error, http_status, refreshed_at, next_refresh_at) after results (source_id, outcome, http_code, message).

    Success and an unchanged feed clear the error and count as refreshed; a site without feed and a failure keep the last
    refresh and say what went wrong, in 500 characters at most.
    """
    rows = sources.join(results, "source_id", "left")
    met, fine = F.col("outcome").isNotNull(), F.col("outcome").isin("success", "unchanged")
    status = F.when(fine, "succeeded").when(F.col("outcome") == "no_feed", "no_feed").otherwise("failed")
    new = {
        "status": F.when(met, status).otherwise(F.col("status")),
        "last_error": F.when(~met, F.col("last_error")).when(~fine, F.substring("message", 1, 500)),
        "http_status": F.when(met, F.col("http_code")).otherwise(F.col("http_status")),
        "refreshed_at": F.when(met & fine, now).otherwise(F.col("refreshed_at")),
        "next_refresh_at": F.when(met, next_refresh(F.col("outcome"), now)).otherwise(F.col("next_refresh_at")),
    }
    return rows.select("source_id", *(c.alias(k) for k, c in new.items()))


def discovery_method(source_url: Column, feed_url: Column) -> Column:
    """How a feed was found: given as it is, at a usual place, or by a link of the page."""
    tail = lambda u: F.regexp_replace(u, r"^[A-Za-z]+://[^/?#]*|#.*$", "")
    usual = F.lit(False)
    for path in COMMON_PATHS:
        usual = usual | feed_url.endswith(path)
    return F.when(tail(source_url) == tail(feed_url), "provided").when(usual, "common_path").otherwise("html_link")


#: A source's contents are dealt into so many slices, its subscriptions into so many shards; a task takes one of each.
SLICES, SHARDS = 4, 4


def deliver(follows: DataFrame, entries: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Each row of follows (user_id, source_id, ...) with each of entries (content_id, source_id, ...) of its source.

    These rows are many more than those of both tables, so none is shuffled: what marks (user_id, content_id) says, in
    ``is_marked``, reaches the subscriptions first, as one short list for each slice of a source's contents. A row of
    follows is sent once a slice, one of entries once a shard; there a slice is one array, taken apart for each of them.
    """
    asks, part = follows, lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    if marks is not None:
        owner = entries.select("content_id", "source_id").distinct()
        own = marks.select("user_id", "content_id").join(owner, "content_id").groupBy("user_id", "source_id").agg(F.collect_set("content_id").alias("_marked"))
        asks = asks.join(own, ["user_id", "source_id"], "left")
    asks = asks.select("*", part("user_id", SHARDS).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    if marks is not None:
        asks = asks.withColumn("_marked", F.filter("_marked", lambda c: part(c, SLICES) == F.col("slice")))
    sliced = entries.select("*", part("content_id", SLICES).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"))
    rest = [c for c in entries.columns if c != "source_id"]
    held = sliced.groupBy("source_id", "slice", "shard").agg(F.collect_list(F.struct(*rest)).alias("_entries"))
    # A fixed number of partitions: small as the sides are, their rows multiply.
    tasks = int(follows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["source_id", "slice", "shard"]
    rows = asks.repartition(tasks, *by).join(held.hint("shuffle_hash"), by).drop("slice", "shard")
    rows = rows.select(*(c for c in rows.columns if c != "_entries"), F.inline("_entries"))
    if marks is None:
        return rows
    return rows.withColumn("is_marked", F.coalesce(F.array_contains("_marked", F.col("content_id")), F.lit(False))).drop("_marked")


def undelivered(rows: DataFrame) -> DataFrame:
    """(user_id, source_id, content_id) of the rows that are to be delivered, where each pair brings what it goes by.

    rows: user_id, source_id, content_id, backfilled_at of the subscription, is_newest and is_fresh of the entry, and
    whether the inbox is_held it already. ``deliveries`` says the same of tables that know nothing of each other's pairs.
    """
    due = F.col("is_fresh") | (F.col("is_newest") & F.col("backfilled_at").isNull())
    return rows.filter(due & ~F.col("is_held")).select("user_id", "source_id", "content_id")


def newest_entries(entries: DataFrame) -> DataFrame:
    """(source_id, content_id): the newest entries of each source, as many as a first delivery brings."""
    w = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("published_at"), F.desc("delivered_at"), "content_id")
    return entries.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= BACKFILL).select("source_id", "content_id")


def deliveries(subscriptions: DataFrame, entries: DataFrame, fresh: DataFrame, inbox: DataFrame) -> DataFrame:
    """What goes to which inbox: what is new, and for a first delivery the newest thirty entries besides; nothing twice.

    subscriptions: user_id, source_id, backfilled_at; entries and fresh: source_id, content_id, published_at, delivered_at.
    """
    first = subscriptions.filter("backfilled_at IS NULL").join(newest_entries(entries), "source_id")
    later = subscriptions.join(fresh.select("source_id", "content_id"), "source_id")
    return first.unionByName(later).select("user_id", "source_id", "content_id").distinct().join(inbox.select("user_id", "content_id"), ["user_id", "content_id"], "left_anti")


def primary_feed(feeds: DataFrame) -> DataFrame:
    """Each source's main feed: the one marked so, else the oldest."""
    return feeds.groupBy("source_id").agg(F.min_by("feed_url", F.struct((~F.col("is_primary")).cast("int"), "created_at", "feed_url")).alias("feed_url"))


def next_refresh(outcome: Column, now: Column) -> Column:
    wait = F.lit(None).cast("int")
    for name, seconds in NEXT_SECONDS.items():
        wait = F.when(outcome == name, seconds).otherwise(wait)
    return F.timestamp_add("SECOND", wait, now)
