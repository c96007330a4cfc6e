"""Rules of listings, deliveries, events, feeds, quality and labels, on small rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import choices, events, extract, feeds, library, quality

NOW = datetime.datetime(2024, 1, 31)


def now():
    return F.lit(NOW).cast("timestamp")


def column(spark, values, of, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(of(F.col("v"))).collect()]


def test_unused_tags_are_listed(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    tags = spark.createDataFrame([("s1", "news", "News", None), ("s2", "art", "Art", None), ("c1", "mine", "Mine", 1)], "tag_id string, slug string, label string, owner long")
    tagged = spark.createDataFrame([(1, 10, "s1"), (1, 11, "s1"), (1, 10, "c1")], "user_id long, content_id long, tag_id string")
    got = [(r.user_id, r.slug, r.n, r.place) for r in library.tag_counts(users, tags, tagged).orderBy("user_id", "place").collect()]
    assert got == [(1, "art", 0, 1), (1, "news", 2, 2), (1, "mine", 1, 3), (2, "art", 0, 1), (2, "news", 0, 2)]
    assert [[tuple(t) for t in r.tags] for r in library.tags_of(tagged, tags).orderBy("content_id").collect()] == [[("news", True, 2), ("mine", False, 1)], [("news", True, 2)]]


def test_a_row_read_no_more_has_no_time_of_reading(spark):
    saved = spark.createDataFrame([(1, k, NOW, NOW if k == 3 else None, "read", False, NOW) for k in range(5)], "user_id long, content_id long, updated_at timestamp, archived_at timestamp, read_state string, is_favorited boolean, read_at timestamp")
    changes = spark.createDataFrame([(1, 0, "unread", None, None), (1, 1, "reading", None, None), (1, 2, "read", True, True), (1, 3, None, None, False)], "user_id long, content_id long, read_state string, is_favorited boolean, is_archived boolean")
    got = {r.content_id: (r.read_at is not None, r.archived_at is not None, r.is_favorited) for r in library.updated(saved, changes, now()).collect()}
    assert got == {0: (False, False, False), 1: (False, False, False), 2: (True, True, True), 3: (True, False, False), 4: (True, False, False)}


def test_first_deliveries_have_new_entries_too(spark):
    subs = spark.createDataFrame([(1, "s", None), (2, "s", NOW)], "user_id long, source_id string, backfilled_at timestamp")
    entries = spark.createDataFrame([("s", k, NOW - datetime.timedelta(days=k), NOW) for k in range(40)], "source_id string, content_id long, published_at timestamp, delivered_at timestamp")
    none = spark.createDataFrame([(2, 35)], "user_id long, content_id long")
    got = feeds.deliveries(subs, entries, entries.filter("content_id >= 35"), none).collect()
    assert {r.content_id for r in got if r.user_id == 1} == {*range(30), *range(35, 40)}
    assert {r.content_id for r in got if r.user_id == 2} == set(range(36, 40))


def test_rows_out_of_the_archive_are_no_saves(spark):
    schema = "user_id long, content_id long, read_state string, is_favorited boolean, archived_at timestamp"
    old = spark.createDataFrame([(1, 1, "unread", False, NOW)], schema)
    new = spark.createDataFrame([(1, 1, "unread", False, None), (1, 2, "read", True, None)], schema)
    assert sorted((r.content_id, r.event_type) for r in events.transitions(old, new, now()).collect()) == [(2, "favorite"), (2, "mark_read"), (2, "save")]


def test_feeds_need_a_type_and_the_same_host(spark):
    links = [("alternate", "application/rss+xml", "/feed"), ("alternate", "", "/untyped-feed"), ("alternate", "application/atom+xml", "https://notb.org/x"), ("alternate", "text/xml", "//b.org/other"), ("stylesheet", "text/xml", "/no")]
    pages = spark.createDataFrame([(1, "b.org", "https://b.org/", links)], "page_id long, host string, root string, links array<struct<rel:string,type:string,href:string>>")
    got = [(r.feed_url, r.score) for r in feeds.feed_candidates(pages).orderBy(F.desc("score"), "feed_url").collect()]
    assert got[:3] == [("https://b.org/feed", 135), ("https://b.org/other", 120), ("https://notb.org/x", 108)] and len(got) == 8 and {s for _, s in got[3:]} == {50}


@pytest.mark.parametrize("text, want", [("Share this story now", True), ("Commentary on it", False), ("comments", True), ("Up next: more", True), ("Not sharing", False), ("Share " + "x" * 200, False), ("", False)])
def test_suspicious_blocks(spark, text, want):
    assert column(spark, [text], quality.suspicious) == [want]


def test_summaries_end_with_what_closes_a_sentence(spark):
    said = 'He said "' + "a" * 160 + '." ' + "b" * 200
    words = "word " * 39 + "c" * 200
    got = column(spark, [said, words, "d" * 300, " short  text "], X.summary)
    assert got == [said[: said.index('" b') + 1], ("word " * 39).strip(), "d" * 280, "short text"]


def test_labels_names_and_addresses(spark):
    assert column(spark, ["9:05", "09.41 GMT", "5 Mar 2024 12:30", "5 MAR 2024 12.30 CET", "soon", "25:00", "9", None], X.is_time_label) == [True, True, True, True, False, False, False, False]
    assert column(spark, ["Mon 3 May", "Monday", "4 May 2024", "4 May", "sunny", None], X.is_date_line) == [True, False, True, False, False, False]
    assert column(spark, ["A - B | C", "A", "A – " + "x" * 65, "A-B"], X.site_of_title) == ["C", None, None, None]
    assert column(spark, ["By  Ann Other | Desk", "byron", "https://x.org/me", "", "BY", "@bo"], X.author_name) == ["Ann Other", "byron", None, None, None, "@bo"]
    assert column(spark, ["@bo"], X.handle) == ["bo"]
    assert column(spark, ["a\r\nb\n\n c  d\n", "a\nb", "one"], X.split_paragraphs) == [["a b", "c d"], ["a", "b"], ["one"]]
    assert column(spark, ["https://x.com/ann/status/12?s=1", "http://www.twitter.com/bo/status/3", "https://notx.com/ann/status/1", "https://x.com/ann"], U.status_handle) == ["ann", "bo", None, None]


def test_pages_of_live_blogs_and_letters(spark):
    pages = ['<div id="liveblog-body">', '{"contentType" : "LiveBlog"}', "{'@type':'LiveBlogPosting'}", '"tone/minutebyminute"', "liveblog-body"]
    assert column(spark, pages, extract.live_blog_page) == [True, True, True, True, False]
    letters = ["available-content window._preloads = JSON.parse(", "single-post-container substackcdn.com", "available-content", "substack.com/@me"]
    assert column(spark, letters, extract.newsletter_page) == [True, True, False, False]


def test_leading_controls_are_no_text(spark):
    block = "array<struct<type:string,text:string>>"
    rows = [[("heading", "The title!"), ("paragraph", "Gift this article"), ("paragraph", "Excerpt."), ("paragraph", "Share of the market"), ("paragraph", "Body"), ("paragraph", "The title")], [("image", None), ("heading", "The title")], [("paragraph", "Shareholders meet")]]
    got = column(spark, rows, lambda v: F.transform(choices.without_echo(v, F.lit("the title"), F.lit("excerpt")), lambda b: b["text"]), block)
    assert got == [["Body", "The title"], [None, "The title"], ["Shareholders meet"]]


def test_what_a_subscription_brings_is_marked_as_by_joins(spark):
    follows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", None), (None, "a", None), (3, None, None), (4, "none", None)], "user_id long, source_id string, note string")
    entries = spark.createDataFrame([(k, s) for k, s in enumerate("aabbab" * 20)] + [(None, "a"), (500, None)], "content_id long, source_id string")
    marks = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 1), (2, 2), (None, 4), (9, 0), (1, None)], "user_id long, content_id long")
    pairs = follows.join(entries, "source_id").select("user_id", "source_id", "note", "content_id")
    want = library.inbox_view(pairs, marks.distinct()).select("user_id", "content_id", "source_id", "note", "is_saved")
    got = feeds.deliver(follows, entries, marks)
    assert sorted(map(str, got.select(*want.columns[:4], F.col("is_marked").alias("is_saved")).collect())) == sorted(map(str, want.collect()))
    assert feeds.deliver(follows, entries).count() == pairs.count()


def _shuffled(spark, frame):
    """The rows that a plan's exchanges wrote, once it has run."""
    frame.write.format("noop").mode("overwrite").save()
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("name", ["d6_inbox_view", "d7_update_inbox", "c7_deliveries", "a4_dismissals"])
def test_no_row_of_the_inbox_is_shuffled(spark, name):
    import __spark_entry__

    before = _shuffled(spark, spark.range(0))
    moved = _shuffled(spark, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.1")) - before
    assert 0 < moved < 14_814 * 500 / 10  # subscriptions, each to a source of 500 contents


def test_marks_meet_their_slices(spark):
    third = F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source_id")
    follows = spark.range(40).select(F.col("id").alias("user_id"), third)
    entries = spark.range(300).select(F.col("id").alias("content_id"), third, F.when(F.col("id") % 5 > 0, F.col("id")).alias("note"))
    marks = spark.createDataFrame([(u, c) for u in range(40) for c in range(300) if (u + c) % 7 == 0], "user_id long, content_id long")
    got = feeds.deliver(follows, entries, marks).select("user_id", "content_id", "note", "is_marked").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((u, c, c if c % 5 else None, (u + c) % 7 == 0) for u in range(40) for c in range(300) if u % 3 == c % 3), key=str)


@pytest.mark.parametrize("name", ["d6_inbox_view", "d7_update_inbox"])
def test_a_subscription_is_shuffled_a_few_times(spark, name):
    """Once a slice of its source's contents, and before that with what is known of it; not sixteen times or more."""
    import __spark_entry__

    before = _shuffled(spark, spark.range(0))
    moved = _shuffled(spark, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.1")) - before
    assert moved < 14_814 * 12


def test_states_in_place_are_those_of_joins(spark):
    inbox = spark.createDataFrame([(u, c, "s", NOW if (u + c) % 3 == 0 else None, "unread") for u in range(4) for c in range(6)], "user_id long, content_id long, source_id string, dismissed_at timestamp, read_state string")
    old = inbox.filter("content_id % 2 = 0")
    want = events.dismissals(old, inbox, now())
    got = events.newly_dismissed(inbox.withColumn("was_dismissed_at", F.when(F.col("content_id") % 2 == 0, F.col("dismissed_at"))), now())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()
    subs = spark.createDataFrame([(u, "s", NOW if u % 2 else None) for u in range(4)], "user_id long, source_id string, backfilled_at timestamp")
    entries = spark.createDataFrame([("s", k, NOW - datetime.timedelta(days=k), NOW) for k in range(50)], "source_id string, content_id long, published_at timestamp, delivered_at timestamp")
    held = spark.createDataFrame([(u, c) for u in range(4) for c in range(50) if (u + c) % 4 == 0], "user_id long, content_id long")
    want = feeds.deliveries(subs, entries, entries.filter("content_id % 7 = 0"), held).select("user_id", "source_id", "content_id")
    newest = feeds.newest_entries(entries).withColumn("is_newest", F.lit(True))
    told = entries.join(newest, ["source_id", "content_id"], "left").withColumns({"is_newest": F.coalesce("is_newest", F.lit(False)), "is_fresh": F.col("content_id") % 7 == 0})
    rows = feeds.deliver(subs, told).withColumn("is_held", (F.col("user_id") + F.col("content_id")) % 4 == 0)
    assert sorted(map(str, feeds.undelivered(rows).collect())) == sorted(map(str, want.collect())) and want.count()
