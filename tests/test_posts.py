"""Posts of threads: merging partial records in any order, what they make, and what sources hold."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import posts

DAY = datetime.datetime(2024, 1, 1)


def record(source, post_id, text, turn=0, handle=None, name=None, at=None, media=(), key="k"):
    return (key, source, turn, post_id, handle, name, at, text, [{"kind": k, "url": u, "alt": None} for k, u in media])


RECORDS = [
    record("markup", "1", "A first\n\n\n\npost https://t.co/abc", 0, "@ann"),
    record("markup", "2", "Second", 1, "ann", at=DAY + datetime.timedelta(hours=2)),
    record("payload", "1", "A first\n\npost, whole", 0, None, "Ann", DAY, [("image", "https://i.org/1.png"), ("image", "https://i.org/1.png"), ("image", "https://x.org/profile_images/2")]),
    record("payload", "2", "Secon", 1, "other", media=[("video", "v")]),
    record("payload", "9", "Not in the page", 2),
    record("payload", None, "Without id", 3),
    record("oembed", "1", "A first", 0, "ann_new", None, DAY + datetime.timedelta(days=9)),
    record("syndication", "3", "Third", 0, at=DAY + datetime.timedelta(hours=1)),
]


def merged(spark, records, root="1"):
    frame = spark.createDataFrame(records, posts.RECORD).withColumn("root_id", F.lit(root))
    return posts.ordered_posts(posts.merged_posts(frame))


def told(frame):
    return [(r.post_id, r.text, r.author_handle, r.display_name, r.published_at, [m.url for m in r.media]) for r in frame.orderBy("place").collect()]


def test_posts_merge_in_any_order(spark):
    want = [
        ("1", "A first\n\npost, whole", "ann_new", "Ann", DAY + datetime.timedelta(days=9), ["https://i.org/1.png"]),
        ("3", "Third", None, None, DAY + datetime.timedelta(hours=1), []),
        ("2", "Second", "other", None, DAY + datetime.timedelta(hours=2), ["v"]),
        (None, "Without id", None, None, None, []),
    ]
    rng = random.Random(4)
    for n in (1, 2, 7):
        mixed = RECORDS[:]
        rng.shuffle(mixed)
        frame = spark.createDataFrame(mixed, posts.RECORD).repartition(n).withColumn("root_id", F.lit("1"))
        assert told(posts.ordered_posts(posts.merged_posts(frame))) == want


def test_without_markup_all_of_the_payload_counts(spark):
    got = told(merged(spark, [r for r in RECORDS if r[1] == "payload"], root=None))
    assert [p for p, *_ in got] == ["1", None, "2", "9"]


@pytest.mark.parametrize("text, want", [("a\r\n b \n\n\n c https://t.co/x1 \n https://t.co/y2", "a\nb\n\nc"), (" \n ", None), (None, None), ("https://t.co/only", "https://t.co/only")])
def test_texts_of_posts(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(posts.post_text(F.col("t"))).first()[0] == want


def page(spark, **facts):
    known = {"key": "k", "root_id": "1", "title": None, "description": None, "cover": None, "published_at": None, "article_title": None, "article_preview": None, "article_cover": None, "is_note": False} | facts
    return spark.createDataFrame([tuple(known.values())], "key string, root_id string, title string, description string, cover string, published_at timestamp, article_title string, article_preview string, article_cover string, is_note boolean")


def made(spark, records, **facts):
    return posts.threads(spark.createDataFrame(records, posts.RECORD), page(spark, **facts)).collect()


def test_what_posts_make(spark):
    long_ = "Sentence one of it. " * 30
    assert made(spark, RECORDS)[0].kind == "thread"
    short = made(spark, [record("markup", "1", "Short.", handle="ann", media=[("image", "i")])], title='Ann on X: "Said so"', cover="c")[0]
    assert (short.kind, short.title, short.author, short.cover, [b.type for b in short.blocks]) == ("post", "Said so", "@ann", "i", ["thread_post"])
    article = made(spark, [record("markup", "1", f"A heading\n\n{long_}")], title="X")[0]
    assert (article.kind, article.title, [b.type for b in article.blocks]) == ("article", "A heading", ["paragraph"] * 2) and article.excerpt.startswith("Sentence one") and len(article.excerpt) <= 280
    assert made(spark, [record("oembed", "1", long_)], is_note=True)[0].kind == "post"
    assert made(spark, [record("payload", "1", long_)], is_note=True)[0].kind == "article"
    own = made(spark, [], article_title="T", article_preview="P one\n\nP two", article_cover="c")[0]
    assert (own.kind, own.title, own.excerpt, own.cover, [b.text for b in own.blocks]) == ("article", "T", "P one\n\nP two", "c", ["P one", "P two"])
    assert made(spark, []) == []


def test_payloads(spark):
    post = {"rest_id": "5", "legacy": {"id_str": "5", "full_text": "short", "created_at": "Wed Mar 06 10:00:00 +0000 2024", "extended_entities": {"media": [{"media_url_https": "m"}, {"video_info": {"variants": [{"url": "v"}]}}, "odd"]}}, "note_tweet": {"note_tweet_results": {"result": {"text": "the long note"}}}, "core": {"user_results": {"result": {"legacy": {"screen_name": "ann", "name": "Ann"}}}}}
    deep = current = {}
    for _ in range(30):
        current["x"] = {}
        current = current["x"]
    current |= {"id_str": "7", "full_text": "too deep"}
    rows = [("a", "https://x.com/bo/status/9", json.dumps([{"data": [post, {"full_text": " "}, {"full_text": "no id"}]}])), ("b", "https://x.org/", "{broken"), ("c", "u", json.dumps(deep)), ("d", "u", None), ("e", "u", "var x = 1")]
    got = posts.payload_records(spark.createDataFrame(rows, "key string, url string, script string")).orderBy("turn").collect()
    assert {(r.key, r.post_id, r.author_handle, r.text) for r in got} == {("a", "5", "ann", "the long note"), ("a", "5", "bo", "short"), ("a", "9", "bo", "no id")}
    whole = next(r for r in got if r.text == "the long note")
    assert whole.published_at == datetime.datetime(2024, 3, 6, 10) and [(m.kind, m.url) for m in whole.media] == [("image", "m"), ("video", "v")]


def test_embeds_and_syndication(spark):
    embed = json.dumps({"html": '<blockquote><p>Said &amp; done<br>here</p>&mdash; Ann <a href="https://t.co/z">pic</a> <a href="https://twitter.com/ann/status/12?s=1">March 6, 2024</a></blockquote>', "author_name": "Ann", "author_url": "https://twitter.com/ann"})
    r = posts.oembed_records(spark.createDataFrame([("a", "https://x.com/x/status/1", embed), ("b", "u", "{}"), ("c", "u", None), ("d", "u", json.dumps({"html": "<blockquote><p>https://t.co/q</p></blockquote>"}))], "key string, url string, embed string")).collect()
    assert [(x.key, x.post_id, x.author_handle, x.display_name, x.published_at, x.text) for x in r] == [("a", "12", "ann", "Ann", datetime.datetime(2024, 3, 6), "Said & done here")]
    answer = json.dumps({"id_str": "4", "text": "hello", "created_at": "2024-03-06T10:00:00.000Z", "user": {"name": "Bo", "screen_name": "bo"}, "mediaDetails": [{"type": "photo", "media_url_https": "p"}], "note_tweet": {"id": "n"}, "article": {"title": " T ", "preview_text": "P", "cover_media": {"media_info": {"original_img_url": "c"}}}})
    answers = spark.createDataFrame([("a", "u", answer), ("b", "u", "no"), ("c", "u", json.dumps({"id": "5", "full_text": "https://x.com/a"}))], "key string, url string, answer string")
    r = posts.syndication_records(answers).collect()
    assert [(x.key, x.post_id, x.author_handle, x.text, [m.url for m in x.media]) for x in r] == [("a", "4", "bo", "hello", ["p"])]
    facts = {x.key: x for x in posts.syndicated_facts(answers).collect()}
    assert (facts["a"].is_note, facts["a"].article_title, facts["a"].article_preview, facts["a"].article_cover) == (True, "T", "P", "c") and not facts["c"].is_note
