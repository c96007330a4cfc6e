"""Posts of threads: partial records of the same posts from several sources, merged by key, put in order, judged.

The merge takes of each post the longest text and the most media, and of the rest what the latest source says. These are
maxima over (worth, place), so records may meet in any order and in any groups: tasks merge what they have before they
send it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import collapsed, comparable, feed_date, let, split_paragraphs
from tidemark.functions.urls import status_handle, status_id
from tidemark.operators import tree
from tidemark.operators.blocks import block
from tidemark.runtime import bites, ship
from tidemark.schemas import MEDIA

#: How long a text, or how many paragraphs, make a post an article; how deep a payload is searched.
LONG_CHARS, LONG_PARAGRAPHS, DEEPEST = 420, 2, 24
#: A title-like paragraph's characters and words; a first sentence's and a cut title's; an excerpt's.
TITLE_CHARS, TITLE_WORDS, SENTENCE_CHARS, SHORT_CHARS, EXCERPT_CHARS = 120, 14, 160, 120, 280
AVATARS = r"(?i)profile_images|emoji|abs-0\.twimg\.com"
BARE_ADDRESS = r"(?i)^https?://(?:t\.co|x\.com|twitter\.com)/"
#: Sources in the order in which they are believed, the last most.
SOURCES = ("markup", "payload", "syndication", "oembed")
RECORD = f"key string, source string, turn int, post_id string, author_handle string, display_name string, published_at timestamp, text string, media array<{MEDIA}>"


def post_text(text: Column) -> Column:
    """A post's text: lines trimmed, empty ones once, without a short address at its end; null if none is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?i)(?:\s+https?://t\.co/[a-z0-9]+)+\s*$", "")
    lines = lambda part: F.array_join(F.filter(F.transform(F.split(part, "\n"), collapsed), lambda x: x != ""), "\n")
    whole = F.array_join(F.filter(F.transform(F.split(bare, r"\n{2,}"), lines), lambda x: x != ""), "\n\n")
    return F.when(whole != "", whole)


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def _own_media(media: Column) -> Column:
    """Media with an address that isn't an avatar's, each kind and address once."""
    some = F.filter(F.coalesce(media, F.array().cast(f"array<{MEDIA}>")), lambda m: (F.trim(m["url"]) != "") & ~m["url"].rlike(AVATARS))
    told = F.transform(some, lambda m: F.concat_ws(":", m["kind"], m["url"]))
    return let(told, lambda t: F.filter(some, lambda m, k: F.array_position(t, F.concat_ws(":", m["kind"], m["url"])) == k + 1))


def merged_posts(records: DataFrame, key: str = "key") -> DataFrame:
    """(key, post_key, post_id, author_handle, display_name, published_at, text, media): one row a post of each page.

    records: as RECORD, and root_id, the post that the page is about. A post is told by its id, or else by its text. Where
    the page's markup has posts, the payload's others count only if they are the root or have no id. Texts and media of
    equal length stay as the earlier source has them.
    """
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")).cast("long") * F.lit(1 << 32) + F.col("turn")
    text = post_text(F.col("text"))
    rows = records.select(key, "source", "root_id", order.alias("place"), "post_id", F.ltrim(_filled(F.col("author_handle")), F.lit("@")).alias("author_handle"), _filled(F.col("display_name")).alias("display_name"), "published_at", F.coalesce(text, F.lit("")).alias("text"), _own_media(F.col("media")).alias("media"))
    plain = comparable(F.col("text"))
    rows = rows.withColumn("post_key", F.coalesce("post_id", F.when(plain != "", plain), "text"))
    of_page, of_post = Window.partitionBy(key), Window.partitionBy(key, "post_key")
    marked = rows.withColumn("has_markup", F.max(F.col("source") == "markup").over(of_page)).withColumn("in_markup", F.max(F.col("source") == "markup").over(of_post))
    kept = marked.filter((F.col("source") != "payload") | ~F.col("has_markup") | F.col("in_markup") | F.col("post_id").isNull() | F.col("post_id").eqNullSafe(F.col("root_id")))
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    longest = lambda c, n: F.max_by(F.col(c), F.struct(n, (-F.col("place")).alias("p"))).alias(c)
    return kept.groupBy(key, "root_id", "post_key").agg(F.max("post_id").alias("post_id"), latest("author_handle"), latest("display_name"), latest("published_at"), longest("text", F.length("text")), longest("media", F.size("media")))


def ordered_posts(posts: DataFrame, key: str = "key") -> DataFrame:
    """posts with place, from 1: the root first, then by time, those without one last, then by id."""
    order = Window.partitionBy(key).orderBy(F.desc(F.col("post_id").eqNullSafe(F.col("root_id")) & F.col("root_id").isNotNull()), F.asc_nulls_last("published_at"), F.coalesce("post_id", F.lit("")), "post_key")
    return posts.withColumn("place", F.row_number().over(order))


def is_long(text: Column) -> Column:
    return (F.length(text) >= LONG_CHARS) | (F.size(split_paragraphs(text)) >= LONG_PARAGRAPHS)


def _title_like(text: Column) -> Column:
    return (F.length(text) <= TITLE_CHARS) & (F.size(F.split(text, r"\s+")) <= TITLE_WORDS)


def _sentence(text: Column) -> Column:
    """A text up to the end of its last sentence; empty if it has none."""
    return F.regexp_extract(text, r"(?s)^(.*[.?!][\"')\]]?)(?:\s|$)", 1)


def clamped(text: Column, n: int) -> Column:
    """At most n characters: up to a sentence's end beyond 55 % of them, or else to a word's end."""
    head = F.rtrim(F.substring(F.trim(text), 1, n))
    end = _sentence(head)
    word = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(F.trim(text)) <= n, F.trim(text)).when(F.length(end) >= n * 55 // 100, end).otherwise(F.when(word != "", word).otherwise(head))


def page_title(title: Column) -> Column:
    """What a network's page title quotes, or the title itself unless it is only the network's name."""
    quoted = F.regexp_extract(F.trim(title), r'(?is)^.*?\s+on\s+(?:X|Twitter):\s+"(.+)"$', 1)
    return F.when(F.trim(quoted) != "", F.trim(quoted)).when(~F.trim(title).rlike(r"(?i)^x$"), _filled(title))


def threads(records: DataFrame, pages: DataFrame, key: str = "key") -> DataFrame:
    """(key, kind, title, excerpt, author, published_at, cover, posts, blocks): what each page's posts make.

    pages: key, root_id, title, description, cover, published_at, and of a syndicated article, if there is one,
    article_title, article_preview, article_cover, and whether the post is a note (is_note). More than one post is a
    thread; an article's own record makes an article; a note that no other source has at length is a post; a long post is
    an article; else it is a post. A page without posts or article has no row.
    """
    joined = records.join(pages.select(key, "root_id"), key)
    posts = ordered_posts(merged_posts(joined, key), key)
    structured = joined.filter(F.col("source").isin("markup", "payload")).groupBy(key).agg(F.max(is_long(F.coalesce(post_text(F.col("text")), F.lit("")))).alias("structured"))
    row = F.struct("place", "post_id", "author_handle", "display_name", "published_at", "text", "media")
    listed = posts.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("posts"))
    all_ = pages.join(listed, key, "left").join(structured, key, "left").withColumn("posts", F.coalesce("posts", F.array().cast(listed.schema["posts"].dataType)))
    article = F.col("article_title").isNotNull() | F.col("article_preview").isNotNull() | F.col("article_cover").isNotNull()
    all_ = all_.filter((F.size("posts") > 0) | article).withColumn("first", F.get("posts", F.lit(0))).withColumn("paragraphs", F.coalesce(split_paragraphs(F.col("first.text")), F.array().cast("array<string>")))
    long_ = F.coalesce("structured", F.lit(False))
    kind = F.when(F.size("posts") > 1, "thread").when(article, "article").when(F.coalesce("is_note", F.lit(False)) & ~long_, "post").when(long_ | F.coalesce(is_long(F.col("first.text")), F.lit(False)), "article").otherwise("post")
    all_ = all_.withColumn("kind", kind)
    one = F.get("paragraphs", F.lit(0))
    several = F.size("paragraphs") > 1
    ends = _sentence(one)
    sentence = F.when(F.length(ends).between(1, SENTENCE_CHARS), ends).otherwise(clamped(one, SHORT_CHARS))
    title = F.coalesce(_filled(F.col("article_title")), page_title(F.col("title")), F.when(several & _title_like(one), one), F.when((F.col("kind") == "article") & (sentence != ""), sentence), _filled(clamped(F.col("first.text"), SHORT_CHARS)))
    source = F.when(several & _title_like(one), F.get("paragraphs", F.lit(1))).when(several, one).otherwise(F.col("first.text"))
    excerpt = F.coalesce(*(_filled(clamped(t, EXCERPT_CHARS)) for t in (F.col("article_preview"), source, F.col("description"))))
    images = F.filter(F.flatten(F.transform("posts", lambda p: p["media"])), lambda m: m["kind"] == "image")
    preview = split_paragraphs(post_text(F.col("article_preview")))
    body = F.when(F.size(preview) > 0, preview).otherwise(F.col("paragraphs"))
    told = F.transform("posts", lambda p: block(type=F.lit("thread_post"), post_id=p["post_id"], author_handle=p["author_handle"], display_name=p["display_name"], published_at=p["published_at"].cast("string"), text=p["text"], media=p["media"]))
    return all_.select(
        key,
        "kind",
        title.alias("title"),
        excerpt.alias("excerpt"),
        F.coalesce(F.col("first.display_name"), F.concat(F.lit("@"), F.col("first.author_handle"))).alias("author"),
        F.coalesce(F.col("first.published_at"), F.col("published_at")).alias("published_at"),
        F.coalesce(_filled(F.col("article_cover")), F.get(images, F.lit(0))["url"], _filled(F.col("cover"))).alias("cover"),
        F.size("posts").alias("posts"),
        F.when(F.col("kind") == "article", F.transform(body, lambda p: block(type=F.lit("paragraph"), text=p))).otherwise(told).alias("blocks"),
    )


def _objects(value, depth: int = 0) -> Iterator[dict]:
    if depth <= DEEPEST and isinstance(value, dict | list):
        if isinstance(value, dict):
            yield value
        for child in value.values() if isinstance(value, dict) else value:
            yield from _objects(child, depth + 1)


def _at(value, *path: str):
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _first(*values) -> str | None:
    return next((v for v in values if isinstance(v, str)), None)


def _media(o: dict) -> list[dict]:
    found = [*(_at(o, "legacy", "extended_entities", "media") or []), *(_at(o, "legacy", "entities", "media") or []), *(_at(o, "note_tweet", "note_tweet_results", "result", "entity_set", "media") or [])]
    out = []
    for m in (m for m in found if isinstance(m, dict)):
        video = next((v["url"] for v in _at(m, "video_info", "variants") or [] if isinstance(v, dict) and v.get("url")), None)
        url = video or _first(m.get("media_url_https"), m.get("media_url"), m.get("url"))
        if url:
            out.append({"kind": "video" if video else "image", "url": url, "alt": _first(m.get("ext_alt_text"), m.get("alt_text"), m.get("description"))})
    return out


def _payload_post(o: dict) -> dict | None:
    """A post as a page's data holds it: an id, a text, who, when and media, wherever the data keeps them."""
    legacy = o.get("legacy") if isinstance(o.get("legacy"), dict) else {}
    note = _at(o, "note_tweet", "note_tweet_results", "result") or _at(o, "noteTweet", "noteTweetResults", "result") or {}
    text = _first(_at(note, "text"), _at(note, "richText")) or _first(legacy.get("full_text"), legacy.get("fullText"), o.get("full_text"), o.get("fullText"))
    if not text or not text.strip():
        return None
    users = [_at(o, "core", "user_results", "result"), _at(o, "user_results", "result"), o.get("user"), o.get("author")]
    known = [u.get("legacy") if isinstance(u.get("legacy"), dict) else u for u in users if isinstance(u, dict)]
    user = next((u for u in known if _first(u.get("screen_name"), u.get("name"))), {})
    return {
        "post_id": _first(o.get("rest_id"), o.get("id_str"), legacy.get("id_str")),
        "author_handle": _first(user.get("screen_name"), user.get("screenName"), o.get("screen_name")),
        "display_name": _first(user.get("name"), o.get("name")),
        "created": _first(legacy.get("created_at"), legacy.get("createdAt"), o.get("created_at"), o.get("createdAt")),
        "text": text,
        "media": _media(o),
    }


_POSTS = f"array<struct<post_id:string,author_handle:string,display_name:string,created:string,text:string,media:array<{MEDIA}>>>"
_ARROW_POSTS = pa.list_(pa.struct([*((n, pa.string()) for n in ("post_id", "author_handle", "display_name", "created", "text")), ("media", pa.list_(pa.struct([("kind", pa.string()), ("url", pa.string()), ("alt", pa.string())])))]))


def _time(text: Column) -> Column:
    """The network's form of a time, or any that feeds use."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy")), feed_date(text))


def _payloads(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for a, b in bites(pc.utf8_length(texts).to_pylist()):
            out = []
            for text in texts.slice(a, b - a).to_pylist():
                try:
                    found = [_payload_post(o) for o in _objects(json.loads(text or ""))] if (text or "").lstrip()[:1] in ("{", "[") else []
                except (ValueError, RecursionError):
                    found = []
                out.append([p for p in found if p])
            yield pa.array(out, _ARROW_POSTS)


def payload_records(scripts: DataFrame, key: str = "key") -> DataFrame:
    """The posts in a page's data, as RECORD. scripts: key, url and script, a text of JSON; what is none has no posts."""
    ship(scripts.sparkSession)

    @F.arrow_udf(_POSTS)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _payloads(batches)

    rows = scripts.select(key, "url", F.posexplode(read(F.col("script"))).alias("turn", "p"))
    return rows.select(key, F.lit("payload").alias("source"), "turn", F.coalesce("p.post_id", status_id(F.col("url"))).alias("post_id"), F.coalesce("p.author_handle", status_handle(F.col("url"))).alias("author_handle"), "p.display_name", _time(F.col("p.created")).alias("published_at"), "p.text", "p.media").filter("post_id IS NOT NULL")


def oembed_records(embeds: DataFrame, key: str = "key") -> DataFrame:
    """The post in an oEmbed answer, as RECORD. embeds: key, url and embed, its JSON; its html is read as a tree."""
    get = lambda name: F.get_json_object("embed", f"$.{name}")
    rows = embeds.select(key, "url", get("html").alias("html"), get("author_name").alias("display_name"), get("author_url").alias("author_url"))
    nodes = tree.tree_rows(rows.filter("html IS NOT NULL"), key)
    tag = F.col("tag")
    quote = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    inner = nodes.withColumn("quote", F.min(F.when(tag == "blockquote", F.struct("pre", "last"))).over(quote)).filter((F.col("pre") >= F.col("quote.pre")) & (F.col("pre") <= F.col("quote.last")))
    href = F.col("attrs")["href"]
    said = inner.groupBy(key).agg(
        F.min_by(F.when(tag == "p", F.col("text")), F.when(tag == "p", F.col("pre"))).alias("p"),
        F.min_by(F.when(tag == "blockquote", F.col("text")), F.when(tag == "blockquote", F.col("pre"))).alias("q"),
        F.max_by(F.when(tag == "a", F.col("text")), F.when(tag == "a", F.col("pre"))).alias("day"),
        F.min_by(F.when(status_id(href).isNotNull(), href), F.when(status_id(href).isNotNull(), F.col("pre"))).alias("address"),
    )
    at = F.coalesce("address", "url")
    profile = F.regexp_extract(F.coalesce("author_url", F.lit("")), r"(?i)^https?://(?:www\.)?(?:x|twitter)\.com/([^/?#]+)/?$", 1)
    text = F.coalesce(_filled(F.col("p")), _filled(F.col("q")))
    out = rows.join(said, key).select(key, F.lit("oembed").alias("source"), F.lit(0).alias("turn"), status_id(at).alias("post_id"), F.coalesce(F.when(profile != "", profile), status_handle(at)).alias("author_handle"), "display_name", feed_date(F.col("day")).alias("published_at"), text.alias("text"), F.array().cast(f"array<{MEDIA}>").alias("media"))
    return out.filter("text IS NOT NULL").filter(~post_text(F.col("text")).rlike(BARE_ADDRESS))


def syndication_records(answers: DataFrame, key: str = "key") -> DataFrame:
    """The post in a syndication answer, as RECORD. answers: key, url and answer, its JSON; a text that is only an address is none."""
    v = F.try_parse_json("answer")
    get = lambda *paths: F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))
    none = F.array().cast("array<variant>")
    of = lambda m, *names: F.coalesce(*(F.try_variant_get(m, f"$.{n}", "string") for n in names))
    video = lambda m: F.coalesce(of(m, "video_info.variants[0].url"), of(m, "videoInfo.variants[0].url"))
    item = lambda m: F.struct(F.when(video(m).isNotNull(), "video").otherwise("image").alias("kind"), F.coalesce(video(m), of(m, "media_url_https", "media_url", "url")).alias("url"), of(m, "ext_alt_text", "alt_text").alias("alt"))
    found = F.transform(F.concat(*(F.coalesce(F.try_variant_get(v, f"$.{n}", "array<variant>"), none) for n in ("mediaDetails", "photos"))), item)
    media = F.filter(found, lambda m: m["url"].isNotNull()).cast(f"array<{MEDIA}>")
    rows = answers.select(key, F.lit("syndication").alias("source"), F.lit(0).alias("turn"), F.coalesce(get("$.id_str", "$.id"), status_id(F.col("url"))).alias("post_id"), F.coalesce(get("$.user.screen_name", "$.user.screenName"), status_handle(F.col("url"))).alias("author_handle"), get("$.user.name").alias("display_name"), _time(get("$.created_at", "$.createdAt")).alias("published_at"), get("$.full_text", "$.text").alias("text"), media.alias("media"))
    return rows.filter(post_text(F.col("text")).isNotNull() & ~post_text(F.col("text")).rlike(BARE_ADDRESS))


def syndicated_facts(answers: DataFrame, key: str = "key") -> DataFrame:
    """(key, is_note, article_title, article_preview, article_cover) of syndication answers; nulls where there is no article."""
    v = F.try_parse_json("answer")
    get = lambda *paths: F.coalesce(*(_filled(F.try_variant_get(v, p, "string")) for p in paths))
    info = [f"$.article.{a}.{b}" for a in ("cover_media", "coverMedia") for b in ("media_info.original_img_url", "mediaInfo.originalImgUrl", "media_url_https", "media_url", "url")]
    return answers.select(key, get("$.note_tweet.id", "$.noteTweet.id").isNotNull().alias("is_note"), get("$.article.title").alias("article_title"), get("$.article.preview_text", "$.article.previewText").alias("article_preview"), get(*info).alias("article_cover"))
