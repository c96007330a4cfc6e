"""Documents as arrays of blocks: bounds, measures, compact form, readable paragraphs. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import collapsed, read_seconds, word_count
from tidemark.schemas import BLOCK

#: Most blocks, characters of a text and of code, items and their characters, media.
MOST_BLOCKS, MOST_TEXT, MOST_CODE, MOST_ITEMS, MOST_ITEM, MOST_MEDIA = 128, 4_000, 16_000, 50, 500, 8
NAMES = ("type", "level", "text", "style", "items", "language", "url", "alt", "caption", "post_id", "author_handle", "display_name", "published_at", "media")


def block(**fields: Column) -> Column:
    """A block with the given fields."""
    return F.struct(*(fields.get(n, F.lit(None)).alias(n) for n in NAMES)).cast(BLOCK)


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def sanitized(blocks: Column, whole: bool = False) -> Column:
    """Bounded blocks, empty ones dropped; whole: without bounds."""
    first = lambda text, most: text if whole else F.substring(text, 1, most)
    most = lambda rows, n: rows if whole else F.slice(rows, 1, n)

    def clean(b: Column) -> Column:
        text = F.when(b["type"] == "code", first(b["text"], MOST_CODE)).otherwise(first(collapsed(b["text"]), MOST_TEXT))
        items = most(F.filter(F.transform(F.coalesce(b["items"], _none("array<string>")), lambda x: first(collapsed(x), MOST_ITEM)), lambda x: x != ""), MOST_ITEMS)
        level = F.least(F.greatest(b["level"], F.lit(1)), F.lit(6))
        kept = {n: b[n] for n in NAMES} | {"text": text, "items": items, "level": level, "media": most(F.coalesce(b["media"], _none("array<struct<kind:string,url:string,alt:string>>")), MOST_MEDIA)}
        return block(**kept)

    def full(b: Column) -> Column:
        return F.when(b["type"] == "list", F.size(b["items"]) > 0).when(b["type"] == "image", F.coalesce(b["url"], F.lit("")) != "").when(b["type"] == "thread_post", (F.coalesce(b["text"], F.lit("")) != "") | (F.size(b["media"]) > 0)).otherwise(F.trim(F.coalesce(b["text"], F.lit(""))) != "")

    return F.filter(most(F.transform(blocks, clean), MOST_BLOCKS), full)


def words_in(blocks: Column) -> Column:
    """Words of texts, captions, alternative texts and items."""

    def of(b: Column) -> Column:
        items = F.aggregate(F.coalesce(b["items"], _none("array<string>")), F.lit(0), lambda n, x: n + word_count(x))
        media = F.aggregate(F.coalesce(b["media"], _none("array<struct<kind:string,url:string,alt:string>>")), F.lit(0), lambda n, m: n + word_count(m["alt"]))
        return word_count(b["text"]) + word_count(b["caption"]) + word_count(b["alt"]) + items + media

    return F.aggregate(blocks, F.lit(0), lambda n, b: n + of(b))


def count_of(blocks: Column, *types: str) -> Column:
    return F.size(F.filter(blocks, lambda b: b["type"].isin(*types)))


def metrics(blocks: Column) -> Column:
    images = F.aggregate(blocks, F.lit(0), lambda n, b: n + F.when(b["type"] == "image", 1).otherwise(F.size(F.coalesce(b["media"], _none("array<struct<kind:string,url:string,alt:string>>")))))
    words = words_in(blocks)
    return F.struct(words.alias("words"), read_seconds(words).alias("read_seconds"), F.size(blocks).alias("blocks"), images.alias("images"))


def post_heading(b: Column) -> Column:
    """Name and handle of a post's author; the handle alone where they are the same."""
    handle = F.when(F.coalesce(b["author_handle"], F.lit("")) != "", F.concat(F.lit("@"), F.regexp_replace(b["author_handle"], "^@", "")))
    name = F.when(F.trim(F.coalesce(b["display_name"], F.lit(""))) != "", F.trim(b["display_name"]))
    same = F.lower(name) == F.lower(F.regexp_replace(handle, "^@", ""))
    return F.when(name.isNull() | F.coalesce(same, F.lit(False)), handle).when(handle.isNull(), name).otherwise(F.concat_ws(" ", name, handle))


def compact(blocks: Column) -> Column:
    """One-letter blocks h, p, q, l, c: images go, a post becomes a heading and a paragraph."""

    def one(t: str, **f: Column) -> Column:
        kinds = {"l": "int", "x": "string", "o": "boolean", "i": "array<string>", "lang": "string"}
        return F.struct(F.lit(t).alias("t"), *(f.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))

    def of(b: Column) -> Column:
        head = post_heading(b)
        post = F.filter(F.array(F.when(head.isNotNull(), one("h", l=F.lit(3), x=head)), F.when(F.coalesce(b["text"], F.lit("")) != "", one("p", x=b["text"]))), lambda x: x.isNotNull())
        none = F.filter(post, lambda x: F.lit(False))
        return (
            F.when(b["type"] == "heading", F.array(one("h", l=b["level"], x=b["text"])))
            .when(b["type"] == "paragraph", F.array(one("p", x=b["text"])))
            .when(b["type"] == "quote", F.array(one("q", x=b["text"])))
            .when(b["type"] == "list", F.array(one("l", o=b["style"] == "ordered", i=b["items"])))
            .when(b["type"] == "code", F.array(one("c", x=b["text"], lang=b["language"])))
            .when(b["type"] == "thread_post", post)
            .otherwise(none)
        )

    return F.flatten(F.transform(blocks, of))


def paragraphs(compacted: Column) -> Column:
    """Lines to read: texts as they are, items with a number or a dash."""

    def lines(b: Column) -> Column:
        items = F.transform(F.coalesce(b["i"], _none("array<string>")), lambda x, k: F.when(b["o"], F.concat((k + 1).cast("string"), F.lit(". "), x)).otherwise(F.concat(F.lit("- "), x)))
        return F.when(b["t"] == "l", items).otherwise(F.array(b["x"]))

    return F.filter(F.transform(F.flatten(F.transform(compacted, lines)), collapsed), lambda x: F.coalesce(x, F.lit("")) != "")
