"""Small text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_MINUTE = 220
#: What divides a title from the name of its site, and short weekdays.
TITLE_BREAKS = (" - ", " | ", " – ", " — ")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def read_seconds(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / WORDS_PER_MINUTE * 60)).cast("int")


def tag_slug(label: Column) -> Column:
    """Letters and digits in lower case, one dash for each run of spaces, dashes and underscores; null if none or over 63."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9 _-]", ""), r"[ _-]+", "-"), r"^-|-$", "")
    return F.when(F.length(slug).between(1, 63), slug)


def humanized(slug: Column) -> Column:
    """Words of a slug, each with a capital first letter."""
    return F.array_join(F.transform(F.filter(F.split(slug, "-"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def language_codes(codes: Column) -> Column:
    """Trimmed lower-case codes of a-z, 0-9 and dash, at most 16 long, each once, the first eight."""
    clean = F.filter(F.transform(codes, lambda c: F.lower(F.trim(c))), lambda c: c.rlike(r"^[a-z0-9-]{1,16}$"))
    return F.slice(F.array_distinct(clean), 1, 8)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def cut_at(text: Column, n: int) -> Column:
    return F.substring(F.trim(text), 1, n)


def summary(text: Column, n: int = 280) -> Column:
    """At most n characters: up to a sentence's end, closing quote or bracket included, beyond 55 % of them, else up to a
    word's end beyond 65 %, else cut."""
    whole = collapsed(text)
    head = F.rtrim(F.substring(whole, 1, n))
    sentence = F.regexp_extract(head, r"^(.*[.?!][\"')\]]?)(?:\s|$)", 1)
    word = F.regexp_extract(head, r"^(.*)\s", 1)
    return F.when(F.length(whole) <= n, whole).when(F.length(sentence) >= n * 55 // 100, sentence).when(F.length(word) >= n * 65 // 100, word).otherwise(head)


@cache
def _folds() -> tuple[str, str]:
    """Characters that compatibility decomposition, without its marks, turns into one of a-z and 0-9, and what into."""
    pairs = []
    for k in range(0x80, 0x10000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c)).lower()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            pairs.append((chr(k), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def comparable(text: Column) -> Column:
    """a-z and 0-9 only, once letters are decomposed and in lower case; empty where none is left."""
    return F.regexp_replace(F.lower(F.translate(text, *_folds())), r"[^a-z0-9]+", "")


def topic_slugs(labels: Column, most: int = 16) -> Column:
    """The slugs of a list of topics, each once, in order; null if the list is too long or one of them is no slug."""
    slugs = F.transform(labels, tag_slug)
    return F.when((F.size(labels) <= most) & ~F.exists(slugs, lambda s: s.isNull()), F.array_distinct(slugs))


def username(text: Column) -> Column:
    """A user's name if it is one: 3 to 32 of a-z, 0-9 and underscore."""
    return F.when(text.rlike(r"^[a-z0-9_]{3,32}$"), text)


def language_of_locale(locale: Column) -> Column:
    """The language of a locale such as en_GB."""
    found = F.lower(F.regexp_extract(F.coalesce(F.trim(locale), F.lit("")), r"^([A-Za-z]{2,3})(?:[-_.@]|$)", 1))
    return F.when(found != "", found)


def without_markup(text: Column) -> Column:
    return collapsed(F.regexp_replace(text, r"<[^>]*>", " "))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(v) != "", F.trim(v)) for v in values))


def mime_type(header: Column) -> Column:
    kind = F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))
    return F.when(kind != "", kind)


def effective_time(published: Column, created: Column) -> Column:
    """When a content counts as published."""
    return F.coalesce(published, created)


def feed_date(text: Column) -> Column:
    """A date of a feed: ISO, or the mail form with its weekday stripped."""
    mail = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", "")
    return F.coalesce(F.try_to_timestamp(F.trim(text)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(F.trim(text), F.lit("MMMM d, yyyy")))


def cursor(at: Column, key: Column) -> Column:
    """An opaque place in a list: base64 for addresses of its JSON."""
    return F.translate(F.rtrim(F.base64(F.to_json(F.struct(F.unix_micros(at.cast("timestamp")).alias("at"), key.alias("id"))).cast("binary")), F.lit("=")), "+/", "-_")


def cursor_parts(text: Column) -> Column:
    padded = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.unbase64(padded).cast("string"), "at long, id long")


def tokens(text: Column) -> Column:
    """Comparable words of four letters or digits and more."""
    return F.filter(F.split(F.lower(F.translate(text, *_folds())), r"[^a-z0-9]+"), lambda w: F.length(w) >= 4)


def token_overlap(address: Column, words: Column) -> Column:
    """How many of the distinct words an address holds."""
    return let(comparable(address), lambda a: F.size(F.filter(F.array_distinct(words), lambda w: a.contains(w))))


def site_of_title(title: Column) -> Column:
    """What stands behind the last break of a title that has one, if it is at most 64 long: the site's name."""
    for mark in TITLE_BREAKS:
        title = F.replace(title, F.lit(mark), F.lit("\n"))
    parts = F.filter(F.transform(F.split(title, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    name = F.element_at(parts, -1)
    return F.when(F.size(parts) > 1, F.when(F.length(name) <= 64, name))


def author_name(text: Column, most: int = 256) -> Column:
    """Who a by-line names: what stands before a bar, without a first word "by"; null for addresses and long texts."""
    words = F.split(F.trim(F.split_part(collapsed(text), F.lit("|"), F.lit(1))), " ")
    named = F.when(F.lower(words[0]) == "by", F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    name = F.array_join(named, " ")
    address = F.lower(name).startswith("http://") | F.lower(name).startswith("https://")
    return F.when(F.length(name).between(1, most) & ~address, name)


def handle(text: Column) -> Column:
    """A by-line's name without the sign before a handle."""
    return F.ltrim(author_name(text), F.lit("@"))


def split_paragraphs(text: Column) -> Column:
    """The paragraphs of a plain text: runs of lines between empty ones, or each line where no empty one divides them."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), collapsed)
    told = F.filter(lines, lambda x: x != "")
    marked = F.array_join(F.transform(lines, lambda x: F.when(x == "", "\n").otherwise(x)), " ")
    runs = F.filter(F.transform(F.split(marked, "\n"), collapsed), lambda x: x != "")
    return F.when(F.size(runs) > 1, runs).otherwise(told)


def is_time_label(text: Column) -> Column:
    """Is a text a time of day, perhaps with a date before it and a zone behind it?"""
    clean = F.trim(text)
    forms = [f"{day}{clock}{zone}" for day in ("", "d MMM yyyy ") for clock in ("H:mm", "H.mm") for zone in ("", " z")]
    return F.coalesce(*(F.try_to_timestamp(clean, F.lit(f)) for f in forms)).isNotNull()


def is_date_line(text: Column) -> Column:
    """Does a text begin with a short weekday, or is it a day, month and year?"""
    first = F.split(F.lower(F.trim(text)), "[^a-z0-9]+")[0]
    return F.coalesce(first.isin(*WEEKDAYS), F.lit(False)) | F.try_to_timestamp(F.trim(text), F.lit("d MMM yyyy")).isNotNull()


def utc_time_label(at: Column) -> Column:
    return F.concat(F.date_format(at, "HH:mm"), F.lit(" UTC"))


def json_kind(text: Column) -> Column:
    """What a JSON text is: object, array, string, number, boolean or null; null where it is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
