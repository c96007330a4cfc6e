"""Live blogs: a page's elements cut into updates, or the updates of its data; key events first, the better source wins.

Elements of the blog's body are in document order, so a running count of the updates' starts numbers the update that each
stands in; its blocks, its heading and its title follow by grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import collapsed, comparable, is_date_line, is_time_label, let, utc_time_label
from tidemark.operators import tree
from tidemark.operators.blocks import block, sanitized, words_in

#: Updates and blocks of a summary that are shown, least text of an update, base scores, headings.
MOST_UPDATES, MOST_SUMMARY, LEAST_UPDATE = 6, 6, 80
BASES = {"dom-liveblog-root": 48, "jsonld-liveblog-updates": 28}
KEY_EVENTS, LATEST = "Key events", "Latest updates"
#: Elements and classes that are no part of an update, texts that are controls, what a name looks like.
NOISE = ("header", "footer", "aside", "button", "form", "input", "label", "nav", "script", "style", "noscript", "gu-island", "iframe", "picture", "img", "video", "audio", "source", "svg", "figure")
NOISE_CLASSES = ("share", "share-tools", "element-share")
CONTROLS = r"(?i)^(share$|copy link$|(follow|get alerts|sign up|subscribe)\b|related\b|recommended\b|read more\b)"
NAME = r"^[A-Z][A-Za-z.'-]+(\s+[A-Z][A-Za-z.'-]+){0,4}$"

_UPDATES = "struct<title:string,authors:array<string>,published:string,site:string,image:string,updates:array<struct<title:string,authors:array<string>,published:string,body:string>>>"


def _classes() -> Column:
    return F.split(F.lower(F.coalesce(F.col("attrs")["class"], F.lit(""))), r"\s+")


def _has(name: str) -> Column:
    return F.array_contains(_classes(), name)


def _attr(name: str, value: str) -> Column:
    return F.coalesce(F.col("attrs")[name] == value, F.lit(False))


def _text(b: Column) -> Column:
    return collapsed(F.coalesce(F.when(b["type"] == "list", F.array_join(b["items"], " ")).when(b["type"] == "image", F.coalesce(b["caption"], b["alt"])).otherwise(b["text"]), F.lit("")))


def cleaned(blocks: Column) -> Column:
    """Bounded blocks without images and controls."""
    return F.filter(sanitized(blocks), lambda b: (b["type"] != "image") & ((_text(b) == "") | ~_text(b).rlike(CONTROLS)))


def person(text: Column) -> Column:
    """A text that is a person's name: one to five capitalised words, no date, time or control."""
    name = collapsed(text)
    return F.when(name.rlike(NAME) & ~is_time_label(name) & ~is_date_line(name) & ~name.rlike(r"(?i)^(share|copy link)$"), name)


def label(time: Column, author: Column, title: Column) -> Column:
    """An update's heading: when and by whom, or else its title."""
    said = F.concat_ws(" | ", time, author)
    return F.when(said != "", said).otherwise(title)


def page_updates(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, heading, title, author, blocks) of the first updates of each page's live blog.

    The body is the first element that says it is one; updates are its elements of the first kind of which one has
    LEAST_UPDATE characters and a text element. A page without a body or updates has no rows.
    """
    tag = F.col("tag")
    is_root = _attr("id", "liveblog-body") | _has("liveblog-body") | _attr("data-component", "liveblog-body") | _attr("data-testid", "liveblog-body")
    rank = F.when(_attr("id", "liveblog-body"), 0).when(_has("liveblog-body"), 1).when(_attr("data-component", "liveblog-body"), 2).otherwise(3)
    best = F.min(F.struct(rank.alias("rank"), F.col("pre").alias("root"), F.col("last").alias("root_last")))
    roots = nodes.filter(is_root).groupBy(key).agg(best.alias("r")).select(key, "r.root", "r.root_last")
    within = tree.inside(nodes, roots, key).drop("root", "root_last")
    told = tree.subtree_sums(within.select(key, "pre", "last", "tag"), key, told=tag.isin("p", "blockquote", "ul", "ol", "pre")).select(key, "pre", "told")
    order = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.max(F.when(_attr("data-testid", "liveblog-entry"), F.col("last"))).over(order) >= F.col("pre")
    within = within.withColumn("entry", F.coalesce(entry, F.lit(False))).join(told, [key, "pre"])
    article = tag == "article"
    kind = F.when(article & _has("block"), 0).when(article & F.map_contains_key("attrs", F.lit("data-block-id")), 1).when(article & F.col("entry"), 2).when(_attr("data-testid", "liveblog-entry"), 3).when(article, 4)
    full = (F.col("length") >= LEAST_UPDATE) & (F.col("told") > 0)
    within = within.withColumn("kind", F.when(full, kind)).withColumn("best", F.min("kind").over(Window.partitionBy(key)))
    # Articles of another kind count as their own kind only where no better kind is there.
    begins = F.col("kind").isNotNull() & ((F.col("kind") == F.col("best")) | ((F.col("best") == 4) & article))
    numbered = within.withColumn("begins", begins).withColumn("update", F.sum(F.col("begins").cast("int")).over(order)).withColumn("edge", F.max(F.when(F.col("begins"), F.struct("pre", "last"))).over(order))
    mine = numbered.filter((F.col("update") > 0) & (F.col("update") <= MOST_UPDATES) & (F.col("pre") <= F.col("edge.last")) & ~F.col("begins"))
    by = [key, "update"]
    inner = Window.partitionBy(*by).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    header = F.min(F.when(tag == "header", F.struct("pre", "last"))).over(inner)
    in_header = F.coalesce((F.col("pre") >= F.col("header.pre")) & (F.col("pre") <= F.col("header.last")), F.lit(False))
    seen = mine.withColumn("header", header).withColumn("in_header", in_header)
    text, attrs = F.col("text"), F.col("attrs")
    small = F.col("in_header") & tag.isin("time", "span", "a", "div", "p", "header") & (text != "")
    shortest = lambda test: F.min_by(F.when(test, text), F.when(test, F.struct(F.length(text), F.col("pre"))))
    name = person(F.when(tag == "img", attrs["alt"]).otherwise(text))
    worth = F.when(~F.col("in_header") | name.isNull(), None).when(_attr("rel", "author"), 0).when(_attr("itemprop", "author"), 1).when(_attr("data-testid", "byline"), 2).when(_has("byline"), 3).when((tag == "a") & F.coalesce(attrs["href"].contains("/profile/"), F.lit(False)), 4).when(tag == "img", 5).when(small, 6)
    short = is_time_label(text) & (F.length(text) <= 10)
    facts = seen.groupBy(*by).agg(
        F.min_by(F.when(tag.isin("h2", "h3"), text), F.when(tag.isin("h2", "h3"), F.col("pre"))).alias("title"),
        F.coalesce(shortest(small & short), shortest(small & is_time_label(text))).alias("time"),
        F.min_by(F.when((tag == "time") & F.col("in_header"), attrs["datetime"]), F.when((tag == "time") & F.col("in_header"), F.col("pre"))).alias("stamp"),
        F.min_by(name, F.when(worth.isNotNull(), F.struct(worth, F.col("pre")))).alias("author"),
    )
    noise = tag.isin(*NOISE) | F.arrays_overlap(_classes(), F.array(*map(F.lit, NOISE_CLASSES))) | _attr("data-component", "share")
    blocks = tree.blocks_of(tree.uncovered(mine, by, noise), by).withColumn("blocks", cleaned(F.col("blocks"))).filter(F.size("blocks") > 0)
    rows = blocks.join(facts, by)
    title = F.when((F.col("title") != "") & ~F.col("title").rlike(CONTROLS), F.col("title"))
    time = F.coalesce("time", utc_time_label(F.col("stamp").try_cast("timestamp")))
    return rows.select(key, F.col("update").alias("place"), label(time, F.col("author"), title).alias("heading"), title.alias("title"), "author", "blocks")


def data_updates(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, heading, title, author, blocks) of the first updates in each page's data. pages: key, page and title.

    Bodies with markup are read as trees, plain ones are cut at empty lines; a title that only repeats the page's is none.
    """
    said = F.from_json(F.col("page.meta")["ld:live"], _UPDATES)
    rows = pages.select(key, F.col("title").alias("page_title"), F.posexplode(F.slice(said["updates"], 1, MOST_UPDATES)).alias("at", "u")).filter("trim(u.body) != ''")
    body = F.col("u.body")
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    plain = F.array_join(F.transform(F.filter(F.split(body, r"\n{2,}"), lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>"))), "")
    rows = rows.withColumn("row", F.concat_ws(":", F.col(key).cast("string"), F.col("at").cast("string"))).withColumn("html", F.when(body.rlike(r"(?is)<[a-z].*>"), body).otherwise(plain))
    blocks = tree.blocks_of(tree.tree_rows(rows, "row"), ["row"]).withColumn("blocks", cleaned(F.col("blocks"))).filter(F.size("blocks") > 0)
    author = F.when(F.size("u.authors") > 1, F.concat(F.get("u.authors", F.lit(0)), F.lit(" and others"))).otherwise(F.get("u.authors", F.lit(0)))
    title = F.when((F.col("u.title") != "") & ~F.coalesce(comparable(F.col("u.title")) == comparable(F.col("page_title")), F.lit(False)), F.col("u.title"))
    time = utc_time_label(F.col("u.published").try_cast("timestamp"))
    return rows.join(blocks, "row").select(key, (F.col("at") + 1).alias("place"), label(time, author, title).alias("heading"), title.alias("title"), author.alias("author"), "blocks")


def key_events(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, blocks) of the summary that a live blog's carousel carries: the event marked so, or the first key event."""
    island = (F.col("tag") == "gu-island") & _attr("name", "KeyEventsCarousel")
    first = nodes.filter(island).groupBy(key).agg(F.min_by(F.col("attrs")["props"], "pre").alias("props"))
    events = F.from_json("props", "struct<keyEvents:array<struct<title:string,attributes:struct<summary:boolean,keyEvent:boolean>,elements:array<struct<html:string>>>>>")["keyEvents"]
    of = lambda name: F.get(F.filter("events", lambda e: F.coalesce(e["attributes"][name], F.lit(False))), F.lit(0))
    chosen = first.select(key, events.alias("events")).select(key, F.coalesce(of("summary"), of("keyEvent")).alias("event")).filter("event IS NOT NULL")
    pages = chosen.select(key, F.col("event.title").alias("title"), F.array_join(F.transform("event.elements", lambda e: e["html"]), "").alias("html"))
    blocks = tree.blocks_of(tree.tree_rows(pages, key), [key]).withColumn("blocks", cleaned(F.col("blocks"))).filter(F.size("blocks") > 0)
    return pages.select(key, F.when(collapsed(F.col("title")) != "", collapsed(F.col("title"))).alias("title")).join(blocks, key)


def score(blocks: Column, base: Column, updates: Column, summary: Column, authored: Column, titled: Column) -> Column:
    least = lambda x, k: F.least(x, F.lit(k))
    of = lambda words: base + F.least(F.lit(120.0), words / 14) + 8 * least(updates, MOST_UPDATES) + 4 * least(summary, MOST_SUMMARY) + F.when(summary > 0, 12).otherwise(0) + 3 * authored + 2 * titled - F.when((updates < 2) & (words < 180), 18).otherwise(0) - F.when(words < 120, 22).otherwise(0)
    return let(words_in(blocks), of)


def _heading(level: int, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", block(type=F.lit("heading"), level=F.lit(level), text=text))


def read_live_blogs(pages: DataFrame, nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, source, score, updates, blocks): each page's live blog from its elements or its data, whichever is better.

    pages: key, page (as read_html reads it) and title. Key events stand first under a heading of their own, then the
    updates, each under its heading and title. A page without either source has no row.
    """
    one = page_updates(nodes, key).withColumn("source", F.lit("dom-liveblog-root"))
    two = data_updates(pages, key).withColumn("source", F.lit("jsonld-liveblog-updates"))
    by = [key, "source"]
    own = F.concat(F.filter(F.array(_heading(3, F.col("heading")), _heading(4, F.col("title"))), lambda b: b.isNotNull()), F.col("blocks"))
    rows = one.unionByName(two).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("place", own.alias("blocks")))).alias("all"),
        F.count("*").cast("int").alias("updates"),
        F.count("author").cast("int").alias("authored"),
        F.count("title").cast("int").alias("titled"),
    )
    summary = key_events(nodes, key).select(key, F.col("title").alias("event"), F.col("blocks").alias("told"))
    every = rows.join(summary, key, "left").withColumn("told", F.coalesce(F.col("told"), F.array().cast(summary.schema["told"].dataType)))
    lead = F.concat(F.filter(F.array(_heading(2, F.lit(KEY_EVENTS)), _heading(3, F.col("event"))), lambda b: b.isNotNull()), F.slice("told", 1, MOST_SUMMARY))
    shown = F.concat(F.when(F.size("told") > 0, lead).otherwise(F.slice("told", 1, MOST_SUMMARY)), F.array(_heading(2, F.lit(LATEST))), F.flatten(F.transform("all", lambda u: u["blocks"])))
    full = every.withColumn("blocks", cleaned(shown))
    base = F.element_at(F.create_map(*(F.lit(x) for pair in BASES.items() for x in pair)), F.col("source"))
    scored = full.withColumn("base", base).withColumn("score", score(F.col("blocks"), F.col("base"), F.col("updates"), F.size("told"), F.col("authored"), F.col("titled")))
    return scored.groupBy(key).agg(F.max_by(F.struct("source", "score", "updates", "blocks"), F.struct("score", "base")).alias("c")).select(key, "c.*")
