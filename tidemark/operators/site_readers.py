"""Readers of particular sites: newsletters, a front-loaded news site, archived copies. Blocks are rows here, so what a
reader knows of a text is worked out once a text, and what came before it is a running aggregate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import collapsed, comparable, let, site_of_title
from tidemark.functions.urls import bare_host, host, of_domain
from tidemark.operators import extract, tree
from tidemark.operators.blocks import block, sanitized, words_in
from tidemark.operators.quality import article_quality
from tidemark.runtime import cut

_MONTH = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b"

#: A newsletter's noise, texts that are controls, base scores of its two sources, least text of a body.
LETTER_NOISE_TAGS = ("button", "form", "aside", "nav", "footer", "script", "style", "noscript")
LETTER_NOISE_CLASSES = ("button-wrapper", "post-footer", "post-ufi", "post-header", "subscription-widget", "subscription-box", "subscribe-widget", "comments", "comment", "native-video-embed", "audio-player", "captioned-audio-container")
LETTER_CONTROLS = r"(?i)^(subscribe(?: now)?|share|sign in|restack|like|comments?|discussion|reply|download app)$"
LETTER_BASES = {"payload-body-html": 40, "dom-body-root": 32}
LEAST_LETTER, LEAST_CAPTION = 200, 40
#: The news site's bodies in order of preference, promotions, section labels, credits, base scores.
NEWS_BODIES = ("data-component=article-body", "data-module=ArticleBody", "data-testid=story-body", "class=story-body", "class=body-content", "class=body-copy-v2", "class=body-copy", "class=article-body__content")
NEWS_PROMOTIONS = (
    r"(?i)^gift this article\b",
    r"(?i)^follow all new stories by\b",
    r"(?i)^(following|get alerts|sign up|subscribe)\b",
    r"(?i)^more from bloomberg\b",
    r"(?i)^up next\b",
    r"(?i)^contact us:",
    r"(?i)^confidential tip\?",
    r"(?i)^site feedback:",
    r"(?i)\bnewsletter\b",
    r"(?i)\bprivacy policy\b",
    r"(?i)\bterms of service\b",
    r"(?i)^copy link\b",
)
NEWS_LABELS = r"(?i)^(weekend essay|analysis|opinion|feature)$"
NEWS_CREDITS = (r"(?i)^(photo|illustration|image|source):", r"(?i)\bfor bloomberg\b")
NEWS_BASES = {"dom": 44, "jsonld": 32}
LEAST_NEWS_BODY, SUBSTANTIVE, PARAGRAPH = 220, 90, 420
#: Headings of an archived page's other articles, texts that promote, least text of an article.
ARCHIVE_OTHERS = r"(?i)^(more from|up next)\b"
ARCHIVE_RELATED = r"(?i)^(more from|up next|related|recommended|you may also like|read more|relacionad[oa]s?|m[aá]s de|tambi[eé]n te puede gustar)\b"
ARCHIVE_PROMOTIONS = (
    r"(?i)^follow all new stories by\b",
    r"(?i)^(following|get alerts|sign up)\b",
    r"(?i)^up next\b",
    r"(?i)^more from\b",
    r"(?i)^related\b",
    r"(?i)^recommended\b",
    r"(?i)^you may also like\b",
    r"(?i)^read more\b",
    r"(?i)^share\b",
    r"(?i)^contact us:",
    r"(?i)^confidential tip\?",
    r"(?i)^site feedback:",
    r"(?i)^gift this article\b",
)
ARCHIVE_SIGNUP = r"(?i)\b(newsletter|sign up|subscribe|enter your email|privacy policy|terms of service)\b"
JUMP_TARGET, LEAST_ARCHIVED, SITE_BIAS = "that-jump-content--default", 500, 16


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def _classes() -> Column:
    return F.split(F.lower(F.coalesce(F.col("attrs")["class"], F.lit(""))), r"\s+")


def _has(*names: str) -> Column:
    return F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(_classes(), n))


def _text(b: Column) -> Column:
    """What a block says: its text, its items in a row, or an image's caption or else alternative text."""
    return collapsed(F.coalesce(F.when(b["type"] == "list", F.array_join(b["items"], " ")).when(b["type"] == "image", F.coalesce(b["caption"], b["alt"])).otherwise(b["text"]), F.lit("")))


def words_only(text: Column) -> Column:
    """Letters and digits of any script in lower case, all else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _rows(candidates: DataFrame, by: list[str], told, whole: bool = False, facts: Iterable[str] = ()) -> DataFrame:
    """A row for each block of each candidate, bounded or whole: at, b, said, told, and the candidate's title, excerpt, author, day.

    facts: columns of the candidate that its rows bring too, as one struct.
    """
    names = [F.coalesce(told(F.col(c)), F.lit("")).alias(f"_{c}") for c in ("title", "excerpt", "author")]
    day = F.col("published_at").try_cast("timestamp")
    rows = candidates.select(*by, *names, day.alias("_day"), F.struct(*facts, F.lit(1).alias("_")).alias("_facts"), F.posexplode(sanitized(F.col("blocks"), whole)).alias("at", "b"))
    return rows.withColumn("said", _text(F.col("b"))).withColumn("told", told(F.col("said")))


def _is(*names: str) -> Column:
    return (F.col("told") != "") & F.col("told").isin(*(F.col(f"_{n}") for n in names))


def _collected(rows: DataFrame, stays: Column, by: list[str], counts: list[str], facts: Iterable[str] = ()) -> DataFrame:
    """The rows that stay as blocks again, and the sums of what the rows say was removed; in one pass over them."""
    sums = [F.sum(F.col(c).cast("int")).cast("int").alias(c) for c in counts]
    found = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(stays, F.struct("at", "b")))).alias("rows"), F.first("_facts").alias("_facts"), *sums)
    return found.filter(F.size("rows") > 0).select(*by, F.transform("rows", lambda r: r["b"]).alias("blocks"), *counts, *(F.col(f"_facts.{c}").alias(c) for c in facts))


def _of_type(blocks: Column, *kinds: str) -> Column:
    return F.size(F.filter(blocks, lambda b: b["type"].isin(*kinds)))


def clean_letters(candidates: DataFrame, by: list[str], facts: Iterable[str] = ()) -> DataFrame:
    """(by, blocks, front, boilerplate, images, captions): newsletters without front matter, controls and images.

    candidates: by, title, excerpt, author, published_at, blocks. Title, excerpt, author and a line with the date go
    wherever they stand; an image leaves a caption of LEAST_CAPTION characters that says something else as a paragraph.
    facts: further columns of the candidates to be kept.
    """
    rows = _rows(candidates, by, words_only, facts=facts)
    image = F.col("b.type") == "image"
    dated = (F.length("said") <= 48) & F.col("said").rlike(_MONTH) & F.col("said").rlike(r"\b20\d{2}\b")
    day = lambda form: F.contains("told", words_only(F.date_format("_day", form)))
    front = _is("title", "excerpt", "author") | dated | (F.col("_day").isNotNull() & (day("MMMM d, yyyy") | day("MMM d, yyyy")))
    caption = image & (F.length(collapsed(F.col("b.caption"))) >= LEAST_CAPTION) & ~_is("title", "excerpt", "author")
    rows = rows.withColumn("images", image).withColumn("captions", F.coalesce(caption, F.lit(False))).withColumn("front", F.when(image, F.col("captions") & front).otherwise((F.col("said") != "") & front))
    rows = rows.withColumn("boilerplate", ~image & ~F.col("front") & F.col("said").rlike(LETTER_CONTROLS))
    stays = F.when(image, F.col("captions")).otherwise((F.col("said") != "") & ~F.col("front") & ~F.col("boilerplate"))
    # A caption that is front matter goes only before the text.
    order = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stays", stays).withColumn("begun", F.max(F.col("stays") & ~F.col("front")).over(order)).withColumn("stays", F.col("stays") & F.col("begun"))
    rows = rows.withColumn("front", F.col("front") & ~(image & F.col("begun")))
    paragraph = rows.withColumn("b", F.when(image, block(type=F.lit("paragraph"), text=F.col("said"))).otherwise(F.col("b")))
    return _collected(paragraph, F.col("stays"), by, ["front", "boilerplate", "images", "captions"], facts)


def letter_score(blocks: Column, base: Column, front: Column, boilerplate: Column, images: Column, captions: Column) -> Column:
    least = lambda x, k: F.least(x, F.lit(k))
    score = lambda words: base + F.least(F.lit(84.0), words / 35) + 1.5 * least(_of_type(blocks, "heading"), 10) + 1.5 * least(_of_type(blocks, "paragraph", "quote"), 40) + 2 * captions - 1.5 * boilerplate - 2 * front - 1.25 * images - F.when(words < 250, 40).otherwise(0)
    return let(words_in(blocks), score)


def letter_payload(html: Column) -> Column:
    """The post that a newsletter's page carries: JSON in a string in a script, as a variant; null without one.

    The string ends at the first quote before a bracket that isn't escaped; it is found by place, as a pattern for the
    whole string would recurse over it.
    """
    opens = r"window\._preloads\s*=\s*JSON\.parse\("
    behind = F.substring(html, F.regexp_instr(html, F.lit(opens)) + F.length(F.regexp_extract(html, opens, 0)), F.length(html))
    closes = r'(?<!\\)(?:\\\\)*"\)'
    quoted = let(behind, lambda s: F.substring(s, F.lit(1), F.regexp_instr(s, F.lit(closes)) + F.length(F.regexp_extract(s, closes, 0)) - 2))
    text = F.get_json_object(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "$.v")
    return F.when(F.regexp_instr(html, F.lit(opens)) > 0, F.try_parse_json(text))


def _get(payload: Column, path: str) -> Column:
    value = collapsed(F.try_variant_get(payload, path, "string"))
    return F.when(value != "", value)


def letter_candidates(pages: DataFrame, nodes: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, source, title, excerpt, author, published_at, site_name, cover, blocks) of each page's two sources.

    The payload's body is read like a page of its own; the page's body is the first element of the class pair that marks
    one. pages: key, html and meta. A page may have either, both or none.
    """
    payload = pages.withColumn("post", letter_payload(F.col(html)))
    names = F.array_join(F.filter(F.transform(F.try_variant_get("post", "$.post.publishedBylines", "array<variant>"), lambda x: F.try_variant_get(x, "$.name", "string")), lambda n: F.trim(n) != ""), ", ")
    cover = F.filter(F.array(_get(F.col("post"), "$.post.cover_image"), F.col("meta.cover")), lambda c: c.isNotNull() & ~F.coalesce(c == _get(F.col("post"), "$.pub.logo_url"), F.lit(False)) & ~F.coalesce(c == _get(F.col("post"), "$.post.publishedBylines[0].photo_url"), F.lit(False)) & ~c.rlike(r"(?i)/favicon"))
    known = payload.select(
        key,
        F.coalesce(_get(F.col("post"), "$.post.title"), F.col("meta.title")).alias("title"),
        F.coalesce(_get(F.col("post"), "$.post.subtitle"), F.col("meta.description")).alias("excerpt"),
        F.when(names != "", names).alias("named"),
        F.col("meta.author").alias("said_author"),
        F.coalesce(_get(F.col("post"), "$.post.post_date"), F.col("meta.published_at")).alias("published_at"),
        F.coalesce(_get(F.col("post"), "$.pub.name"), F.col("meta.site_name")).alias("site_name"),
        F.get(cover, F.lit(0)).alias("cover"),
        F.try_variant_get("post", "$.post.body_html", "string").alias("body"),
    )
    bodies = tree.tree_rows(known.filter("trim(body) != ''").select(key, "body"), key, "body").withColumn("source", F.lit("payload-body-html"))
    order = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    within = lambda test: F.coalesce(F.max(F.when(test, F.col("last"))).over(order) >= F.col("pre"), F.lit(False))
    placed = nodes.withColumn("open", within(_has("available-content"))).withColumn("letter", within((F.col("tag") == "article") & _has("newsletter-post"))).withColumn("post", within((F.col("tag") == "article") & _has("post")))
    marked = placed.filter(_has("body", "markup"))
    full = F.col("length") >= LEAST_LETTER
    where = [F.col("open"), F.lit(True), F.col("letter"), F.col("post")]
    # Of each place the first body counts, if it is long enough; at last a short one of a newsletter's article.
    firsts = marked.groupBy(key).agg(*(F.min_by(F.when(t, F.struct(F.col("pre").alias("root"), F.col("last").alias("root_last"), full.alias("full"))), F.when(t, F.col("pre"))).alias(f"r{k}") for k, t in enumerate(where)))
    root = F.coalesce(*(F.when(F.col(f"r{k}.full"), F.col(f"r{k}")) for k in range(4)), F.col("r2"))
    roots = firsts.select(key, root.alias("r")).filter("r IS NOT NULL").select(key, "r.root", "r.root_last")
    dom = tree.inside(nodes, roots, key).drop("root", "root_last").withColumn("source", F.lit("dom-body-root"))
    attrs = F.col("attrs")
    noise = F.col("tag").isin(*LETTER_NOISE_TAGS) | F.arrays_overlap(_classes(), F.array(*map(F.lit, LETTER_NOISE_CLASSES))) | F.coalesce(attrs["role"] == "complementary", F.lit(False))
    both = tree.uncovered(bodies.unionByName(dom), [key, "source"], noise)
    authors = tree.first_of(nodes, [key], rel=(attrs["rel"] == "author", F.col("text")))
    blocks = tree.blocks_of(both, [key, "source"]).join(known, key).join(authors, key, "left")
    return blocks.select(key, "source", "title", "excerpt", F.coalesce("named", F.when(F.col("rel") != "", F.col("rel")), "said_author").alias("author"), "published_at", "site_name", "cover", "blocks")


def _best(scored: DataFrame, key: str, *columns: str) -> DataFrame:
    """The candidate of each key with the highest score; of equals the one with the higher base."""
    return scored.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("score", "base")).alias("c")).select(key, "c.*")


def _base(bases: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in bases.items() for x in pair)), F.col("source"))


def read_letters(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, source, score, title, excerpt, author, published_at, site_name, cover, blocks): each newsletter's better source."""
    facts = [c for c in candidates.columns if c not in (key, "source", "blocks")]
    cleaned = clean_letters(candidates, [key, "source"], facts).withColumn("base", _base(LETTER_BASES))
    scored = cleaned.withColumn("score", letter_score(F.col("blocks"), F.col("base"), *map(F.col, ("front", "boilerplate", "images", "captions"))))
    return _best(scored, key, "source", "score", "title", "excerpt", "author", "published_at", "site_name", "cover", "blocks")


def clean_news(candidates: DataFrame, by: list[str], whole: bool = False) -> DataFrame:
    """(by, blocks, boilerplate, duplicates, images): news without images, promotions and labels, and without front matter
    up to the first long paragraph.

    candidates: by, title, excerpt, author, published_at, blocks. The author, credits and dates are front matter only
    until a paragraph or quote of SUBSTANTIVE characters has stayed; what then leads and repeats title, excerpt or author
    goes, and after it front matter once more. whole: all blocks with all of their texts, not as ``sanitized`` bounds them.
    """
    rows = _rows(candidates, by, comparable, whole)
    timed = F.col("said").rlike(_MONTH) & F.col("said").rlike(r"(?i)\b(?:am|pm|utc|gmt|cet|cest|est|edt)\b")
    on_day = F.coalesce(F.contains("told", comparable(F.date_format("_day", "MMMM d, yyyy"))), F.lit(False))
    rows = rows.withColumn("matter", (F.col("told") != "") & (_is("author") | _any(F.col("said"), NEWS_CREDITS) | timed | on_day))
    rows = rows.withColumn("images", F.col("b.type") == "image").withColumn("promotion", _any(F.col("said"), NEWS_PROMOTIONS) | F.col("said").rlike(NEWS_LABELS))
    text = ~F.col("images") & (F.col("said") != "")
    body = text & ~F.col("matter") & ~F.col("promotion") & F.col("b.type").isin("paragraph", "quote") & (F.length("said") >= SUBSTANTIVE)
    order = Window.partitionBy(*by).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("entered", F.coalesce(F.max(body).over(before), F.lit(False)))
    rows = rows.withColumn("first_gone", text & ((F.col("matter") & ~F.col("entered")) | F.col("promotion")))
    rows = rows.withColumn("left", text & ~F.col("first_gone"))
    # Echoes of the title lead until a block that is none stays; front matter leads after them.
    echo = _is("title", "excerpt", "author")
    rows = rows.withColumn("said_first", F.coalesce(F.max(F.col("left") & ~echo).over(upto), F.lit(False))).withColumn("duplicates", F.col("left") & ~F.col("said_first"))
    rows = rows.withColumn("begun", F.coalesce(F.max(F.col("left") & ~F.col("duplicates") & ~F.col("matter")).over(upto), F.lit(False)))
    lead = F.col("left") & ~F.col("duplicates") & ~F.col("begun")
    rows = rows.withColumn("boilerplate", F.col("first_gone") | lead)
    return _collected(rows, F.col("left") & ~F.col("duplicates") & F.col("begun"), by, ["boilerplate", "duplicates", "images"])


def news_score(blocks: Column, base: Column, boilerplate: Column, duplicates: Column, images: Column) -> Column:
    least = lambda x, k: F.least(x, F.lit(k))
    score = lambda words: base + F.least(F.lit(72.0), words / 38) + 2.4 * least(_of_type(blocks, "paragraph", "quote"), 20) + 1.2 * least(_of_type(blocks, "heading"), 4) - 4 * boilerplate - 2 * duplicates - 2 * images - 3 * _of_type(blocks, "image") - F.when(words < 140, 40).otherwise(0)
    return let(words_in(blocks), score)


def body_paragraphs(text: Column) -> Column:
    """The paragraphs of an article given as one text: at blank lines, or else sentences in runs of up to PARAGRAPH characters."""
    filled = lambda parts: F.filter(F.transform(parts, collapsed), lambda p: p != "")
    whole = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))
    blank, sentences = filled(F.split(whole, r"\n{2,}")), filled(F.split(whole, r"(?<=[.?!])\s+"))
    none = F.array().cast("array<string>")

    def add(s: Column, x: Column) -> Column:
        longer = F.when(s["run"] == "", x).otherwise(F.concat_ws(" ", s["run"], x))
        full = (F.length(longer) > PARAGRAPH) & (s["run"] != "")
        return F.struct(F.when(full, F.array_append(s["done"], s["run"])).otherwise(s["done"]).alias("done"), F.when(full, x).otherwise(longer).alias("run"))

    packed = F.aggregate(sentences, F.struct(none.alias("done"), F.lit("").alias("run")), add, lambda s: F.when(s["run"] != "", F.array_append(s["done"], s["run"])).otherwise(s["done"]))
    return let(blank, lambda b: F.when(F.size(b) > 1, b).otherwise(packed))


def news_candidates(pages: DataFrame, nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, source, title, excerpt, author, published_at, site_name, cover, blocks): a news page's body and its JSON-LD article.

    The body is the longest element of the first kind in NEWS_BODIES that has LEAST_NEWS_BODY characters, or else an
    article; other articles in it, menus, buttons and promotions go. pages: key, page (as read_html reads it) and meta.
    """
    attrs, tag, text = F.col("attrs"), F.col("tag"), F.col("text")
    kind = F.lit(None).cast("int")
    for k, mark in reversed(list(enumerate(NEWS_BODIES))):
        name, value = mark.split("=")
        kind = F.when(_has(value) if name == "class" else F.coalesce(attrs[name] == value, F.lit(False)), k).otherwise(kind)
    kind = F.coalesce(kind, F.when(tag == "article", len(NEWS_BODIES)))
    long_ = F.when(F.col("length") >= LEAST_NEWS_BODY, F.struct((-kind).alias("kind"), F.col("length"), (-F.col("pre")).alias("p")))
    root = F.struct(F.col("pre").alias("root"), F.col("last").alias("root_last"))
    picked = nodes.filter(kind.isNotNull()).groupBy(key).agg(F.max_by(root, long_).alias("long"), F.min_by(F.when(tag == "article", root), F.when(tag == "article", F.col("pre"))).alias("any"))
    roots = picked.select(key, F.coalesce("long", "any").alias("r")).filter("r IS NOT NULL").select(key, "r.root", "r.root_last")
    within = tree.inside(nodes, roots, key)
    ahead = Window.partitionBy(key).orderBy("pre").rowsBetween(0, Window.unboundedFollowing)
    heading = F.first(F.when(tag.isin("h1", "h2", "h3", "h4"), F.struct("pre", "text")), ignorenulls=True).over(ahead)
    within = within.withColumn("heading", heading)
    other = (F.col("heading.pre") <= F.col("last")) & F.col("heading.text").rlike(r"(?i)^(more from bloomberg|up next)\b")
    gone = tag.isin("article", "aside", "nav", "footer", "form", "script", "style", "noscript", "button") | F.coalesce(attrs["role"] == "complementary", F.lit(False)) | ((text != "") & (F.col("length") <= 240) & _any(text, NEWS_PROMOTIONS)) | F.coalesce(other, F.lit(False))
    dom = tree.blocks_of(tree.uncovered(within, [key], gone), [key]).withColumn("source", F.lit("dom"))
    order = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    in_header = F.coalesce(F.max(F.when(tag == "header", F.col("last"))).over(order) >= F.col("pre"), F.lit(False))
    marked = nodes.withColumn("in_header", in_header)
    by = F.regexp_replace(text, r"(?i)^by\s+", "")
    said = tree.first_of(
        marked,
        [key],
        h1=((tag == "h1") & (text != ""), text),
        rel=(F.coalesce(attrs["rel"] == "author", F.lit(False)) & (text != ""), by),
        prop=(F.coalesce(attrs["itemprop"] == "author", F.lit(False)) & (text != ""), by),
        profile=((tag == "a") & F.coalesce(attrs["href"].contains("/authors/"), F.lit(False)) & (text != ""), by),
        time=((tag == "time") & F.coalesce(attrs["datetime"] != "", F.lit(False)), attrs["datetime"]),
        lede=(F.col("in_header") & tag.isin("h2", "p") & (F.length(text) >= 40), text),
        image=((tag == "img") & F.coalesce(attrs["src"] != "", F.lit(False)), attrs["src"]),
    )
    known = pages.join(said, key, "left").select(
        key,
        F.coalesce("h1", F.trim(F.regexp_replace("meta.title", r"(?i)\s*-\s*Bloomberg\s*$", ""))).alias("title"),
        F.coalesce(F.when(~F.col("lede").eqNullSafe(F.col("h1")), F.col("lede")), F.col("meta.description")).alias("excerpt"),
        F.coalesce("rel", "prop", "profile", F.col("meta.author")).alias("author"),
        F.coalesce("time", F.col("meta.published_at")).alias("published_at"),
        F.lit("Bloomberg").alias("site_name"),
        F.coalesce("image", F.col("meta.cover")).alias("cover"),
        body_paragraphs(F.coalesce(F.col("page.meta")["ld:body"], F.col("page.meta")["ld:description"])).alias("parts"),
    )
    ld = known.filter(F.size("parts") > 0).select(key, F.transform("parts", lambda p: block(type=F.lit("paragraph"), text=p)).alias("blocks"), F.lit("jsonld").alias("source"))
    return dom.unionByName(ld).join(known.drop("parts"), key).select(key, "source", "title", "excerpt", "author", "published_at", "site_name", "cover", "blocks")


def read_news(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, source, score, title, excerpt, author, published_at, site_name, cover, blocks): each news page's better source, whole."""
    cleaned = clean_news(candidates, [key, "source"], whole=True).join(candidates.drop("blocks"), [key, "source"]).withColumn("base", _base(NEWS_BASES))
    scored = cleaned.withColumn("score", news_score(F.col("blocks"), F.col("base"), *map(F.col, ("boilerplate", "duplicates", "images"))))
    return _best(scored, key, "source", "score", "title", "excerpt", "author", "published_at", "site_name", "cover", "blocks")


def archived_articles(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, root, root_last, chars, title, author, published_at, description, cover) of each archived page's own article.

    Where the archive's jump target stands, only articles in the main element beside it count. The first article with a
    title of its own, LEAST_ARCHIVED characters and an author or a time is taken, or else the longest with a title, of
    equals the first. A page without such an article has no row.
    """
    attrs, tag, text = F.col("attrs"), F.col("tag"), F.col("text")
    main = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    jump = F.min(F.when(attrs["id"] == JUMP_TARGET, F.col("parent"))).over(main)
    beside = nodes.withColumn("jump", jump)
    edge = F.max(F.when(F.col("pre") == F.col("jump"), F.col("last"))).over(main)
    scope = F.min(F.when((tag == "main") & (F.col("pre") > F.col("jump")) & (F.col("pre") <= F.col("edge")), F.struct("pre", "last"))).over(main)
    scoped = beside.withColumn("edge", edge).withColumn("scope", scope)
    articles = scoped.filter((tag == "article") & (F.col("scope").isNull() | ((F.col("pre") > F.col("scope.pre")) & (F.col("pre") <= F.col("scope.last")))))
    roots = articles.select(key, F.col("pre").alias("root"), F.col("last").alias("root_last"), F.col("length").alias("chars"))
    inner = tree.inside(nodes, roots, key)
    order = Window.partitionBy(key, "root").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key, "root").orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    header = F.min(F.when(tag == "header", F.struct("pre", "last"))).over(order)
    next_heading = F.min(F.when(tag.isin("h1", "h2", "h3", "h4", "h5", "h6"), F.col("pre"))).over(ahead)
    inner = inner.withColumn("header", header).withColumn("next_heading", next_heading)
    in_header = F.coalesce((F.col("pre") > F.col("header.pre")) & (F.col("pre") <= F.col("header.last")), F.lit(False))
    bare = F.coalesce(F.col("next_heading") > F.col("last"), F.lit(True))
    timed = (tag == "time") & F.coalesce(attrs["datetime"] != "", F.lit(False))
    said = tree.first_of(
        inner,
        [key, "root", "root_last", "chars"],
        title=(tag == "h1", text),
        author=(attrs["rel"] == "author", text),
        published_at=(timed, attrs["datetime"]),
        cover=((tag == "img") & F.coalesce(attrs["src"] != "", F.lit(False)), attrs["src"]),
    )
    lines = inner.filter(in_header & bare & tag.isin("p", "div")).join(said.select(key, "root", "title"), [key, "root"]).filter((F.length("text") >= 40) & ~F.col("text").eqNullSafe(F.col("title")))
    described = tree.first_of(lines, [key, "root"], description=(F.lit(True), text))
    own = (F.col("chars") >= LEAST_ARCHIVED) & ~F.col("title").rlike(ARCHIVE_OTHERS) & (F.col("author").isNotNull() | F.col("published_at").isNotNull())
    titled = said.filter("title != ''").join(described, [key, "root"], "left")
    row = F.struct("root", "root_last", "chars", "title", "author", "published_at", "description", "cover")
    best = F.when(own, F.struct(F.lit(1).alias("own"), F.lit(0).alias("n"), (-F.col("root")).alias("r"))).otherwise(F.struct(F.lit(0).alias("own"), F.col("chars").alias("n"), (-F.col("root")).alias("r")))
    return titled.groupBy(key).agg(F.max_by(row, best).alias("a")).select(key, "a.*")


def archived_blocks(nodes: DataFrame, articles: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, blocks): an archived article's blocks without what stands in it of the site around it.

    Other articles, related sections, by-lines and dates, sign-up boxes, promotions, controls and what is hidden by style
    go. All is judged on the article as it was archived, not on what is left.
    """
    attrs, tag, text = F.col("attrs"), F.col("tag"), F.col("text")
    rich = ("p", "figure", "img", "video", "article", "form", "blockquote", "ul", "ol")
    timed = (tag == "time") & F.coalesce(attrs["datetime"] != "", F.lit(False))
    inner = tree.inside(nodes, articles.select(key, "root", "root_last"), key)
    flat = inner.withColumn("author_", F.coalesce(attrs["rel"] == "author", F.lit(False))).withColumn("timed", timed).withColumn("control", tag.isin("form") | ((tag == "input") & F.coalesce(attrs["type"] == "email", F.lit(False))) | ((tag == "button") & F.coalesce(attrs["type"] == "submit", F.lit(False))))
    sums = tree.subtree_sums(
        flat.select(key, "pre", "last", "tag", "author_", "timed", "control", F.col("attrs")["href"].isNotNull().alias("linked")),
        key,
        rich=tag.isin(*rich),
        authors=F.col("author_"),
        times=F.col("timed"),
        controls=F.col("control"),
        told=tag.isin("p", "h1", "h2", "h3", "h4", "blockquote", "ul", "ol", "pre"),
        media=tag.isin("img", "picture", "figure", "video", "source"),
        listed=tag.isin("article", "li", "h2", "h3", "h4") | ((tag == "a") & F.col("linked")),
    ).select(key, "pre", "rich", "authors", "times", "controls", "told", "media", "listed")
    ahead = Window.partitionBy(key).orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    heading = F.first(F.when(tag.isin("h1", "h2", "h3", "h4"), F.struct("pre", "text")), ignorenulls=True).over(ahead)
    seen = flat.withColumn("heading", heading).join(sums, [key, "pre"])
    related = (F.col("listed") > 0) & F.coalesce((F.col("heading.pre") <= F.col("last")) & F.col("heading.text").rlike(ARCHIVE_RELATED), F.lit(False))
    meta_row = (text != "") & (F.col("rich") == 0) & ((F.col("authors") > 0) | ((F.col("timed") | (F.col("times") > 0)) & (F.col("length") <= 80)))
    signup = (text != "") & (F.col("controls") > 0) & (F.col("told") < 3) & (F.col("length") <= 360) & text.rlike(ARCHIVE_SIGNUP)
    style = F.lower(F.coalesce(attrs["style"], F.lit("")))
    gone = (tag == "article") | related | meta_row | signup | _any(text, ARCHIVE_PROMOTIONS) | ((tag == "button") & (F.col("media") == 0)) | tag.isin("form", "input", "label", "option") | style.contains("display:none") | style.contains("visibility:hidden")
    # A button around an image only opens it: the image stays.
    kept = tree.uncovered(seen, [key], gone).withColumn("tag", F.when(tag == "button", "div").otherwise(tag))
    return tree.blocks_of(kept, [key])


def read_archived(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, strategy, quality, total, title, author, published_at, excerpt, site_name, cover, blocks) of archived pages.

    url is the archived page's own address. Every reader that fits the site reads the article: the generic one always,
    the others by the site's host or the article's marks; they are ranked by quality, the others with a bias. What the
    article itself says of title, author and date goes before what the page says. A page without an article has no row.
    """
    read = cut(pages.select(key, url, extract.read_html(F.col(html)).alias("page")).withColumn("meta", extract.metadata(F.col("page"))).drop("page"))
    nodes = cut(tree.tree_rows(pages, key, html))
    articles = cut(archived_articles(nodes, key))
    titles = tree.first_of(nodes, [key], page_title=(F.col("tag") == "title", F.col("text")))
    site = bare_host(host(F.col(url)))
    marks = nodes.join(articles.select(key, "root", "root_last"), key).filter((F.col("pre") >= F.col("root")) & (F.col("pre") <= F.col("root_last"))).groupBy(key).agg(F.max(F.coalesce(F.col("attrs")["class"].rlike(r"(?i)newsletter-post|available-content|\bbody\s+markup\b"), F.lit(False))).alias("is_letter"))
    known = read.join(articles, key).join(titles, key, "left").join(marks, key, "left").select(
        key,
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("meta.title")).alias("title"),
        F.coalesce("description", F.col("meta.description")).alias("excerpt"),
        F.coalesce(F.when(F.col("author") != "", F.col("author")), F.col("meta.author")).alias("author"),
        F.coalesce("published_at", F.col("meta.published_at")).alias("published_at"),
        F.coalesce(site_of_title(F.col("page_title")), site).alias("site_name"),
        F.coalesce("cover", F.col("meta.cover")).alias("cover"),
        of_domain(host(F.col(url)), "bloomberg.com").alias("is_news"),
        (of_domain(host(F.col(url)), "substack.com") | F.coalesce("is_letter", F.lit(False))).alias("is_letter"),
    )
    rows = cut(archived_blocks(nodes, articles, key).join(known, key))
    by = [key, "source"]
    facts = ("title", "excerpt", "author", "published_at", "site_name", "cover")
    news = clean_news(rows.filter("is_news").withColumn("source", F.lit("news")), by).select(*by, "blocks")
    letters = clean_letters(rows.filter("is_letter").withColumn("source", F.lit("letter")), by).select(*by, "blocks")
    plain = rows.select(key, F.lit("generic").alias("source"), extract.cleaned(sanitized(F.col("blocks")), F.col("title"))["blocks"].alias("blocks")).filter(F.size("blocks") > 0)
    every = news.unionByName(letters).unionByName(plain).join(known.select(key, *facts), key)
    quality = article_quality(F.struct(*facts, "blocks"))
    bias = F.when(F.col("source") == "generic", 0).otherwise(SITE_BIAS)
    turn = F.when(F.col("source") == "news", 0).when(F.col("source") == "letter", 1).otherwise(2)
    scored = every.withColumn("quality", quality).withColumn("total", F.col("quality") + bias)
    best = scored.groupBy(key).agg(F.max_by(F.struct(F.col("source").alias("strategy"), "quality", "total", *facts, "blocks"), F.struct("total", "quality", -turn)).alias("b"))
    return best.select(key, "b.*")
