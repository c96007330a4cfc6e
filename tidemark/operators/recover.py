"""Aggressive recovery: the densest containers of a page, cleaned hard, ranked against the page's usual candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import collapsed, feed_date
from tidemark.operators import extract, tree
from tidemark.operators.blocks import sanitized
from tidemark.operators.quality import article_quality
from tidemark.runtime import cut

#: Containers looked at and kept, their least text and paragraphs, what counts and how much.
CONTAINERS = ("article", "main", "section", "div")
MOST_SCANNED, MOST_DENSE, LEAST_LENGTH, LEAST_PARAGRAPHS = 300, 6, 500, 3
PARAGRAPH_WORTH, LINK_COST, CONTROL_COST = 180, 2, 400
MOST_GENERIC, DENSE_BIAS = 4, 8
#: Elements, roles and classes that are noise in a container, and words that make a class or id noise.
NOISE_TAGS = ("aside", "nav", "footer", "form", "script", "style", "noscript", "dialog", "button", "svg", "canvas", "iframe")
NOISE_ROLES = ("navigation", "complementary", "search")
NOISE_CLASSES = ("newsletter", "subscription", "subscribe", "sign-up", "signup", "social-share", "share-buttons", "comments", "related", "recommended", "read-more", "post-footer", "entry-footer", "article-footer", "button-wrapper")
NOISE_NAMES = r"(comment|newsletter|subscribe|share|related|recommended|footer)"
#: How texts of at most 220 characters begin that are no part of an article.
LOW_VALUE = (
    r"(?i)^(share|copy link|follow|get alerts|print|restack)\b",
    r"(?i)^(subscribe|sign up|sign in|newsletter|join now)\b",
    r"(?i)^(read more|related|recommended|more from|up next)\b",
    r"(?i)^(contact us|confidential tip|site feedback)\b",
    r"(?i)^(comments?|discussion|reply)\b",
    r"(?i)^by continuing\b",
    r"(?i)^privacy policy\b",
    r"(?i)^terms of service\b",
    r"(?i)^(images?|im[aá]genes?)\s*\|",
    r"(?i)^(en|in)\s+[A-Z][^|]{0,80}\s*\|",
)
MOST_LOW_VALUE, LEAST_REPEATED, SIGNED = 220, 24, 5


def dense_containers(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, rank, root, root_last, tag, chars, paragraphs, link_chars, controls, score, place) of each page's densest containers.

    Of the first MOST_SCANNED containers in document order, those with LEAST_LENGTH characters and LEAST_PARAGRAPHS texts
    or more and a positive score, at most MOST_DENSE, best first, ties in document order. A page without one has no rows.
    """
    tag = F.col("tag")
    summed = tree.subtree_sums(
        nodes.withColumn("role", F.col("attrs")["role"]).drop("attrs"),
        key,
        paragraphs=tag.isin("p", "blockquote", "li", "pre", "code"),
        link_chars=F.when(tag == "a", F.col("length")).otherwise(0),
        controls=tag.isin("form", "button", "input"),
    )
    is_container = tag.isin(*CONTAINERS) | F.coalesce(F.col("role") == "main", F.lit(False))
    scan = Window.partitionBy(key).orderBy("pre")
    scanned = summed.filter(is_container).withColumn("place", F.row_number().over(scan)).filter(F.col("place") <= MOST_SCANNED)
    score = F.col("length") + PARAGRAPH_WORTH * F.col("paragraphs") - LINK_COST * F.col("link_chars") - CONTROL_COST * F.col("controls")
    dense = scanned.filter((F.col("length") >= LEAST_LENGTH) & (F.col("paragraphs") >= LEAST_PARAGRAPHS)).withColumn("score", score).filter("score > 0")
    best = Window.partitionBy(key).orderBy(F.desc("score"), "pre")
    ranked = dense.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= MOST_DENSE)
    return ranked.select(key, "rank", F.col("pre").alias("root"), F.col("last").alias("root_last"), "tag", F.col("length").alias("chars"), "paragraphs", "link_chars", "controls", "score", "place")


def _noise() -> Column:
    attrs = F.col("attrs")
    names = F.lower(F.concat_ws(" ", attrs["class"], attrs["id"]))
    classes = F.split(F.lower(F.coalesce(attrs["class"], F.lit(""))), r"\s+")
    return F.col("tag").isin(*NOISE_TAGS) | F.coalesce(attrs["role"].isin(*NOISE_ROLES), F.lit(False)) | F.arrays_overlap(classes, F.array(*map(F.lit, NOISE_CLASSES))) | names.rlike(NOISE_NAMES)


def container_blocks(nodes: DataFrame, containers: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, rank, blocks): what a container says, without the noise in it."""
    within = tree.inside(nodes, containers.select(key, "rank", "root", "root_last"), key)
    return tree.blocks_of(tree.uncovered(within, [key, "rank"], _noise()), [key, "rank"])


def plain(text: Column) -> Column:
    """A text in lower case without quotes and stops, to be compared."""
    return collapsed(F.translate(F.lower(F.coalesce(text, F.lit(""))), "“”\"'.!?;:", " " * 9))


def _said(b: Column) -> Column:
    """A block's text, or its items in a row."""
    return F.coalesce(F.when(b["type"] == "list", F.array_join(b["items"], " ")).otherwise(b["text"]), F.lit(""))


def low_value(text: Column) -> Column:
    """Does a text begin like a control, a notice or a credit, and is short?"""
    found = F.lit(False)
    for pattern in LOW_VALUE:
        found = found | collapsed(text).rlike(pattern)
    return (F.length(collapsed(text)) <= MOST_LOW_VALUE) & found


def hard_cleaned(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by, blocks, signature): candidates without images, repeated and low-value texts, and noise at their ends.

    candidates: by, title, excerpt, author and blocks. Noise before the text is its title, excerpt or author, a line that
    begins with "by", or a date; noise behind it its title or excerpt. The signature is the first SIGNED texts, by which
    candidates are told apart. Blocks are rows, so each text is made comparable once. A candidate without a text is gone.
    """
    known = [plain(F.col(c)).alias(f"_{c}") for c in ("title", "excerpt", "author")]
    rows = candidates.select(*by, *known, F.posexplode(sanitized(F.col("blocks"))).alias("at", "b")).filter("b.type != 'image'")
    rows = rows.withColumn("said", collapsed(_said(F.col("b")))).withColumn("told", plain(F.col("said")))
    again = F.row_number().over(Window.partitionBy(*by, "told").orderBy("at")) > 1
    kept = rows.withColumn("again", again).filter(~(F.col("again") & (F.length("told") > LEAST_REPEATED)) & ~low_value(F.col("said")))
    echo = lambda *names: (F.col("told") != "") & F.col("told").isin(*(F.col(f"_{n}") for n in names))
    dated = (F.length("said") <= 80) & feed_date(F.col("said")).isNotNull()
    lead, trail = echo("title", "excerpt", "author") | F.col("told").rlike(r"^by\s+") | dated, echo("title", "excerpt")
    order = Window.partitionBy(*by).orderBy("at")
    before = F.sum((~lead).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.sum((~trail).cast("int")).over(order.rowsBetween(0, Window.unboundedFollowing))
    bare = kept.withColumn("before", before).withColumn("behind", behind).filter("before > 0 AND behind > 0")
    back = bare.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "told", "b"))).alias("rows"))
    first = F.filter(F.transform(F.slice("rows", 1, SIGNED), lambda r: r["told"]), lambda t: t != "")
    return back.select(*by, F.transform("rows", lambda r: r["b"]).alias("blocks"), F.array_join(first, " | ").alias("signature"))


def recovered(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, strategy, quality, total, blocks): the best candidate of each page after hard cleaning.

    The page's best four generic candidates come first, then its dense containers with a bias of 8; of candidates with
    the same first texts the first stays, and of all the best by quality and bias wins. A page without any has no row.
    """
    parsed = pages.select(key, extract.read_html(F.col(html)).alias("page")).withColumn("meta", extract.metadata(F.col("page")))
    read = cut(parsed.select(key, "meta", F.slice(extract.candidates(F.col("page"), F.col("meta")), 1, MOST_GENERIC).alias("generic")))
    generic = read.select(key, "meta", F.posexplode("generic").alias("at", "c"))
    one = generic.select(key, "meta", (F.col("at") + 1).alias("turn"), F.concat(F.lit("generic:"), F.col("c.container")).alias("strategy"), F.lit(0).alias("bias"), F.col("c.title").alias("title"), F.col("c.author").alias("author"), F.col("c.blocks").alias("blocks"))
    nodes = cut(tree.tree_rows(pages, key, html))
    containers = dense_containers(nodes, key)
    dense = container_blocks(nodes, containers, key).join(containers.select(key, "rank", "place"), [key, "rank"]).join(read.select(key, "meta"), key)
    two = dense.select(key, "meta", (F.col("rank") + MOST_GENERIC).alias("turn"), F.concat(F.lit("dense:container-"), F.col("place")).alias("strategy"), F.lit(DENSE_BIAS).alias("bias"), F.col("meta.title").alias("title"), F.col("meta.author").alias("author"), "blocks")
    both = one.unionByName(two).withColumn("excerpt", F.col("meta.description"))
    cleaned = hard_cleaned(both, [key, "turn"]).join(both.drop("blocks"), [key, "turn"])
    signed = cleaned.filter("signature != ''")
    first = Window.partitionBy(key, "signature").orderBy("turn")
    told = signed.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    doc = F.struct("title", F.col("meta.description").alias("excerpt"), "author", F.col("meta.published_at").alias("published_at"), F.col("meta.site_name").alias("site_name"), F.col("meta.cover").alias("cover"), "blocks")
    scored = told.withColumn("quality", article_quality(doc)).withColumn("total", F.col("quality") + F.col("bias"))
    best = scored.groupBy(key).agg(F.max_by(F.struct("strategy", "quality", "total", "title", "author", "blocks"), F.struct("total", "quality", -F.col("turn"))).alias("b"))
    return best.select(key, "b.*")
