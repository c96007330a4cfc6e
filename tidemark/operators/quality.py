"""How good a parsed document is, and what to do about a bad one. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import collapsed
from tidemark.operators.blocks import count_of, metrics

#: Scores at which an article is worth another try, urgently or not; least gain that replaces a text.
LOW_SCORE, BORDER_SCORE, MARGIN, LEAST = 12, 24, 18, 18
#: How texts of at most 180 characters begin that hardly belong to an article.
SUSPICIOUS = (
    r"(?i)^(share|copy link|follow|following|get alerts)\b",
    r"(?i)^(subscribe|sign up|sign in|newsletter|restack)\b",
    r"(?i)^(read more|related|recommended|more from|up next)\b",
    r"(?i)^(contact us|confidential tip|site feedback)\b",
    r"(?i)^(discussion|comments?|reply)\b",
)
MOST_SUSPICIOUS = 180
BUDGETS = {"parsed": 262_144, "compact": 32_768}


def js_round(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def said(b: Column) -> Column:
    """A block's text, its items in a row, or an image's caption or else alternative text, white space collapsed."""
    items = F.when(b["type"] == "list", F.array_join(b["items"], " "))
    return collapsed(F.coalesce(items, F.when(b["type"] == "image", F.coalesce(b["caption"], b["alt"])).otherwise(b["text"]), F.lit("")))


def suspicious(text: Column) -> Column:
    """Is a text short and begins like a control, a notice or a heading of other things?"""
    found = F.lit(False)
    for p in SUSPICIOUS:
        found = found | text.rlike(p)
    return (text != "") & (F.length(text) <= MOST_SUSPICIOUS) & found


def article_quality(doc: Column) -> Column:
    """doc: a struct of title, excerpt, author, published_at, site_name, cover and blocks."""
    blocks = doc["blocks"]
    m = metrics(blocks)
    words, p = m["words"], count_of(blocks, "paragraph", "quote")
    prose = F.filter(blocks, lambda b: b["type"].isin("paragraph", "quote"))
    duplicates = F.size(prose) - F.size(F.array_distinct(F.transform(prose, lambda b: F.lower(collapsed(b["text"])))))
    odd = F.size(F.filter(blocks, lambda b: suspicious(said(b))))
    least = lambda x, k: F.least(x, F.lit(k))
    score = F.least(F.lit(140.0), words / 10) + 3.1 * least(p, 24) + 1.6 * least(count_of(blocks, "heading"), 8) + 1.4 * least(count_of(blocks, "list"), 4) + 1.6 * least(count_of(blocks, "code"), 3)
    for name, worth in (("title", 8), ("author", 5), ("published_at", 4), ("excerpt", 4), ("site_name", 2), ("cover", 1)):
        score = score + F.when(F.coalesce(doc[name], F.lit("")) != "", worth).otherwise(0)
    many = p >= 3
    short = F.when(words < 80, F.when(many, 20).otherwise(72)).when(words < 160, F.when(many, 8).otherwise(32)).when(words < 260, F.when(many, 4).otherwise(12)).otherwise(0)
    score = score - 6 * m["images"] - 8 * duplicates - 16 * odd - short - F.when((p == 0) & (words < 120), 36).otherwise(0) - F.when((F.size(blocks) <= 2) & (words < 180), 28).otherwise(0) - F.when(count_of(blocks, "image") == F.size(blocks), 180).otherwise(0)
    first = F.get(F.filter(F.transform(blocks, said), lambda t: t != ""), F.lit(0))
    echo = (F.lower(first) == F.lower(collapsed(doc["title"]))) & (F.coalesce(doc["title"], F.lit("")) != "")
    return score - F.when(F.coalesce(echo, F.lit(False)), 18).otherwise(0)


def text_document_score(words: Column, blocks: Column, has_title: Column, has_excerpt: Column) -> Column:
    some = lambda t, worth: F.when(count_of(blocks, t) > 0, worth).otherwise(0)
    total = F.least(F.lit(220), js_round(words / 4)) + F.least(F.lit(48), 4 * F.size(blocks)) + F.when(has_title, 24).otherwise(0) + F.when(has_excerpt, 12).otherwise(0) + some("heading", 10) + some("list", 10) + some("code", 12)
    return F.least(F.greatest(total, F.lit(0)), F.lit(320))


def warnings(parsed: Column, compact: Column) -> Column:
    """Budgets that a document's JSON nearly or wholly uses up."""
    found = []
    for name, value in (("parsed-document", parsed), ("compact-body", compact)):
        share = F.octet_length(F.to_json(value)) / BUDGETS["parsed" if name[0] == "p" else "compact"]
        found.append(F.when(share > 1, f"{name}-over-budget").when(share > 0.9, f"{name}-near-budget"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def within_budget(parsed: Column, old: Column) -> Column:
    """What becomes of a parsed document: stored, or, where its JSON is too long, the old one kept and the parse failed for good."""
    over = F.octet_length(F.to_json(parsed)) > BUDGETS["parsed"]
    return F.struct(F.when(over, old).otherwise(parsed).alias("document"), F.when(over, "failed").otherwise("succeeded").alias("status"), F.when(over, F.lit(False)).alias("retryable"), F.when(over, "Parsed document exceeded the size limit").alias("error"))


def recovery(kind: Column, title: Column, words: Column, blocks: Column, score: Column, notes: Column, is_text: Column) -> Column:
    """Whether to try again, how urgently and why (at most eight reasons)."""
    article = kind == "article"
    short = F.when(is_text, words < 20).otherwise(words < 80) | (blocks == 0)
    thin = F.when(is_text, words < 60).otherwise(words < 220) & (blocks < F.when(is_text, 2).otherwise(3))
    rules = [
        (F.coalesce(title, F.lit("")) == "", "missing-title", False),
        (F.array_contains(notes, "parsed-document-over-budget"), "parsed-document-over-budget", False),
        (F.array_contains(notes, "compact-body-over-budget"), "compact-body-over-budget", False),
        (article & short, "article-empty-or-too-short", True),
        (article & ~short & thin, "article-too-few-blocks", True),
        (article & (score <= LOW_SCORE), "article-low-quality-score", True),
        (article & (score > LOW_SCORE) & (score <= BORDER_SCORE), "article-borderline-quality-score", False),
        (~article & ((words < 20) | (blocks == 0)), "post-empty-or-too-short", True),
    ]
    reasons = F.slice(F.filter(F.array(*(F.when(c, r) for c, r, _ in rules)), lambda x: x.isNotNull()), 1, 8)
    urgent = F.lit(False)
    for c, _, high in rules:
        urgent = urgent | (F.coalesce(c, F.lit(False)) & F.lit(high))
    return F.struct((F.size(reasons) > 0).alias("should_recover"), F.when(F.size(reasons) > 0, F.when(urgent, "high").otherwise("low")).alias("priority"), reasons.alias("reasons"))


#: Reasons that ask for a page's rendering, and signs in a page that scripts draw it.
RENDER_REASONS = ("missing-parser-diagnostics", "missing-selected-candidate", "article-empty-or-too-short", "article-too-few-blocks", "article-low-quality-score")
SCRIPT_SIGNS = (
    r"id=[\"']__next[\"']",
    r"\b__NEXT_DATA__\b",
    r"\bself\.__next_f\.push\b",
    r"\bwindow\.__NUXT__\b",
    r"\bnuxt\b",
    r"\bapplication/json\b",
    r"\bdata-reactroot\b",
    r"\bhydration\b",
)


def needs_rendering(page: Column, route: Column, kind: Column, decision: Column) -> Column:
    """Does a page that must be recovered seem to draw its text by script, so that another fetch would be in vain?"""
    count = sum((page.rlike(f"(?i){s}").cast("int") for s in SCRIPT_SIGNS), F.lit(0))
    scripts, paragraphs = F.regexp_count(page, F.lit(r"(?i)<script\b")), F.regexp_count(page, F.lit(r"(?i)<p\b"))
    asked = F.arrays_overlap(decision["reasons"], F.array(*map(F.lit, RENDER_REASONS)))
    wanted = (kind == "article") & decision["should_recover"] & (decision["priority"] == "high") & asked
    return F.coalesce(wanted, F.lit(False)) & ~route.isin("x-thread", "archive-snapshot") & ((count >= 2) | ((scripts >= 12) & (paragraphs <= 6)))
