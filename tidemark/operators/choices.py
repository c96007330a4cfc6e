"""Choices among what was found of a document: texts, excerpts, sources, icons, diagnostics. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import comparable, let
from tidemark.functions.urls import canonical_url, path_depth, source_root

#: Least quality of a preferred text, and by how much another must be better to replace it.
LEAST_PREFERRED, OVERRIDE = 18, 18
#: How excerpts begin that say nothing, and how cut texts end.
PLAIN_EXCERPTS = (r"^(share|follow|subscribe|newsletter|sign up|get alerts)\b", r"^(read more|related|recommended|you may also like|more from)\b")
CUT = r"(\[\.\.\.\]|\[…\]|\.{3}|…)$"
#: How texts of at most 180 characters begin that lead an article but are none of it.
LOW_LEADS = (r"(?i)^(gift this article|share|copy link)\b", r"(?i)^(subscribe|sign up|newsletter|follow|get alerts)\b", r"(?i)^(related|recommended|more from|up next)\b")
MOST_LOW_LEAD = 180
#: Scores of the addresses that a page gives for its site, by relation.
SITE_SCORES = {"home": 100, "ld:site": 95, "ld:part": 90, "ld:publisher": 70}
#: What is kept of a parser's report.
KEPT_CANDIDATES, KEPT_WARNINGS, KEPT_NOTES, KEPT_CHARS, REPORT_BYTES = 8, 12, 4, 160, 16_384


def preferred(one: Column, other: Column) -> Column:
    """Which of two texts (structs with quality and total) to take, the first being the site's own reader's.

    The first, as long as it is good enough and the other isn't much better; else the better one.
    """
    good = (one["quality"] >= LEAST_PREFERRED) & (other["total"] < one["total"] + OVERRIDE)
    return F.when(one.isNull() | (other.isNotNull() & ~good & (other["total"] > one["total"])), other).otherwise(one)


def ranked(candidates: Column) -> Column:
    """Candidates with total and quality, best first; ties keep their order."""
    placed = F.transform(candidates, lambda c, k: F.struct((-c["total"]).alias("a"), (-c["quality"]).alias("b"), k.alias("k")))
    return F.transform(F.array_sort(placed), lambda p: F.get(candidates, p["k"]))


def excerpt_score(text: Column, base: int, title: Column) -> Column:
    """How well a text serves as an excerpt: by length, whether it is cut or ends a sentence, and whether it says anything."""
    # What lengths, cut ends, full stops and empty phrases are worth.
    n = F.length(text)
    length = F.when(n.between(80, 320), 18).when(n.between(50, 420), 10).when(n.between(421, 720), 2).otherwise(-10)
    empty = F.coalesce((comparable(text) == comparable(title)) & (comparable(title) != ""), F.lit(False))
    for p in PLAIN_EXCERPTS:
        empty = empty | text.rlike(f"(?i){p}")
    return base + length - F.when(F.trim(text).rlike(CUT), 14).otherwise(0) + F.when(text.rlike(r"[.?!][\"')\]]?$"), 4).otherwise(0) - F.when(empty, 40).otherwise(0)


def excerpt(described: Column, found: Column, title: Column) -> Column:
    """The better of the page's description (base 10) and the text's own beginning (base 14); the shorter of equals."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    a, b = filled(described), filled(found)
    key = lambda t, base: F.struct((-excerpt_score(t, base, title)).alias("s"), F.length(t).alias("n"))
    return F.when(a.isNull(), b).when(b.isNull(), a).when(key(a, 10) <= key(b, 14), a).otherwise(b)


def without_echo(blocks: Column, title: Column, said: Column) -> Column:
    """Blocks from the first on that neither repeats the title or the excerpt nor begins like a control."""
    prose = lambda b: b["type"].isin("paragraph", "quote", "heading") & (F.trim(F.coalesce(b["text"], F.lit(""))) != "")
    same = lambda x, y: (x != "") & F.coalesce(x == comparable(y), F.lit(False))

    def low(text: Column) -> Column:
        found = F.lit(False)
        for p in LOW_LEADS:
            found = found | F.trim(text).rlike(p)
        return (F.length(F.trim(text)) <= MOST_LOW_LEAD) & found

    skipped = lambda b: prose(b) & F.coalesce(let(comparable(b["text"]), lambda t: same(t, title) | same(t, said)) | low(b["text"]), F.lit(False))
    walked = F.aggregate(blocks, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, b: F.struct((s["n"] + (s["on"] & skipped(b)).cast("int")).alias("n"), (s["on"] & skipped(b)).alias("on")))
    return F.slice(blocks, walked["n"] + 1, F.greatest(F.size(blocks) - walked["n"], F.lit(0)))


def _absolute(href: Column, root: Column) -> Column:
    return F.when(href.rlike(r"(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), F.regexp_replace(href, "^/+", "")))


def site_address(url: Column, links: Column) -> Column:
    """The address of the site that a page belongs to, by the page's own word or else its root; null on shared hosts.

    links: rel, href. Of equal scores the shallower address, then the smaller one.
    """
    named = lambda x, r: F.array_contains(F.split(x["rel"], r"\s+"), r)
    score = lambda x: F.greatest(*(F.when(named(x, r), s).otherwise(0) for r, s in SITE_SCORES.items()))

    def best(root: Column) -> Column:
        scored = F.filter(F.transform(links, lambda x: F.struct((-score(x)).alias("s"), x["href"].alias("href"))), lambda c: (c["s"] < 0) & (c["href"] != ""))
        full = F.transform(F.transform(scored, lambda c: F.struct(c["s"].alias("s"), _absolute(c["href"], root).alias("url"))), lambda c: F.struct(c["s"].alias("s"), canonical_url(c["url"]).alias("url")))
        every = F.array_append(F.transform(full, lambda c: F.struct(c["s"].alias("s"), path_depth(c["url"]).alias("d"), c["url"].alias("url"))), F.struct(F.lit(-10).alias("s"), F.lit(0).alias("d"), root.alias("url")))
        return F.when(root.isNotNull(), F.array_min(F.filter(every, lambda c: c["url"].isNotNull()))["url"])

    return let(source_root(url), best)


def icons(url: Column, links: Column) -> Column:
    """The addresses where a page's icon may be, likeliest first. links: rel, type, href."""
    words = lambda x: F.split(x["rel"], r"\s+")
    is_icon = lambda x: F.exists(words(x), lambda w: w.isin("icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon"))

    def ranked_by(root: Column) -> Column:
        full = F.transform(F.filter(links, lambda x: is_icon(x) & (x["href"] != "")), lambda x: F.struct(words(x).alias("rel"), x["type"].alias("type"), _absolute(x["href"], root).alias("url")))

        def candidate(x: Column) -> Column:
            like = lambda t: x["type"].contains(t) | F.lower(x["url"]).endswith(f".{t}")
            bonus = F.when(like("svg"), -3).when(like("png"), -2).when(like("ico"), -1).otherwise(0)
            return F.struct((F.when(F.array_contains(x["rel"], "icon"), 0).otherwise(20) + bonus + F.when(F.array_contains(x["rel"], "mask-icon"), 5).otherwise(0)).alias("rank"), x["url"].alias("url"))

        every = F.array_sort(F.array_append(F.transform(full, candidate), F.struct(F.lit(100).alias("rank"), F.concat(root, F.lit("favicon.ico")).alias("url"))))
        return F.array_distinct(F.transform(F.filter(every, lambda c: c["url"].isNotNull()), lambda c: c["url"]))

    return let(source_root(url), ranked_by)


def original_url(link_header: Column) -> Column:
    """The address that a Link header names as the original."""
    found = F.regexp_extract(link_header, r"(?i)<([^>]+)>\s*;\s*rel=\"original\"", 1)
    return F.when(found != "", found)


def persists_recovered(now: Column, then: Column, still_bad: Column) -> Column:
    """Does a recovered text replace the stored one? now, then: structs with words, blocks and quality of the stored and the new one.

    In place of next to nothing any text does, in place of a text one that isn't worse or clearly longer; one that wants
    recovery itself must be much better and longer.
    """
    lowest = F.lit(float("-inf"))
    gain = F.when(then["quality"].isNull() & now["quality"].isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(then["quality"].cast("double"), lowest) - F.coalesce(now["quality"].cast("double"), lowest))
    by = lambda n: F.coalesce(gain >= n, F.lit(False))
    longer = (then["words"] >= now["words"] + 160) | (then["blocks"] >= now["blocks"] + 3)
    bare = (now["blocks"] == 0) | (now["words"] < 80)
    return F.when(bare, (then["words"] >= 180) | (then["blocks"] >= 3) | by(12)).when(~still_bad, by(-4) | longer).otherwise(by(28) & longer)


def parser_score(candidates: Column) -> Column:
    """The rounded score of the selected candidate, else of the first: total, or else quality; halves go up."""
    chosen = F.coalesce(F.get(F.filter(candidates, lambda c: c["selected"]), F.lit(0)), F.get(candidates, F.lit(0)))
    score = F.floor(F.coalesce(chosen["total"], chosen["quality"]) + 0.5)
    return F.greatest(F.least(score, F.lit(2**31 - 1)), F.lit(-(2**31))).cast("int")


def _shortened(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > KEPT_CHARS, F.concat(F.substring(t, 1, KEPT_CHARS - 1), F.lit("…"))).otherwise(t)


def stored_report(report: Column) -> Column:
    """A parser's report (route, candidates of id, selected, total, quality and notes, warnings) as it is stored.

    Candidates are ordered by selected, total, quality and id; lists and texts are cut. A report that is still too long as
    JSON loses the notes, then the last candidates, and at last all but the selected one and four warnings.
    """
    fields = ("id", "selected", "total", "quality", "notes")
    order = lambda c: F.struct((~c["selected"]).alias("a"), (-c["total"]).alias("b"), (-c["quality"]).alias("c"), c["id"].alias("d"), c.alias("row"))
    ordered = F.transform(F.array_sort(F.transform(report["candidates"], order)), lambda x: x["row"])
    cut = F.transform(F.slice(ordered, 1, KEPT_CANDIDATES), lambda c: F.struct(_shortened(c["id"]).alias("id"), *(c[f].alias(f) for f in fields[1:-1]), F.transform(F.slice(c["notes"], 1, KEPT_NOTES), _shortened).alias("notes")))
    bare = lambda cs: F.transform(cs, lambda c: F.struct(*(c[f].alias(f) for f in fields[:-1]), F.filter(c["notes"], lambda n: F.lit(False)).alias("notes")))
    warnings = F.transform(F.slice(report["warnings"], 1, KEPT_WARNINGS), _shortened)
    made = lambda cs, ws: F.struct(_shortened(report["route"]).alias("route"), cs.alias("candidates"), ws.alias("warnings"))
    steps = [made(cut, warnings), made(bare(cut), warnings), *(made(F.slice(bare(cut), 1, n), warnings) for n in range(KEPT_CANDIDATES - 1, 0, -1))]
    last = made(F.slice(F.filter(bare(cut), lambda c: c["selected"]), 1, 1), F.slice(warnings, 1, 4))
    short = F.filter(F.array(*steps), lambda r: F.octet_length(F.to_json(r)) <= REPORT_BYTES)
    return F.coalesce(F.get(short, F.lit(0)), last)
