"""Main text of web pages: page structure, and what a host repeats on its pages.

A page is parsed once into elements and texts. Where it marks its article, the article's blocks are the text; elsewhere
all blocks outside the chrome are one stream of tokens. What a host repeats is taken away from both, by different evidence:

* from pages without an article every run of ``run`` tokens that a different page of the host has too. The suffixes of
  the host's streams are brought together by their first tokens, and the tokens outside shared runs are kept;
* from marked articles whole blocks of ``run`` tokens or more that stand in most of the host's different articles: the
  lower bound of their share, by Wilson's interval, must reach ``SHARE``. So three articles that all have a block are
  evidence enough, two are not, as two articles of a host often share a passage that belongs to both; copies of an
  article count once, and an article of which more than four fifths would go keeps all, as near copies share most blocks.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm._session import cut
from tidemark.runtime import ship

#: Tokens of a run that makes boilerplate when a host repeats it.
RUN = 8
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|iframe|svg|math|title|object|select)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Chrome whatever it holds; and chrome unless it holds the page's article.
_HARD = frozenset("nav footer aside button dialog menu head".split())
_SOFT = frozenset("form header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split())
#: A class or id names chrome if it is made of these words, and of words for places and shapes, and has one of these.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login paywall sidebar sidenav widget widgets related recommended recommendations share sharing social "
    "comment comments reply replies respond disqus breadcrumb breadcrumbs menu menus nav navbar navigation footer masthead popup modal overlay toolbar pager pagination skip".split()
)
_SHAPES = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards center column container content entry first footer form global group head header "
    "holder home icon icons inner inline item items large last layout left link links list lists main media medium mobile module my outer page panel post posts primary region right "
    "row secondary section side site slot small stories story strip tab tabs text title top unit view wrap wrapper zone".split()
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that end where the next of their kind begins, and what they stand in; a paragraph or heading ends at any block.
_ENDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: The share of a host's articles that a block must surely stand in, and how sure that is, in standard deviations.
SHARE, SURE = 0.5, 1.645
#: An article keeps all its blocks if less than this share of its words would be left.
LEFT = 0.2
#: Articles of a page with fewer words than this share of the longest are teasers of others.
TEASER = 0.5


def _named(raw: str) -> str:
    """What a class or id says an element is: chrome, header or nothing.

    Each name counts as a whole: has-sidebar, ad-hoc and share-price are none, sidebar, ad-slot and share-buttons are.
    """
    told = ""
    for name in raw.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if words and all(w in _WORDS or w in _SHAPES for w in words):
            if not _WORDS.isdisjoint(words) or words == ["side", "bar"]:
                return "chrome"
            if "header" in words or words == ["side"]:
                told = "header"
    return told


class _Page:
    """The elements of a page by number: tag, parent, what its names say, its role, whether it is hidden; and its texts."""

    def __init__(self, page: str):
        self.tags, self.parents, self.named, self.roles, self.unseen = ["page"], [-1], [""], [""], [False]
        self.texts: list[tuple[int, str]] = []  # (element, text); a break between blocks is a null text
        stack, at = [0], 0
        for m in _MARKUP.finditer(page):
            if m.start() > at:
                self.texts.append((stack[-1], page[at : m.start()]))
            at = m.end()
            if not m[3]:
                continue
            tag = m[3].lower()
            block = tag not in _INLINE
            if block:
                self.texts.append((stack[-1], ""))
            if m[2]:
                self._close(stack, tag)
            elif tag not in _VOID:
                self._ends(stack, tag, block)
                self._add(tag, stack[-1], m[4] or "")
                if not (m[4] or "").endswith("/"):
                    stack.append(len(self.tags) - 1)
        if at < len(page):
            self.texts.append((stack[-1], page[at:]))

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                del stack[k:]
                return

    def _ends(self, stack: list[int], tag: str, block: bool) -> None:
        if block:
            for k in range(len(stack) - 1, 0, -1):
                if self.tags[stack[k]] in _PROSE:
                    del stack[k:]
                    break
                if self.tags[stack[k]] not in _INLINE:
                    break
        if tag in _ENDS:
            for k in range(len(stack) - 1, 0, -1):
                open_ = self.tags[stack[k]]
                if open_ in _ENDS[tag]:
                    return
                if open_ == tag or _ENDS.get(open_) == _ENDS[tag]:
                    del stack[k:]
                    return

    def _add(self, tag: str, parent: int, raw: str) -> None:
        names, role, hidden = [], "", False
        for name, a, b, c, bare in _ATTRIBUTE.findall(raw):
            name, value = (name or bare).lower(), a or b or c
            if name in ("class", "id"):
                names.append(value)
            elif name == "role":
                role = value.lower()
            hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(_HIDDEN.search(value))
        self.tags.append(tag)
        self.parents.append(parent)
        self.named.append(_named(" ".join(names)) if names else "")
        self.roles.append(role)
        self.unseen.append(hidden)

    def above(self, k: int) -> list[int]:
        out = []
        while k >= 0:
            out.append(k)
            k = self.parents[k]
        return out

    def chrome(self, exempt: frozenset[int] = frozenset()) -> tuple[list[bool], list[bool]]:
        """For each element, whether it stands in chrome of the hard kind, and of either; exempt are none of the soft kind."""
        hard, either, in_article = [False], [False], [False]
        for k in range(1, len(self.tags)):
            tag, up, role = self.tags[k], self.parents[k], self.roles[k]
            inside = in_article[up]
            firm = tag in _HARD or self.unseen[k] or role in _ROLES
            soft = tag == "form" or role == "form" or tag == "header" and not inside or self.named[k] == "chrome" or self.named[k] == "header" and not inside and tag != "article"
            if tag in ("html", "body", "main") and not self.unseen[k]:
                firm = soft = False
            hard.append(hard[up] or firm)
            either.append(either[up] or firm or soft and k not in exempt)
            in_article.append(inside or tag in ("article", "main") or role == "main")
        return hard, either

    def words(self, hidden: list[bool]) -> list[int]:
        """Words outside what is hidden, by element, those of its descendants included."""
        out = [0] * len(self.tags)
        for k, text in self.texts:
            if text and not hidden[k]:
                out[k] += len(text.split())
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += out[k]
        return out

    def blocks(self, keep: list[bool]) -> list[str]:
        found: list[list[str]] = [[]]
        for k, text in self.texts:
            if text == "":
                found.append([])
            elif keep[k]:
                found[-1].append(text)
        return _texts(found)


def _below(page: _Page, roots: set[int]) -> list[bool]:
    """Which elements are one of the roots or stand in one."""
    inside = [False] * len(page.tags)
    for k in range(1, len(inside)):
        inside[k] = k in roots or inside[page.parents[k]]
    return inside


def _articles(page: _Page) -> tuple[set[int], list[bool]]:
    """The elements that hold the page's article, none if it marks none, and what is chrome then.

    Outermost article elements outside the chrome, or else main elements. A page's only article is its article even in
    a wrapper whose names say chrome, or under such a name of its own, if it has as many words as the rest of the text.
    """
    hard, either = page.chrome()
    for kind in (lambda k: page.tags[k] == "article", lambda k: page.tags[k] == "main" or page.roles[k] == "main"):
        outer, seen = [], _below(page, {k for k in range(1, len(page.tags)) if kind(k)})
        for k in range(1, len(page.tags)):
            if kind(k) and not hard[k] and not seen[page.parents[k]]:
                outer.append(k)
        free = [k for k in outer if not either[k]]
        if free:
            words = page.words(either)
            longest = max(words[k] for k in free)
            if longest:
                return {k for k in free if words[k] and words[k] >= TEASER * longest}, either
        elif len(outer) == 1:
            _, exempt = page.chrome(frozenset(page.above(outer[0])))
            words = page.words(exempt)
            if words[outer[0]] and words[outer[0]] >= page.words(either)[0]:
                return set(outer), exempt
    return set(), either


def read_page(page: str) -> tuple[list[str], bool]:
    """(blocks, whether the page marks its article): the article's blocks of text, or else those outside the chrome.

    Without an article, entries of lists that are nothing but links are menus and go too.
    """
    read = _Page(page)
    roots, chrome = _articles(read)
    if roots:
        inside = _below(read, roots)
        return read.blocks([i and not c for i, c in zip(inside, chrome, strict=True)]), True
    linked = _below(read, {k for k, t in enumerate(read.tags) if t == "a"})
    plain = read.words([c or a for c, a in zip(chrome, linked, strict=True)])
    menus = _below(read, {k for k, t in enumerate(read.tags) if t == "li" and not plain[k] and any(read.tags[u] in ("ul", "ol") for u in read.above(k))})
    return read.blocks([not c and not m for c, m in zip(chrome, menus, strict=True)]), False


def _texts(blocks: list[list[str]]) -> list[str]:
    """Each block decoded, its white space one space; empty ones go."""
    return [t for b in blocks if (t := " ".join(html.unescape("".join(b)).split()))]


def page_blocks(page: Column) -> Column:
    """What ``read_page`` makes of a page: blocks and marked."""
    ship(SparkSession.active())

    @F.arrow_udf("struct<blocks:array<string>,marked:boolean>")
    def read(pages: pa.Array) -> pa.Array:
        rows = [read_page(p or "") for p in pages.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([b for b, _ in rows], pa.list_(pa.string())), pa.array([m for _, m in rows], pa.bool_())], names=["blocks", "marked"])

    return read(page)


def unique_runs(streams: DataFrame, run: int = RUN) -> DataFrame:
    """(row, text): each row's tokens without the runs that another page of its host has too.

    streams: row (a struct that names a page), host and text, each row once. A text shorter than ``run`` tokens is one
    run; an empty one stays empty; a frequent run is one row a task, its pages told apart by their first and last.
    """
    tokens = streams.select("row", "host", F.filter(F.split("text", " "), lambda t: t != "").alias("tokens"))
    last = F.greatest(F.size("tokens") - run + 1, F.lit(1))
    # A suffix is told by the hash of its first tokens; the whole run is compared by two hashes.
    head = lambda i: F.array_join(F.slice("tokens", i, run), " ")
    suffixes = tokens.filter(F.size("tokens") > 0).select("row", "host", F.posexplode(F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.xxhash64(head(i)).alias("a"), F.hash(head(i)).alias("b")))).alias("at", "key"))
    # The pages of a run are told apart by their first and last, so one row a task and run is all that is shuffled.
    repeated = suffixes.groupBy("host", "key").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter("first != last").select("host", "key")
    covered = suffixes.join(repeated, ["host", "key"]).groupBy("row").agg(F.collect_set("at").alias("starts"))
    joined = tokens.join(covered, "row", "left")
    return joined.select("row", F.array_join(_outside(F.col("tokens"), F.col("starts"), run), " ").alias("text"))


def _outside(tokens: Column, starts: Column, run: int) -> Column:
    """The tokens that no run from one of the starts on covers; starts may be null."""
    ship(SparkSession.active())

    @F.arrow_udf("array<string>")
    def outside(tokens: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for words, at in zip(tokens.to_pylist(), starts.to_pylist(), strict=True):
            flags = np.zeros(len(words or []) + run, bool)
            flags[np.array(at or [], np.int64)] = True
            gone = C.spread(flags, run)
            out.append([w for w, g in zip(words or [], gone[: len(words or [])], strict=True) if not g])
        C.release()
        return pa.array(out, pa.list_(pa.string()))

    return outside(tokens, starts)


#: Hosts with boilerplate in articles that are broadcast; with more, they are joined by a shuffle.
MOST_BROADCAST = 100_000


def host_blocks(articles: DataFrame, share: float = SHARE, sure: float = SURE) -> DataFrame:
    """(host, boiler): the blocks, by hash, that most of the host's different articles have.

    articles: host, content (a hash of the article) and hashes of its long blocks. The lower bound of a block's share of
    the articles must be ``share`` or more. As each block then stands in that share of the articles, a host has at most
    1 / share times as many as its articles have on average. Equal articles count once; nulls have no blocks; an empty
    table has none.
    """
    contents = articles.groupBy("host", "content").agg(F.first("hashes").alias("hashes"))
    sizes = contents.groupBy("host").agg(F.count("*").alias("articles"))
    counts = contents.select("host", F.explode("hashes").alias("block")).groupBy("host", "block").agg(F.count("*").alias("n")).filter("n > 1")
    part, z2 = F.col("n") / F.col("articles"), sure * sure
    spread = sure * F.sqrt(part * (1 - part) / F.col("articles") + z2 / (4 * F.col("articles") * F.col("articles")))
    least = (part + z2 / (2 * F.col("articles")) - spread) / (1 + z2 / F.col("articles"))
    return counts.join(sizes, "host").filter(least >= share).groupBy("host").agg(F.collect_list("block").alias("boiler"))


def extract_main_text(pages: DataFrame, run: int = RUN, share: float = SHARE) -> DataFrame:
    """Each page's main text: page_id, url, text, n_chars.

    pages: page_id, url, html. Text is decoded, its white space is one space, and blocks are joined by one space. A null
    or empty html, or one that holds nothing but chrome, gives an empty text. A null or odd url is a host of its own, one
    for all. Rows that share an id are pages of their own unless their html and url are the same; copies of a page are
    one page to the repeated runs, and all of them get its text. Pages may be as long as a cell; an empty table gives
    none. Other columns are not read, whatever their names.
    """
    ship(pages.sparkSession)
    row = F.struct(F.coalesce("page_id", F.lit(-1)).alias("id"), F.xxhash64("url", "html").alias("mark"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # Pages are parsed once; their blocks are kept, which are smaller than the pages.
    read = cut(own.select("page_id", "url", row.alias("row"), host.alias("host"), page_blocks(F.col("html")).alias("page")).select("page_id", "url", "row", "host", "page.*"))
    many = lambda b: F.size(F.split(b, " "))
    hashes = F.array_distinct(F.transform(F.filter("blocks", lambda b: many(b) >= run), lambda b: F.xxhash64(b)))
    boiler = cut(host_blocks(read.filter("marked").select("host", F.xxhash64("blocks").alias("content"), hashes.alias("hashes")), share))
    few = F.broadcast(boiler) if boiler.count() <= MOST_BROADCAST else boiler
    words = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + many(b))
    kept = F.filter("blocks", lambda b: ~F.array_contains("boiler", F.xxhash64(b)))
    chosen = F.when(F.col("boiler").isNull() | (words(kept) < LEFT * words(F.col("blocks"))), F.col("blocks")).otherwise(kept)
    articles = read.filter("marked").join(few, "host", "left").select("page_id", "url", F.array_join(chosen, " ").alias("text"))
    streams = read.filter("NOT marked").select("page_id", "url", "row", "host", F.array_join("blocks", " ").alias("text"))
    texts = unique_runs(streams.select("row", "host", "text").dropDuplicates(["row"]), run)
    rest = streams.select("page_id", "url", "row").join(texts, "row").select("page_id", "url", "text")
    return articles.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
