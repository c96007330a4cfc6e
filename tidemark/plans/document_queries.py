"""Queries of choices among what was found of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import choices, extract, quality, tree
from tidemark.plans.registry import register
from tidemark.sources.tables import table


@register("b9_preferred_texts", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'other' WHEN doc_id % 13 = 0 THEN 'one' WHEN q >= 18 AND t < q + 18 THEN 'one' WHEN t > q THEN 'other' ELSE 'one' END AS taken FROM (SELECT doc_id, doc_id % 60 AS q, doc_id * 7 % 90 AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = lambda name, q: F.struct(F.lit(name).alias("name"), q.alias("quality"), q.alias("total"))
    one, other = F.when(i % 11 != 0, text("one", i % 60)), F.when((i % 11 == 0) | (i % 13 != 0), text("other", i * 7 % 90))
    return table(spark, d, "documents").select("doc_id", choices.preferred(one, other)["name"].alias("taken"))


@register("b9_ranked_texts", "SELECT doc_id, string_agg(k, ',' ORDER BY t DESC, q DESC, k) AS ranked FROM (SELECT doc_id, k, (doc_id + k * k) % 3 AS t, (doc_id * k) % 2 AS q FROM documents, (VALUES (0), (1), (2), (3)) v(k)) GROUP BY doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = F.array(*(F.struct(F.lit(str(k)).alias("name"), ((i + k * k) % 3).alias("total"), ((i * k) % 2).alias("quality")) for k in range(4)))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(choices.ranked(rows), lambda c: c["name"]), ",").alias("ranked"))


_BAND = "CASE WHEN n BETWEEN 80 AND 320 THEN 18 WHEN n BETWEEN 50 AND 420 THEN 10 WHEN n BETWEEN 421 AND 720 THEN 2 ELSE -10 END"
_ENDS = "CASE WHEN regexp_matches(t, '(\\[\\.\\.\\.\\]|\\[…\\]|\\.{3}|…)$') THEN 14 ELSE 0 END"


@register("b10_excerpts", f"""WITH x AS (SELECT doc_id, v.k, CASE v.k WHEN 0 THEN nullif(trim(substr(text, 1, CAST(doc_id % 500 AS BIGINT)), ' '), '') ELSE trim(substr(text, 1, 200), ' ') || CASE WHEN doc_id % 3 = 0 THEN '…' ELSE '.' END END AS t FROM documents, (VALUES (0), (1)) v(k)),
    s AS (SELECT doc_id, k, t, length(t) AS n FROM x WHERE t IS NOT NULL), p AS (SELECT *, CASE k WHEN 0 THEN 10 ELSE 14 END + {_BAND} - {_ENDS} + CASE WHEN regexp_matches(t, '[.?!]["'')\\]]?$') THEN 4 ELSE 0 END - CASE WHEN regexp_matches(lower(t), '^((share|follow|subscribe|newsletter|sign up|get alerts)|(read more|related|recommended|you may also like|more from))\\b') THEN 40 ELSE 0 END AS score FROM s)
    SELECT doc_id, first(t ORDER BY score DESC, n, k) AS excerpt FROM p GROUP BY doc_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    i, text = F.col("doc_id"), F.col("text")
    found = F.concat(F.trim(F.substring(text, 1, 200)), F.when(i % 3 == 0, "…").otherwise("."))
    return table(spark, d, "documents").select("doc_id", choices.excerpt(F.expr("substring(text, 1, cast(doc_id % 500 as int))"), found, F.lit("no such title")).alias("excerpt"))


_SAID = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '', 'g')"


@register("b12_without_echo", f"""WITH t AS (SELECT conv_id, turn, text, {_SAID.format('text')} AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE text IS NOT NULL),
    r AS (SELECT t.*, f.c AS title, sum(CASE WHEN t.c = f.c AND f.c <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY t.conv_id ORDER BY t.k) AS other FROM t JOIN t f ON f.conv_id = t.conv_id AND f.k = 1)
    SELECT conv_id, CAST(count(*) FILTER (other > 0) AS BIGINT) AS blocks, md5(coalesce(string_agg(text, chr(10) ORDER BY k) FILTER (other > 0), '')) AS texts FROM r GROUP BY conv_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Conversations under the title that their first turn is, in quotes; turns that repeat it at the beginning go."""
    turn = F.struct("turn", "text")
    rows = table(spark, d, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = F.transform("turns", lambda t: F.struct(F.lit("paragraph").alias("type"), t["text"].alias("text")))
    left = choices.without_echo(blocks, F.concat(F.lit("“ "), F.get("turns", F.lit(0))["text"], F.lit(" ”!")), F.lit(None).cast("string"))
    return rows.select("conv_id", left.alias("left")).select("conv_id", F.size("left").cast("long").alias("blocks"), F.md5(F.array_join(F.transform("left", lambda b: b["text"]), "\n").cast("binary")).alias("texts"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their own links, each of which stands for a home or an icon by the length of its address."""
    pages = table(spark, d, "pages")
    to = F.col("attrs")["href"]
    n = F.length(to)
    rel = F.when(n % 4 == 0, "alternate home").when(n % 4 == 1, "shortcut icon").when(n % 4 == 2, "apple-touch-icon").otherwise("nofollow")
    link = F.struct("pre", F.struct(rel.alias("rel"), F.when(n % 8 < 4, "image/png").otherwise("").alias("type"), to.alias("href")).alias("x"))
    found = tree.tree_rows(pages).filter((F.col("tag") == "a") & to.isNotNull()).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(link)), lambda s: s["x"]).alias("links"))
    none = F.array().cast("array<struct<rel:string,type:string,href:string>>")
    return pages.select("page_id", "url").join(found, "page_id", "left").withColumn("links", F.coalesce("links", none))


_ROOT = "(SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS root FROM pages)"
_OWN_LINKS = f"""links AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<a\\b[^>]*href="([^"]*)"', 1)) AS href FROM pages),
    whole AS (SELECT page_id, root, href, length(href) AS n, CASE WHEN href LIKE 'http%' THEN href ELSE root || '/' || ltrim(href, '/') END AS url FROM links JOIN {_ROOT} USING (page_id))"""


@register("b20_site_addresses", f"""WITH {_OWN_LINKS}, homes AS (SELECT page_id, min(root || '/' || replace(replace(url_encode(ltrim(href, '/')), '%2F', '/'), '%2C', ',')) AS home FROM whole WHERE n % 4 = 0 AND href <> '' GROUP BY page_id)
    SELECT page_id, coalesce(home, root || '/') AS site FROM {_ROOT} LEFT JOIN homes USING (page_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("page_id", choices.site_address(F.col("url"), F.col("links")).alias("site"))


@register("b21_icons", f"""WITH {_OWN_LINKS}, ranked AS (SELECT page_id, url, min(CASE WHEN n % 4 = 2 THEN 20 ELSE 0 END - CASE WHEN n % 8 < 4 THEN 2 ELSE 0 END) AS rank FROM whole WHERE n % 4 IN (1, 2) AND href <> '' GROUP BY page_id, url),
    listed AS (SELECT page_id, string_agg(url, ',' ORDER BY rank, url) AS urls FROM ranked GROUP BY page_id)
    SELECT page_id, coalesce(urls || ',', '') || root || '/favicon.ico' AS icons FROM {_ROOT} LEFT JOIN listed USING (page_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("page_id", F.array_join(choices.icons(F.col("url"), F.col("links")), ",").alias("icons"))


@register("h1_original_urls", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS original FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit("<https://t.org/>; rel=\"timegate\", <"), F.col("url"), F.when(F.col("page_id") % 2 == 0, "> ; Rel=\"Original\"").otherwise(">; rel=\"first\""))
    return table(spark, d, "pages").select("page_id", choices.original_url(header).alias("original"))


_MEASURED = "len(regexp_extract_all({0}, '[^ \\t-\\r]+')) AS {1}w, len(list_filter(string_split({0}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS {1}b, CAST(length({0}) // 50 AS BIGINT) AS {1}q"


@register("b25_persisted_recoveries", f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, substr(coalesce(text, ''), 1, length(coalesce(text, '')) // 2) AS half FROM documents),
    p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN half ELSE x END AS stored, CASE WHEN doc_id % 2 = 0 THEN x ELSE half END AS found FROM t),
    m AS (SELECT doc_id, {_MEASURED.format('stored', '')}, {_MEASURED.format('found', 'n')} FROM p)
    SELECT doc_id, CASE WHEN b = 0 OR w < 80 THEN nw >= 180 OR nb >= 3 OR nq - q >= 12 WHEN doc_id % 3 = 0 THEN nq - q >= 28 AND (nw >= w + 160 OR nb >= b + 3) ELSE nq - q >= -4 OR nw >= w + 160 OR nb >= b + 3 END AS persists FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts found where half of them is stored, and halves where the whole is."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", text.alias("whole"), F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")).alias("half"))
    lines = lambda x: F.size(F.filter(F.split(x, "\n"), lambda line: F.trim(F.translate(line, "\t\r", "  ")) != ""))
    of = lambda x: F.struct(X.word_count(x).alias("words"), lines(x).alias("blocks"), F.floor(F.length(x) / 50).alias("quality"))
    whole, half, odd = of(F.col("whole")), of(F.col("half")), F.col("doc_id") % 2 == 1
    keeps = choices.persists_recovered(F.when(odd, whole).otherwise(half), F.when(odd, half).otherwise(whole), F.col("doc_id") % 3 == 0)
    return rows.select("doc_id", keeps.alias("persists"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    candidate = lambda k: F.struct(F.concat(F.lit("c"), k.cast("string")).alias("id"), (k == i % 12).alias("selected"), ((k * 7 + i) % 10 + 0.5).alias("total"), (k + 0.0).alias("quality"), F.array_repeat(F.repeat(F.lit("note "), (i % 50).cast("int")), 6).alias("notes"))
    some = F.transform(F.sequence(F.lit(0), F.lit(11)), candidate)
    return table(spark, d, "documents").select("doc_id", F.struct(F.lit(" generic-article ").alias("route"), some.alias("candidates"), F.array_repeat(F.repeat(F.lit("warn "), 40), 20).alias("warnings")).alias("report"))


@register("n10_stored_reports", "SELECT doc_id, 'c' || (doc_id % 12) AS first_id, CAST(8 AS BIGINT) AS candidates, CAST(4 AS BIGINT) AS notes, CAST(least(160, greatest(doc_id % 50 * 5 - 1, 0)) AS BIGINT) AS note_chars, CAST(12 AS BIGINT) AS warnings, CAST(160 AS BIGINT) AS warning_chars, CAST(floor((doc_id % 12 * 7 + doc_id) % 10 + 1e0) AS INTEGER) AS score FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _reports(spark, d).select("doc_id", choices.stored_report(F.col("report")).alias("r"))
    first = F.get(F.col("r.candidates"), F.lit(0))
    return rows.select("doc_id", first["id"].alias("first_id"), F.size("r.candidates").cast("long").alias("candidates"), F.size(first["notes"]).cast("long").alias("notes"), F.length(F.get(first["notes"], F.lit(0))).cast("long").alias("note_chars"), F.size("r.warnings").cast("long").alias("warnings"), F.length(F.get("r.warnings", F.lit(0))).cast("long").alias("warning_chars"), choices.parser_score(F.col("r.candidates")).alias("score"))


_LATIN, _WIDE = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
_QUOTED = "string_agg('\"' || substr(x, 1 + 100 * k, 1 + doc_id % 160) || '\"', ',' ORDER BY k)"


@register("n10_long_reports", f"""WITH t AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', '', 'g'), '{_LATIN}', '{_WIDE}') AS x FROM documents),
    notes AS (SELECT doc_id, x, {_QUOTED} AS warnings, {_QUOTED} FILTER (k < 4) AS notes FROM t, range(12) r(k) GROUP BY doc_id, x),
    whole AS (SELECT doc_id, x, '{{"route":"r","candidates":[' || string_agg('{{"id":"c' || j || '","selected":' || CASE WHEN j = doc_id % 8 THEN 'true' ELSE 'false' END || ',"total":' || j || '.5,"quality":' || j || '.0,"notes":[' || notes || ']}}', ',' ORDER BY j = doc_id % 8 DESC, j DESC) || '],"warnings":[' || warnings || ']}}' AS j
        FROM notes, range(8) s(j) GROUP BY doc_id, x, notes, warnings)
    SELECT doc_id, CASE WHEN strlen(j) <= 16384 THEN CAST(4 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS notes, CASE WHEN strlen(j) <= 16384 THEN md5(j) ELSE md5(regexp_replace(j, '"notes":\\[[^\\]]*\\]', '"notes":[]', 'g')) END AS stored FROM whole""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Reports whose notes are the documents' letters in a wide script, so that many are over the limit of bytes."""
    wide = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", ""), _LATIN, _WIDE)
    rows = table(spark, d, "documents").select("doc_id", wide.alias("x"))
    said = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(F.col("x"), k * 100 + 1, (F.col("doc_id") % 160 + 1).cast("int")))
    candidate = lambda j: F.struct(F.concat(F.lit("c"), j.cast("string")).alias("id"), (j == F.col("doc_id") % 8).alias("selected"), (j + F.lit(0.5).cast("double")).alias("total"), j.cast("double").alias("quality"), said(6).alias("notes"))
    report = F.struct(F.lit("r").alias("route"), F.transform(F.sequence(F.lit(0), F.lit(7)), candidate).alias("candidates"), said(14).alias("warnings"))
    stored = rows.select("doc_id", choices.stored_report(report).alias("r"))
    return stored.select("doc_id", F.size(F.get("r.candidates", F.lit(0))["notes"]).cast("long").alias("notes"), F.md5(F.to_json("r").cast("binary")).alias("stored"))


@register("f4_parser_reports", "SELECT 'c' || k AS value, count(*) AS n FROM (SELECT unnest(range(12)) AS k, doc_id FROM documents) WHERE k = doc_id % 12 GROUP BY k")
def _(spark: SparkSession, d: str) -> DataFrame:
    """How often each strategy was selected."""
    from tidemark.operators.queues import frequencies

    chosen = F.transform(F.filter("report.candidates", lambda c: c["selected"]), lambda c: c["id"])
    return frequencies(_reports(spark, d).select(chosen.alias("ids")), "ids")


@register("b26_rendering_gate", "SELECT page_id, page_id % 2 = 0 AND page_id % 3 <> 1 AS render FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    page = F.concat(F.lit("<div id=\"__next\"></div>"), F.when(i % 2 == 0, "<script>self.__next_f.push(1)</script>").otherwise("<p>text"))
    reasons = F.array(F.when(i % 3 == 1, "missing-title").otherwise("article-empty-or-too-short"))
    decision = F.struct(F.lit(True).alias("should_recover"), F.lit("high").alias("priority"), reasons.alias("reasons"))
    return table(spark, d, "pages").select("page_id", quality.needs_rendering(page, F.lit("generic-article"), F.lit("article"), decision).alias("render"))


@register("h5_front_matter", "SELECT doc_id, 'Title ' || doc_id AS title, 'Ann' AS author, '2024-01-02' AS published_at, nullif(trim(lang), '') AS language, CAST(1 AS BIGINT) AS headings FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("---\nTitle: \"Title "), i, F.lit("\"\nauthor: 'Ann'\nDate: 2024-01-02\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\n---\n\n# Title "), i, F.lit("\n\nText.\n\n## Section\n"))
    rows = table(spark, d, "documents").select("doc_id", extract.front_matter(raw).alias("f"), extract.read_markdown(raw).alias("blocks"))
    body = extract.without_title(F.col("blocks"), F.col("f.title"))
    return rows.select("doc_id", "f.title", "f.author", "f.published_at", "f.language", F.size(F.filter(body, lambda b: b["type"] == "heading")).cast("long").alias("headings"))


@register("h8_hosts_of_routes", "SELECT page_id, 'live-blog' AS live, 'substack-article' AS letter FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    url, none = F.col("url"), F.lit(None).cast("string")
    live = F.lit("<script>{\"contentType\" :  \"LiveBlog\"}</script>")
    letter = F.lit("<div class='Available-Content'><img src='https://SubstackCDN.com/x.png'>")
    return table(spark, d, "pages").select("page_id", extract.route(U.host(url), live, none, none).alias("live"), extract.route(U.host(url), letter, none, none).alias("letter"))


_JSON = """CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '[' || props || ', ' || value || ']' WHEN 2 THEN '"' || event_type || '"' WHEN 3 THEN CAST(value AS VARCHAR) WHEN 4 THEN CASE WHEN value > 20 THEN 'true' ELSE 'false' END WHEN 5 THEN substr(props, 1, length(props) - 1) ELSE 'null' END"""


@register("n5_json_kinds", f"""SELECT event_id, CASE WHEN json_valid(t) THEN CASE json_type(t) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind FROM (SELECT event_id, {_JSON} AS t FROM events)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What events carry, as it is, within lists, as texts, numbers and truth values, and broken off."""
    k, props, value = F.col("event_id") % 7, F.col("props"), F.col("value").cast("string")
    quoted, cut_off = F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), F.expr("substring(props, 1, length(props) - 1)")
    text = F.when(k == 0, props).when(k == 1, F.concat(F.lit("["), props, F.lit(", "), value, F.lit("]"))).when(k == 2, quoted).when(k == 3, value).when(k == 4, F.when(F.col("value") > 20, "true").otherwise("false")).when(k == 5, cut_off).otherwise("null")
    return table(spark, d, "events").select("event_id", X.json_kind(text).alias("kind"))


@register("b28_parse_outcomes", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS title, CASE WHEN doc_id % 3 = 0 THEN FALSE END AS retryable FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("doc_id") % 3 == 0, 262_200).otherwise(200_000)
    made = lambda title, text: F.struct(F.lit(title).alias("title"), text.alias("text"))
    rows = table(spark, d, "documents").select("doc_id", quality.within_budget(made("new", F.repeat(F.lit("x"), size)), made("old", F.lit(""))).alias("r"))
    return rows.select("doc_id", "r.status", F.col("r.document.title").alias("title"), "r.retryable")


@register("h2_h4_names_and_tokens", "SELECT p_partkey, 'Site ' || p_size AS site, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS author, CAST(len(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4)) AS BIGINT) AS tokens, CAST(1 AS BIGINT) AS overlap, CAST(640 AS INTEGER) AS width, 'a ' || p_partkey AS slug FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    title = F.concat(name, F.lit(" | x – Site "), F.col("p_size").cast("string"))
    by = F.when(F.col("p_partkey") % 3 == 0, "https://a.org/me").otherwise(F.concat(F.lit("By  "), name, F.lit(" | Desk")))
    images = U.srcset(F.concat(F.lit("/a.png 2x, /b-"), key, F.lit(".png 640w")))
    return table(spark, d, "part").select("p_partkey", X.site_of_title(title).alias("site"), X.author_name(by).alias("author"), F.size(X.tokens(name)).cast("long").alias("tokens"), X.token_overlap(F.lit("https://a.org/Some-Wörds"), F.array(F.lit("words"), F.lit("word2"), F.lit("words"))).cast("long").alias("overlap"), F.element_at(images, 2)["width"].alias("width"), U.slug_of_path(F.concat(F.lit("https://x.org/a/"), key, F.lit("/?q"))).alias("slug"))


@register("h6_h7_h9_posts_and_labels", "SELECT event_id, CAST(event_id AS VARCHAR) AS status, 'u' || user_id AS handle, strftime(ts, '%H:%M') || ' UTC' AS label, TRUE AS is_label, event_id % 2 = 0 AS is_date, 'a b|c' AS paragraphs FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://www.X.com/u"), F.col("user_id").cast("string"), F.lit("/status/"), F.col("event_id").cast("string"), F.lit("?s=1"))
    label = X.utc_time_label(F.col("ts"))
    line = F.when(F.col("event_id") % 2 == 0, "Mon 3 May").otherwise("4 May")
    return table(spark, d, "events").select("event_id", U.status_id(url).alias("status"), U.status_handle(url).alias("handle"), label.alias("label"), X.is_time_label(label).alias("is_label"), X.is_date_line(line).alias("is_date"), F.array_join(X.split_paragraphs(F.lit("a\nb\r\n\r\n c ")), "|").alias("paragraphs"))
