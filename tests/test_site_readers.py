"""Readers of newsletters, the front-loaded news site and archived copies, on small pages."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extract, site_readers, tree

SENTENCE = "This sentence stands in the body of the article and is long enough to count as a real one, which it is."


def blocks(spark, rows, **facts):
    known = {"title": "The Title", "excerpt": "What it says", "author": "Ann Other", "published_at": "2024-03-05T10:00:00Z"} | facts
    items = [{"type": t, "text": x if t != "image" else None, "caption": x if t == "image" else None, "url": "/i.png" if t == "image" else None} for t, x in rows]
    schema = "key long, " + ", ".join(f"{k} string" for k in known) + ", blocks array<struct<type:string,level:int,text:string,style:string,items:array<string>,language:string,url:string,alt:string,caption:string,post_id:string,author_handle:string,display_name:string,published_at:string,media:array<struct<kind:string,url:string,alt:string>>>>"
    full = [tuple(i.get(n) for n in ("type", "level", "text", "style", "items", "language", "url", "alt", "caption", "post_id", "author_handle", "display_name", "published_at", "media")) for i in items]
    return spark.createDataFrame([(1, *known.values(), full)], schema)


def test_letters_are_cleaned(spark):
    caption = "A caption that is long enough to be kept as a paragraph"
    rows = [("heading", "THE TITLE!"), ("paragraph", "Ann Other"), ("paragraph", "Mar 5, 2024"), ("image", "short"), ("paragraph", SENTENCE), ("image", caption), ("paragraph", "Subscribe now"), ("paragraph", "Subscribe nowhere"), ("paragraph", "What it says."), ("paragraph", "Written on March 5, 2024 by many hands of the house and more"), ("paragraph", "Comments")]
    r = site_readers.clean_letters(blocks(spark, rows), ["key"]).collect()[0]
    assert [b.text for b in r.blocks] == [SENTENCE, caption, "Subscribe nowhere"]
    assert (r.front, r.boilerplate, r.images, r.captions) == (5, 2, 2, 1)


def test_news_lose_front_matter_until_the_first_long_paragraph(spark):
    rows = [("heading", "The Title"), ("paragraph", "Photo: someone"), ("paragraph", "Ann Other"), ("paragraph", "March 5, 2024 at 9 AM UTC"), ("paragraph", "Opinion"), ("paragraph", SENTENCE), ("paragraph", "Ann Other"), ("paragraph", "Source: them"), ("image", "x"), ("paragraph", "Sign up for our newsletter"), ("quote", "Short."), ("paragraph", "Up next: more")]
    r = site_readers.clean_news(blocks(spark, rows), ["key"]).collect()[0]
    assert [b.text for b in r.blocks] == [SENTENCE, "Ann Other", "Source: them", "Short."]
    assert (r.boilerplate, r.duplicates, r.images) == (6, 1, 1)


def test_candidates_without_facts_lose_nothing_for_it(spark):
    none = dict.fromkeys(("title", "excerpt", "author", "published_at"))
    for clean in (site_readers.clean_letters, site_readers.clean_news):
        r = clean(blocks(spark, [("paragraph", SENTENCE), ("paragraph", "Short.")], **none), ["key"]).collect()[0]
        assert [b.text for b in r.blocks] == [SENTENCE, "Short."]


@pytest.mark.parametrize("text, want", [("a b.\n\nc d", ["a b.", "c d"]), ("", []), (None, []), ("One. Two! Three", ["One. Two! Three"]), (f"{SENTENCE} " * 8, [" ".join([SENTENCE] * 4)] * 2)])
def test_paragraphs_of_one_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(site_readers.body_paragraphs(F.col("t"))).collect()[0][0] == want


def letter(body_html, dom, **post):
    data = json.dumps(json.dumps({"post": {"title": 'A "quoted" \\ title (really)")', "body_html": body_html, "publishedBylines": [{"name": "Ann"}, {"name": "Bo"}], "cover_image": "https://c.org/logo.png"} | post, "pub": {"name": "Daily", "logo_url": "https://c.org/logo.png"}}))
    return f"<html><head><title>t</title><script>window._preloads = JSON.parse({data})</script></head><body><article class='newsletter-post post'>{dom}</article></body></html>"


def test_letters_from_payload_and_page(spark):
    long = "".join(f"<p>{SENTENCE} {k}</p>" for k in range(20))
    odd = "<p>He said (\\\"so\\\") and \\ back; \\u00e9 and \"quotes\") end.</p>"
    pages = [
        (1, letter(long + odd, f"<div class='body markup'>{long}</div>")),
        (2, letter("", f"<div class='available-content'><div class='body markup'>{long}<div class='subscription-widget'><p>Pay</p></div></div></div>")),
        (3, "<p>no letter</p>"),
        (4, "<script>window._preloads = JSON.parse(\"broken\")</script><div class='markup body'>short</div>"),
        (5, None),
        (6, letter(f"<p>{'x' * 200_000} \\\" </p>" * 2, "")),
    ]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    meta = frame.select("page_id", "html", extract.metadata(extract.read_html(F.col("html"))).alias("meta"))
    found = site_readers.letter_candidates(meta, tree.tree_rows(frame))
    got = {(r.page_id, r.source): r for r in found.collect()}
    assert set(got) == {(1, "payload-body-html"), (1, "dom-body-root"), (2, "dom-body-root"), (6, "payload-body-html")}
    assert got[1, "payload-body-html"].title == 'A "quoted" \\ title (really)")' and got[1, "payload-body-html"].author == "Ann, Bo" and got[1, "payload-body-html"].cover is None
    assert got[1, "payload-body-html"].blocks[-1].text == 'He said (\\"so\\") and \\ back; \\u00e9 and "quotes") end.'
    best = {r.page_id: r for r in site_readers.read_letters(found).collect()}
    assert best[1].source == "payload-body-html" and len(best[1].blocks) == 21 and best[2].source == "dom-body-root" and len(best[2].blocks) == 20


def test_news_from_page_and_data(spark):
    body = "".join(f"<p>{SENTENCE} {k}</p>" for k in range(6))
    ld = json.dumps({"@type": "NewsArticle", "headline": "H", "description": "About it", "articleBody": f"{SENTENCE}\n\nOther {SENTENCE}"})
    pages = [
        (1, f"<article><header><h1>The Title</h1><p>A lede that is longer than forty characters, surely.</p></header><div class='story-body wide'>{body}<button>Share</button><aside>{body}</aside><div><h3>Up Next</h3><p>Other story</p></div></div></article>"),
        (2, f"<script type='application/ld+json'>{ld}</script><p>page</p>"),
        (3, "<p>nothing</p>"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    read = frame.select("page_id", extract.read_html(F.col("html")).alias("page")).withColumn("meta", extract.metadata(F.col("page")))
    got = {r.page_id: r for r in site_readers.read_news(site_readers.news_candidates(read, tree.tree_rows(frame))).collect()}
    assert {k: (r.source, len(r.blocks)) for k, r in got.items()} == {1: ("dom", 6), 2: ("jsonld", 2)}
    assert got[1].title == "The Title" and got[1].excerpt.startswith("A lede")


ARCHIVED = f"""<title>The story - The Paper</title><div id="that-jump-content--default"></div><main>
<article><h1>More from the paper</h1><p>{SENTENCE * 9}</p><time datetime="2024-01-01">x</time></article>
<article><header><h1>The story</h1><p>What the story is about, said in more than forty characters.</p></header>
<div><a rel="author">Ann Other</a> <time datetime="2024-03-05">March 5</time></div><img src="/c.png">
<div class="text"><p>{SENTENCE} one</p><p>{SENTENCE} two</p><p>{SENTENCE} three</p><p>{SENTENCE} four</p><p>{SENTENCE} five</p><button><img src="/big.png"></button><button>Like</button>
<div><form><input type="email"></form>Subscribe to our newsletter</div><p style="display:none">unseen</p><p>Read more here</p></div>
<section><h3>Related stories</h3><ul><li><a href="/x">Other</a></li></ul></section><article><h1>Nested</h1><p>{SENTENCE}</p></article></article></main><article><h1>Elsewhere</h1><p>{SENTENCE * 20}</p><time datetime="2024-01-01">x</time></article>"""


def test_archived_articles(spark):
    pages = [(1, "https://www.paper.example/a", ARCHIVED), (2, None, f"<article><h1>One</h1>{SENTENCE}</article><article><h1>Two</h1><p>{SENTENCE * 2}</p></article>"), (3, "x", "<article>no title</article>"), (4, "x", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    nodes = tree.tree_rows(frame)
    articles = site_readers.archived_articles(nodes)
    got = {r.page_id: r for r in articles.collect()}
    assert {k: r.title for k, r in got.items()} == {1: "The story", 2: "Two"}
    r = got[1]
    assert (r.author, r.published_at, r.cover, r.description) == ("Ann Other", "2024-03-05", "/c.png", "What the story is about, said in more than forty characters.")
    kept = {r.page_id: r.blocks for r in site_readers.archived_blocks(nodes, articles).collect()}[1]
    assert [b.text or b.url for b in kept] == ["The story", r.description, "/c.png", *(f"{SENTENCE} {k}" for k in ("one", "two", "three", "four", "five")), "/big.png"]
    best = {r.page_id: r for r in site_readers.read_archived(frame).collect()}
    assert best[1].strategy == "generic" and best[1].site_name == "The Paper" and best[1].author == "Ann Other"
    news = frame.filter("page_id = 1").withColumn("url", F.lit("https://www.bloomberg.com/news/x"))
    assert site_readers.read_archived(news).collect()[0].strategy == "news"


def test_letters_cut_at_a_space(spark, tmp_path):
    import duckdb

    from tests.compare import same
    from tidemark.plans import ENTRIES

    rows = [(k, f"{'abc ' * k}{SENTENCE} " * 60) for k in range(8)] + [(8, "wxyz " * 900 + "\n" + "abc " * 1100), (9, "Short.\n" + "x" * 3999 + " y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(ENTRIES["b14_letters"].run(spark, str(tmp_path)), con, ENTRIES["b14_letters"].sql)


def _pages(spark, folder, pages):
    import duckdb

    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    return con


#: A title that was cut within a reference, and references with and without semicolons.
CUT_REFERENCE = f"""<html><head><title>A token = &quot</title></head><body><article><h1>A token = &quot</h1><p>A token = &quot;9c44&quot; &amp; more &amp so {SENTENCE}</p>
<p>&copy 2024 &middot {SENTENCE * 4}</p><p>{SENTENCE * 4}</p></article><footer>&copy; x &middot; y</footer></body></html>"""


def test_archived_references_without_semicolons(spark, tmp_path):
    from tests.compare import same
    from tidemark.plans import ENTRIES

    con = _pages(spark, tmp_path, [(1, CUT_REFERENCE)])
    same(ENTRIES["b17_archived_articles"].run(spark, str(tmp_path)), con, ENTRIES["b17_archived_articles"].sql)
    rows = tree.read_tree('<a href="/x?a=1&amp;b=2" alt="&quot;">&amp &ampx &quot;q&quot; &quot &nosuch;</a>')
    assert (dict(rows[0][5]), rows[0][8]) == ({"href": "/x?a=1&b=2", "alt": '"'}, '& &x "q" &quot &nosuch;')


def test_dense_references_without_semicolons(spark, tmp_path):
    from tests.compare import same
    from tidemark.plans import ENTRIES

    con = _pages(spark, tmp_path, [(1, CUT_REFERENCE)])
    for name in ("b24_dense_containers", "b24_container_texts"):
        same(ENTRIES[name].run(spark, str(tmp_path)), con, ENTRIES[name].sql)
    con.execute(f"CREATE TABLE dense AS {ENTRIES['b24_dense_containers'].sql}")
    assert con.execute("SELECT count(*) FROM dense").fetchall() == [(1,)]


def test_news_are_read_whole(spark, tmp_path):
    from tests.compare import same
    from tidemark.plans import ENTRIES

    page = lambda parts: f"<html><head><title>The story</title></head><body><article><h1>The story</h1>{''.join(f'<p>{p}</p>' for p in parts)}</article></body></html>"
    many = [f"{SENTENCE} {SENTENCE} {k}" for k in range(200)]
    long_ = f"{SENTENCE} " * 400
    con = _pages(spark, tmp_path, [(1, page(many)), (2, page([long_ + "its end", "Sign up for it, " + "x" * 300, "Last"])), (3, page([SENTENCE] * 5))])
    out = ENTRIES["b15_news_articles"].run(spark, str(tmp_path))
    same(out, con, ENTRIES["b15_news_articles"].sql)
    assert {r.page_id: r.blocks for r in out.collect()} == {1: 200, 2: 2, 3: 5}
    items = "".join(f"<li>{k} {'y' * 600}</li>" for k in range(60))
    frame = spark.createDataFrame([(4, page([long_]).replace("</article>", f"<ul>{items}</ul></article>"))], "page_id long, html string")
    read = frame.select("page_id", extract.read_html(F.col("html")).alias("page")).withColumn("meta", extract.metadata(F.col("page")))
    blocks = site_readers.read_news(site_readers.news_candidates(read, tree.tree_rows(frame))).collect()[0].blocks
    assert blocks[0].text == long_.strip() and [len(x) for x in blocks[1]["items"]] == [602] * 10 + [603] * 50


def test_letters_are_cleaned_in_one_pass(spark):
    rows = [("heading", "The Title"), ("paragraph", "By hand"), ("paragraph", SENTENCE), ("paragraph", "Subscribe now"), ("image", "A caption that says more than forty characters of text")]
    candidates = blocks(spark, rows, source="dom-body-root", site_name="The Daily", cover="/c.png").unionByName(blocks(spark, [("paragraph", "The Title")], source="payload-body-html", site_name="The Daily", cover="/c.png"))
    out = site_readers.read_letters(candidates, "key")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    (r,) = out.collect()
    assert (r.key, r.source, r.title, r.author, r.site_name, r.cover) == (1, "dom-body-root", "The Title", "Ann Other", "The Daily", "/c.png")
    assert [b.text for b in r.blocks] == ["By hand", SENTENCE, "A caption that says more than forty characters of text"]
