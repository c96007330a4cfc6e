import struct

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import blocks as B
from tidemark.operators import extract, feeds, queues, reader, topics


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_canonical_urls(spark):
    cases = {
        "Example.com/a?utm_source=x&b=2&gclid=1#top": "https://example.com/a?b=2",
        "http://example.com:80": "http://example.com/",
        "https://example.com:8443/": None,
        "https://me@example.com/": None,
        "ftp://example.com/": None,
        "  ": None,
        "HTTPS://EXAMPLE.com/Path/?utmost=1": "https://example.com/Path/?utmost=1",
    }
    assert {k: one(spark, k, U.canonical_url) for k in cases} == cases
    assert one(spark, "https://medium.com/x", U.source_root) is None


def test_slugs_and_words(spark):
    assert one(spark, "  Deep--Learning_& AI! ", X.tag_slug) == "deep-learning-ai"
    assert one(spark, "!!", X.tag_slug) is None and one(spark, "x" * 64, X.tag_slug) is None
    assert one(spark, "deep-learning", X.humanized) == "Deep Learning"
    assert one(spark, "Wed, 02 Oct 2002 15:00:00 GMT", X.feed_date) is not None
    assert one(spark, "<p>a <b>b</b></p>", X.without_markup) == "a b"


def test_html_to_blocks(spark):
    page = '<title>T</title><meta property="og:title" content="Title"><nav>menu</nav><article><h1>Title</h1><p>One <b>two</b><p>Three<ul><li>a<li>b</ul><pre>x\n  y</pre><img src="i.png" alt="pic"></article><script>var t="</p>";</script>'
    got = spark.createDataFrame([(page,)], "v string").select(extract.read_html(F.col("v")).alias("p")).select("p.blocks", extract.metadata(F.col("p")).alias("m")).first()
    assert [(b.type, b.text or b["items"] or b.url) for b in got.blocks] == [("heading", "Title"), ("paragraph", "One two"), ("paragraph", "Three"), ("list", ["a", "b"]), ("code", "x\n  y"), ("image", "i.png")]
    assert got.m.title == "Title"


def test_markdown_to_blocks(spark):
    text = "---\ntitle: x\n---\n# Head #\n\npara *one*\nmore [link](http://a)\n\n- a\n- b\n  b2\n\n1. c\n\n> q\n\n```py\nx = 1\n```\n---\n"
    got = one(spark, text, extract.read_markdown)
    assert [(b.type, b.text or b["items"]) for b in got] == [("heading", "Head"), ("paragraph", "para one more link"), ("list", ["a", "b b2"]), ("list", ["c"]), ("quote", "q"), ("code", "x = 1")]


def test_blocks_are_bounded(spark):
    many = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: B.block(type=F.lit("paragraph"), text=F.when(k == 1, "").otherwise("x")))
    assert spark.range(1).select(F.size(B.sanitized(many))).first()[0] == 127


def test_feeds(spark):
    rss = "<rss><channel><title>F</title><item><title>a</title><link>http://x/1</link></item><item><guid>g</guid><link>http://x/2</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><id>e</id><link href="http://x/3"/><updated>2024-01-01</updated></entry></feed>'
    assert [e.entry_key for e in one(spark, rss, feeds.read_feed).entries] == ["http://x/1#0", "g"]
    assert [(e.entry_key, e.url) for e in one(spark, atom, feeds.read_feed).entries] == [("e", "http://x/3")]
    assert one(spark, "<rss", feeds.read_feed).kind is None


def test_reading_units_and_package(spark):
    docs = spark.createDataFrame([(1, ["Hello, world -- again.", "The U.S. state-of-the-art-technology-thing!"])], "k long, lines array<string>")
    units = reader.reading_units(docs, "k", "lines").orderBy("place").collect()
    assert [u.display for u in units] == ["Hello,", "world", "again.", "The", "U.S.", "state-of-the-art-", "technology-thing!"]
    assert [u.clause_pause for u in units] == [True, False, False, False, False, False, False]
    assert [u.sentence_pause for u in units] == [False, False, True, False, False, False, True]  # U.S. is an abbreviation
    assert [u.paragraph_start for u in units] == [True, False, False, True, False, False, False] and [k for k, u in enumerate(units) if u.paragraph_end] == [2, 6]
    raw = reader.packages(docs.withColumn("t", F.lit(" Über ")).withColumn("r", F.lit(7)), "k", "lines", "t", "r").first().package
    at = 32 + 5
    assert struct.unpack_from("<4sHHHHIIIQ", raw) == (b"MTRP", 1, 0, 5, 2, 7, at, at + 2 * 72, 7)
    assert raw[32:at].decode() == "Über" and len(raw) == at + 2 * 72 + 7 * 40
    assert struct.unpack_from("<IB3x22s", raw, at) == (0, 22, b"Hello, world -- again.")
    assert struct.unpack_from("<IB", raw, at + 72) == (3, 43)
    assert struct.unpack_from("<HBBBBBx6s", raw, at + 2 * 72) == (1, 1, 6, 0, 1 | 4, 6, b"Hello,")
    assert struct.unpack_from("<HBBBBB", raw, at + 2 * 72 + 2 * 40) == (1, 1, 6, 0, 2 | 8, 6)
    assert [r.package for r in reader.packages(docs.select("k", F.array().cast("array<string>").alias("lines")), "k", "lines").collect()] == [None]


def test_topic_cycles(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None)], "id string, parent_id string")
    assert {r.id for r in topics.cycles(rows).collect()} == {"a", "b", "c"}
    fine = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert {tuple(r) for r in topics.closure(fine).collect()} == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def test_a_feed_holds_no_more_than_the_entries_that_count(spark, tmp_path):
    from tidemark.plans import ENTRIES
    from tidemark.plans.service_queries import _feed_xml

    rows = [(k, "text", "en", "one" if k % 300 else "two", 4) for k in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    xml = {r.feed_id: r.xml for r in _feed_xml(spark, str(tmp_path)).collect()}
    assert {k: x.count("<item>") for k, x in xml.items()} == {"one": 100, "two": 3}
    first = sorted(f"<item><guid>{k}</guid>" for k in range(900) if k % 300)[:100]
    keys = {r.entry_key for r in ENTRIES["c2_feed_entries"].run(spark, str(tmp_path)).filter("feed_id = 'one'").collect()}
    assert keys == {x[12:-7] for x in first}


def test_hidden_paragraphs_and_items_end_where_the_next_begins():
    of = lambda page: [(b["type"], b["text"] or b["items"]) for b in extract._read(page)["blocks"]]
    assert of("<p hidden>x</p><p>one</p><p>two</p>") == [("paragraph", "one"), ("paragraph", "two")]
    assert of("<p hidden>x<p>one") == [("paragraph", "one")]
    assert of("<ul><li hidden>x<li>y</ul><p>z") == [("list", ["y"]), ("paragraph", "z")]
    assert of("<div hidden><p>x</p><div>y</div>z</div>end") == [("paragraph", "end")]
    assert of("<nav><ul><li>x</ul></nav><figure><img src=a alt=b><figcaption>said</figcaption></figure>")[0][0] == "image"


def test_json_ld_stands_in_where_the_page_says_nothing(spark):
    page = '<script type="application/ld+json">[{"@graph":[{"@type":"Article","headline":"A"},{"@type":["NewsArticle"],"headline":"H &amp; K","author":{"name":"Ann"},"datePublished":"2024-01-02","image":["i.png"]}]},{"@type":"WebSite","name":"Site"}]</script><script type="application/ld+json">{broken</script>'
    m = spark.createDataFrame([(page,)], "h string").select(extract.metadata(extract.read_html(F.col("h"))).alias("m")).select("m.*").first()
    assert (m.title, m.author, m.published_at, m.cover, m.site_name) == ("H & K", "Ann", "2024-01-02", "i.png", "Site")


def test_candidates_are_cleaned_and_the_same_blocks_count_once(spark):
    said = " ".join(f"word{k}" for k in range(150))
    page = f"<title>T</title><main><article><h1>T</h1><img src=a.png><p>{said}</p><p>{said}, again</p><p>Share this</p><p>Related: x</p></article></main><p>Comments (3)"
    row = spark.createDataFrame([(page,)], "h string").select(extract.read_html(F.col("h")).alias("p"))
    best = row.select(extract.candidates(F.col("p"), extract.metadata(F.col("p"))).alias("c")).first().c
    assert [b.text for b in best[0].blocks] == [said, f"{said}, again"] and len(best) == 1
    # Readable: 28 + 301 words / 45 + 2 paragraphs, a known title, less one title, two texts and an image.
    assert best[0].container == "readable" and abs(best[0].score - (28 + 301 / 45 + 5.2 + 4 - 3 - 12 - 1.5)) < 1e-9


def test_accepted_attempts_count_alone(spark):
    rows = [(k, "a", t) for k, t in enumerate((0, 10, 20, 30, 61, 62, 70, 71))] + [(100, "b", 5), (101, None, 6)]
    tries = spark.createDataFrame(rows, "id long, k string, t long").withColumn("at", F.timestamp_seconds("t"))
    got = {r.id: r.accepted for r in queues.attempts_accepted(tries, "k", "at", 3, 60).collect()}
    # The fourth is refused, and so doesn't keep the fifth out.
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 100: True}
