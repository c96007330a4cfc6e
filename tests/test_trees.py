"""Pages as trees in rows, dense containers, hard cleaning."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import recover, tree

PAGE = """<html><head><title>A title</title><style>p{}</style><script>var t = "</p>";</script></head><body>
<nav><ul><li><a href="/a">one</a><li><a href="/b">two</a></ul></nav>
<div id=x class="Post newsletter"><p>First <b>bold<br>text</b> here<p>Second &amp; last <button>Press</button> end</div>
<article><h2># Heading ¶</h2><ul><li>item <ul><li>inner</li></ul></li><li>next</li></ul><pre><code class="language-py">a = 1


b</code></pre>
<figure><img src="/i.png" alt="An  image"><figcaption>Its caption</figcaption></figure><span>leaf</span><div hidden><p>unseen</p></div></article>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return tree.tree_rows(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain text"), (5, "<p>a<p>b")], "page_id long, html string")).cache()


def test_rows_are_numbered_in_document_order(nodes):
    rows = nodes.filter("page_id = 1").orderBy("pre").collect()
    assert [r.pre for r in rows] == list(range(len(rows)))
    by_pre = {r.pre: r for r in rows}
    for r in rows:
        assert r.last >= r.pre and (r.parent is None or by_pre[r.parent].pre < r.pre <= r.last <= by_pre[r.parent].last)
    div = next(r for r in rows if r.attrs.get("id") == "x")
    assert (div.length, div.text) == (len("First bold text hereSecond & last Press end"), "First bold text hereSecond & last Press end")
    assert [r.text for r in rows if r.tag == "p"][:2] == ["First bold text here", "Second & last end"]
    assert [r.text for r in rows if r.tag == "li"] == ["one", "two", "item", "inner", "next"]
    assert {r.page_id for r in nodes.select("page_id").distinct().collect()} == {1, 5}


def test_sums_over_subtrees(nodes):
    summed = tree.subtree_sums(nodes.drop("attrs"), "page_id", items=F.col("tag") == "li", chars=F.length("text")).collect()
    rows = nodes.collect()
    assert len(summed) == len(rows)
    for s in summed:
        below = [r for r in rows if r.page_id == s.page_id and s.pre < r.pre <= s.last]
        assert (s["items"], s.chars) == (sum(r.tag == "li" for r in below), sum(len(r.text) for r in below)), s


def test_blocks_of_a_subtree(spark, nodes):
    roots = nodes.filter("tag = 'article' OR page_id = 5 AND pre = 0").select("page_id", F.col("pre").alias("root"), F.col("last").alias("root_last"))
    found = tree.blocks_of(tree.inside(nodes, roots.filter("page_id = 1"), "page_id"), ["page_id", "root"]).collect()[0].blocks
    assert [(b.type, b.text or b.url, b["items"], b.level or b.language or b.caption) for b in found] == [
        ("heading", "Heading", None, 2),
        ("list", None, ["item", "next"], None),
        ("code", "a = 1\n\nb", None, "py"),
        ("image", "/i.png", None, "Its caption"),
        ("paragraph", "leaf", None, None),
    ]


def long_page(extra="", words=60):
    text = " ".join(f"word{k}" for k in range(words))
    return f"<html><head><title>The title.</title></head><body><div class=outer>{extra}<section><h1>“The title”</h1><p>By Somebody</p><p>2024-01-05</p><p>{text} one, and more.</p><p>Short.</p><p>Short.</p><p>{text} one, and more!</p><p>{text} two.</p><div class='related-items'><p>{text} three.</p></div><p>Share this story</p><p>The title</p></section></div></body></html>"


def test_dense_containers_and_their_texts(spark):
    links = "<ul>" + "".join(f"<li><a href=/{k}>{'menu entry ' * 6}{k}</a></li>" for k in range(20)) + "</ul><form><input><button>Go</button></form>"
    pages = spark.createDataFrame([(1, long_page(links)), (2, long_page()), (3, long_page(words=5)), (4, "<div>" * 400 + long_page())], "page_id long, html string")
    nodes = tree.tree_rows(pages)
    found = recover.dense_containers(nodes).orderBy("page_id", "rank").collect()
    assert [(r["rank"], r.tag) for r in found if r.page_id == 2] == [(1, "div"), (2, "section")] and not [r for r in found if r.page_id == 3]
    menu = next(r for r in found if r.page_id == 1 and r.tag == "div")
    assert menu.link_chars > 1200 and menu.controls == 3
    for r in found:
        assert r.score == r.chars + 180 * r.paragraphs - 2 * r.link_chars - 400 * r.controls > 0 and r.chars >= 500
    assert len([r for r in found if r.page_id == 4]) == 6 and all(r.place <= 300 for r in found)
    said = recover.container_blocks(nodes, recover.dense_containers(nodes)).filter("page_id = 2 AND rank = 2")
    known = said.withColumn("title", F.lit("The title")).withColumn("excerpt", F.lit(None).cast("string")).withColumn("author", F.lit("Somebody"))
    texts = [b.text for b in recover.hard_cleaned(known, ["page_id", "rank"]).collect()[0].blocks]
    assert len(texts) == 4 and texts[0].endswith("one, and more.") and texts[1:3] == ["Short.", "Short."] and texts[3].endswith("two.")


def test_recovered_articles(spark):
    pages = spark.createDataFrame([(1, long_page()), (2, "<p>nothing much</p>"), (3, None)], "page_id long, html string")
    got = {r.page_id: r for r in recover.recovered(pages).collect()}
    assert set(got) == {1, 2}
    assert got[1].total >= got[1].quality and not any((b.text or "").startswith(("Share", "By ", "2024")) for b in got[1].blocks)


def test_texts_are_taken_in_bites(spark, monkeypatch):
    from tidemark import runtime

    assert list(runtime.bites([])) == [] and list(runtime.bites([5, None, 7])) == [(0, 3)]
    big = runtime.BITE
    assert list(runtime.bites([5, big, big * 9, None, 1])) == [(0, 2), (2, 3), (3, 5)]
    assert max(b - a for a, b in runtime.bites([0] * 100_000)) <= big // 256


def test_feeds_and_payloads_are_read_in_bites(spark):
    import pandas as pd
    import pyarrow as pa

    from tidemark.operators import feeds, posts

    long = " " * (1 << 20)
    xml = [f"<rss><channel><title>{k}</title></channel></rss>{long}" for k in range(3)] + [None, ""]
    parts = list(feeds._feeds(iter([pd.Series(xml), pd.Series([], dtype=object)])))
    assert [len(p) for p in parts] == [1, 1, 1, 2] and [t for p in parts for t in p["title"]] == ["0", "1", "2", None, None]
    sizes = [len(p) for p in posts._payloads(iter([pa.array([f"[{long}]", None, f"{long}{{}}", "{"]), pa.array([], pa.string())]))]
    assert sizes == [1, 2, 1]


def test_batches_stay_arrow_but_for_a_bite(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from tidemark.operators import extract
    from tidemark.runtime import pieces

    texts = pa.array(["x" * 1000] * 20_000 + [None, ""])
    tracemalloc.start()
    try:
        assert sum(len(p) for p in pieces([texts, texts.slice(0, 0)])) == 20_002
        assert tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()
    monkeypatch.delattr(F, "pandas_udf")  # no Series of a batch is made
    frame = spark.createDataFrame([(1, "<article><p>One</p></article>"), (2, None)], "k long, h string")
    rows = frame.select("k", extract.read_html(F.col("h")).alias("p")).orderBy("k").collect()
    assert [b.text for b in rows[0].p.blocks] == ["One"] and rows[1].p.blocks == [] and rows[1].p.meta == {}


def test_markdown_stays_arrow(spark, monkeypatch):
    from tidemark.operators import extract

    monkeypatch.delattr(F, "pandas_udf")  # no Series of a batch is made
    frame = spark.createDataFrame([(1, "# Head\n\n- a\n- b"), (2, None)], "k long, t string")
    rows = frame.select("k", extract.read_markdown(F.col("t")).alias("m")).orderBy("k").collect()
    assert [(b.type, b.level, b.text, b["items"]) for b in rows[0].m] == [("heading", 1, "Head", None), ("list", None, None, ["a", "b"])] and rows[1].m == []


def test_lines_stay_arrow(spark, monkeypatch):
    import pyarrow as pa

    from tidemark.operators import reader

    lines = pa.array([["x" * (1 << 18), None], None, [], ["y"], ["z" * (1 << 18)]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), lines], ["k", "lines"])
    assert [b.column("k").to_pylist() for b in reader._bites(batch, "lines")] == [[0], [1, 2, 3, 4]]
    assert [b.column("k").to_pylist() for b in reader._bites(batch.slice(1), "lines")] == [[1, 2, 3, 4]]
    monkeypatch.delattr(type(spark.range(0)), "mapInPandas")  # no frame of a batch is made
    frame = spark.createDataFrame([(1, ["One two"]), (2, None)], "k long, lines array<string>")
    assert reader.reading_units(frame, "k", "lines").count() == 2
    assert [r.package is None for r in reader.packages(frame, "k", "lines").orderBy("k").collect()] == [False, True]
