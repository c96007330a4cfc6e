"""Live blogs from elements, from data, with key events."""

import json

from pyspark.sql import functions as F

from tidemark.operators import extract, live, tree

LONG = "Something happened here that takes more than eighty characters to be told in full, as it must be."


def read(spark, pages):
    frame = spark.createDataFrame(pages, "page_id long, html string")
    nodes = tree.tree_rows(frame)
    seen = frame.select("page_id", extract.read_html(F.col("html")).alias("page")).withColumn("title", F.lit("The day"))
    return nodes, seen, {r.page_id: r for r in live.read_live_blogs(seen, nodes).collect()}


def update(k, head=True, extra=""):
    header = f'<header><time datetime="2024-03-05T09:{k:02d}:00Z">{k} minutes ago</time> <img alt="Ann Other"><span>09.{k:02d} CET</span></header>' if head else ""
    return f'<article class="block">{header}<h2>Title {k}</h2><p>{LONG} {k}</p><p>Follow us</p><figure><img src="/x.png"><figcaption>cap</figcaption></figure>{extra}</article>'


def test_updates_of_a_page(spark):
    blog = f'<div id="liveblog-body">{"".join(update(k) for k in range(8))}<article class="other"><p>{LONG}</p></article><article class="block">short</article></div>'
    plain = f'<section class="liveblog-body"><article><p>{LONG} a</p></article><div>between</div><article><p>{LONG} b</p><aside><p>noise</p></aside></article></section>'
    nodes, _, got = read(spark, [(1, blog), (2, plain), (3, "<p>none</p>"), (4, None), (5, '<div id="liveblog-body"><p>no updates</p></div>')])
    rows = live.page_updates(nodes).filter("page_id = 1").orderBy("place").collect()
    assert [(r.place, r.heading, r.title, r.author) for r in rows] == [(k + 1, f"09.{k:02d} CET | Ann Other", f"Title {k}", "Ann Other") for k in range(6)]
    assert [b.text for b in rows[0].blocks] == ["Title 0", f"{LONG} 0"]
    assert set(got) == {1, 2} and got[1].updates == 6 and got[1].blocks[0].text == "Latest updates"
    assert [b.text for b in got[2].blocks] == ["Latest updates", f"{LONG} a", f"{LONG} b"]


def test_updates_of_data_and_key_events(spark):
    data = {"@type": "LiveBlogPosting", "headline": "The day", "liveBlogUpdate": [{"headline": "The day", "articleBody": f"One.\n\n{LONG}", "author": [{"name": "Ann"}, {"name": "Bo"}], "datePublished": "2024-03-05T09:30:00+00:00"}, {"name": "Second", "description": f"<p>{LONG}</p><p>Share</p><img src=x>"}, {"headline": "Empty"}]}
    event = {"keyEvents": [{"title": "Other", "attributes": {"keyEvent": True}, "elements": [{"html": "<p>no</p>"}]}, {"title": "So far", "attributes": {"summary": True}, "elements": [{"html": "<ul><li>One</li><li>Two</li></ul>"}, {"html": "<p>Three</p>"}]}]}
    island = "<gu-island name='KeyEventsCarousel' props='" + json.dumps(event).replace("'", "&#39;").replace("<", "&lt;") + "'></gu-island>"
    page = f"<script type='application/ld+json'>{json.dumps(data)}</script>{island}"
    both = f"{page}<div id='liveblog-body'>{update(1)}{update(2)}{update(3)}</div>"
    _, seen, got = read(spark, [(1, page), (2, both)])
    rows = live.data_updates(seen).filter("page_id = 1").orderBy("place").collect()
    assert [(r.place, r.heading, r.title, r.author, len(r.blocks)) for r in rows] == [(1, "09:30 UTC | Ann and others", None, "Ann and others", 2), (2, "Second", "Second", None, 1)]
    assert (got[1].source, got[2].source) == ("jsonld-liveblog-updates", "dom-liveblog-root")
    assert [b.text or b["items"] for b in got[1].blocks][:5] == ["Key events", "So far", ["One", "Two"], "Three", "Latest updates"]


def test_names_of_persons(spark):
    texts = ["Ann Other", "ann other", "Mon 3", "Share", "09:30 UTC", "J. O'Neil-Smith", "A B C D E F", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(live.person(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["Ann Other", None, None, None, None, "J. O'Neil-Smith", None, None]
