"""Cover images: candidates, their places, sizes and scores, and addresses resolved."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.urls import resolved
from tidemark.operators.cover import cover_candidates, covers
from tidemark.operators.tree import tree_rows

BASE = "https://site.org/2024/harbour-bridge/opens.html?x=1#top"


def pages(spark, *html, title="Harbour bridge opens", author="Ann Lee", site="The Site"):
    rows = [(k, BASE, h, title, author, site) for k, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, title string, author string, site string")


def candidates(spark, html, **about):
    frame = pages(spark, html, **about)
    return {r.url: r for r in cover_candidates(tree_rows(frame), frame).collect()}


@pytest.mark.parametrize(
    ("href", "whole"),
    [
        ("/a/b.jpg", "https://site.org/a/b.jpg"), ("b.jpg", "https://site.org/2024/harbour-bridge/b.jpg"), ("../b.jpg?q=../c", "https://site.org/2024/b.jpg?q=../c"), ("//cdn.org/x", "https://cdn.org/x"), ("HTTP://o.org", "HTTP://o.org/"),
        ("?y=2", "https://site.org/2024/harbour-bridge/opens.html?y=2"), ("#z", "https://site.org/2024/harbour-bridge/opens.html?x=1#z"), ("data:image/png;base64,x", None), (" ", None), (None, None),
    ],
)
def test_resolved(spark, href, whole):
    assert spark.createDataFrame([(BASE, href)], "b string, h string").select(resolved(F.col("b"), F.col("h")).alias("r")).first().r == whole


def test_places_and_sizes(spark):
    found = candidates(
        spark,
        """<html><head><meta property="og:image" content="/og.jpg"><meta property="og:image" content="/second.jpg"><meta name="twitter:image" content="/tw.jpg"></head><body><img src="/outside.jpg">
        <article><header><img src="/head.jpg" width="1000" height="950" alt="The bridge at night"></header><p>One.</p>
        <figure><picture><source srcset="/p-1600.webp 1600w, /p-800.webp 800w"><img src="/p.jpg" width="640"></picture><figcaption>A long caption of it</figcaption></figure>
        <p>Two.</p><ul><li>x</li></ul><div class="author-avatar"><img src="/who.jpg"></div><p>Four</p><p>Five</p><img data-src="late.jpg"><img src="data:image/gif;base64,AA"></article></body></html>""",
    )
    assert set(found) == {f"https://site.org{p}" for p in ("/og.jpg", "/tw.jpg", "/head.jpg", "/p-1600.webp", "/who.jpg", "/2024/harbour-bridge/late.jpg")}
    by = {u.rsplit("/", 1)[1]: r for u, r in found.items()}
    assert (by["og.jpg"].score, by["tw.jpg"].score) == (34, 30)
    # A header, before all text, large, told of.
    assert by["head.jpg"].found == "article-header" and by["head.jpg"].score == 40 + 12 + 12 + 18 + 5
    # Of a side that is not known the other stands for both.
    assert (by["p-1600.webp"].before, by["p-1600.webp"].width, by["p-1600.webp"].alt, by["p-1600.webp"].score) == (1, 1600, "A long caption of it", 26 + 6 + 18 + 5)
    assert (by["who.jpg"].before, by["who.jpg"].score) == (3, 26 - 6 - 120)
    # Three words of the title and the page's address stand in its own (harbour, bridge, 2024).
    assert (by["late.jpg"].before, by["late.jpg"].score) == (5, 26 - 18 + 6)
    assert by["who.jpg"].hint == "img div.author-avatar article body"


def test_data_images_and_ties(spark):
    best = {"@type": "BlogPosting", "headline": "x", "datePublished": "2024", "image": ["/a.jpg", {"contentUrl": "/b.jpg", "width": "100", "name": "Ann Lee"}, 7, None], "thumbnailUrl": "/a.jpg"}
    page = "<head>" + "".join(f'<script type="application/ld+json">{json.dumps(x)}</script>' for x in ([{"@type": "Article", "image": "/worse.jpg"}], {"@graph": [best, {"@type": "Thing", "image": "/no.jpg"}]})) + '<script type="application/ld+json">{broken</script></head><meta property="og:image" content="/a.jpg">'
    found = {u.rsplit("/", 1)[1]: r for u, r in candidates(spark, page).items()}
    assert set(found) == {"a.jpg", "b.jpg"}
    # The data's record of an address counts more than the head's; it keeps the head's place.
    assert (found["a.jpg"].found, found["a.jpg"].place.source, found["a.jpg"].score) == ("jsonld-image", 0, 42)
    assert found["b.jpg"].score == 42 - 60 - 120


def test_covers_and_odd_pages(spark):
    frame = pages(spark, None, "", "<p>no image", '<article><img src="/small.gif" width="16" height="16"></article>', '<main><img src="/_next/image?url=%2Freal.jpg&w=64"><p>x</p></main>', '<article><img src="/logo.png"><img srcset="/x.jpg 900w" height="900"></article>')
    got = {r.page_id: (r.cover, r.found, r.score) for r in covers(tree_rows(frame), frame).collect()}
    assert got == {4: ("https://site.org/real.jpg", "article-image", 38), 5: ("https://site.org/x.jpg", "article-image", 26 + 12 + 18)}
    assert covers(tree_rows(frame.limit(0)), frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["b11_cover_candidates", "b11_covers"])
def test_numbers_of_pages_and_paths_meet_by_chance(spark, tmp_path, name):
    import duckdb

    from tests.compare import same
    from tidemark.plans import ENTRIES

    html = "<html><head></head><body><article><h1>Title</h1><p>Some words of it.</p></article></body></html>"
    rows = [(k, f"https://site.org/en/{k // 10}?x=1", html) for k in (111790, 111792, 111795, 210)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(ENTRIES[name].run(spark, str(tmp_path)), con, ENTRIES[name].sql)
