"""Main text: pages read by hand, and what a host repeats against brute force."""

import itertools
import random

import pytest

from tidemark.llm.html_text import extract_main_text, read_page

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<!-- <article> --><p>menu</p><p>a b", (["menu", "a b"], False)),
        ("<script>'<article>'</script><p>x", (["x"], False)),
        ("<article></article><p>text</p>", (["text"], False)),
        ("<div role='main'>hello <b>w</b>orld</div><p>x", (["hello world"], True)),
        ("<div role=main>hello</div>", (["hello"], True)),
        ('<article class="post related-topics">body</article><article class="related-post">other</article>', (["body"], True)),
        ('<article class="comment">no</article><article>yes</article>', (["yes"], True)),
        ('<main><ul><li class="share">s<li>real</ul>after</main>', (["real", "after"], True)),
        ('<article><div class="share">x</div><p>one &amp; two<p hidden>no<p>three</article>', (["one & two", "three"], True)),
        ("<table><tr><td class=ad>no<td>yes<tr><td>more</table>", (["yes", "more"], False)),
        ("<nav><p>menu</nav>", ([], False)),
        ('<body><div class="page has-sidebar"><article><p>Main text here.</p></article></div></body>', (["Main text here."], True)),
        ('<div class="site no-sidebar"><article>a b</article></div>', (["a b"], True)),
        ('<div class="article-with-comments"><article>a b</article><div class="comments-area"><p>c</div></div>', (["a b"], True)),
        ('<div class="sidebar"><p>x</p><article>the only article has more words</article></div>', (["the only article has more words"], True)),
        ('<article class="comment-list-post">a b c</article>', (["a b c"], True)),
        ('<p>a page without article, of some words</p><div class="comments"><article class="comment">me too</article></div>', (["a page without article, of some words"], False)),
        ('<form action="/x"><article>a b<button>go</button></article></form>', (["a b"], True)),
        ('<aside><article>teaser in a column</article></aside><p>text', (["text"], False)),
        ('<article><p class="ad-hoc">one</p><div class="share-price-table">two</div><p class="ad">three</p><div id="shareButtons">four</div></article>', (["one", "two"], True)),
        ('<article>the long one of the page, which is its own</article><article>a teaser</article>', (["the long one of the page, which is its own"], True)),
        ("<article>outer <article>inner</article> rest</article>", (["outer", "inner", "rest"], True)),
        ("<header>site</header><article><header><h1>Title</h1></header>text</article>", (["Title", "text"], True)),
        ('<div class="page-header">site</div><ul><li><a href="/a">Menu</a><li><a href="/b">More</a></ul><ul><li>a point with <a>link</a></ul>', (["a point with link"], False)),
    ],
)
def test_read_page(page, want):
    assert read_page(page) == want


def unshared(pages, run):
    """Tokens outside the runs that another page of the host has too."""
    out = {}
    for k, (host, text) in pages.items():
        tokens, gone = text.split(), set()
        others = [t.split() for j, (h, t) in pages.items() if h == host and t != text]
        heads = {tuple(t[i : i + run]) for t in others for i in range(max(1, len(t) - run + 1))}
        for i in range(max(1, len(tokens) - run + 1)):
            if tuple(tokens[i : i + run]) in heads:
                gone |= set(range(i, i + run))
        out[k] = " ".join(t for i, t in enumerate(tokens) if i not in gone)
    return out


def test_runs_that_pages_of_a_host_share(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    boiler = [[word() for _ in range(n)] for n in (8, 9, 20, 7)]
    pages = {}
    for k in range(12):
        parts = [[word() for _ in range(rng.randrange(3, 30))] for _ in range(4)]
        mixed = list(itertools.chain(*[p for pair in itertools.zip_longest(parts, rng.sample(boiler, k % 4), fillvalue=[]) for p in pair]))
        pages[k] = (("one.org", "two.org", "three.org")[0 if k < 2 else 1 if k < 5 else 2], " ".join(mixed))
    rows = [(k, f"https://{h}/{k}", f"<div>{t}</div>") for k, (h, t) in pages.items()]
    # A copy of a page under another address is another page of its host.
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == unshared(pages, 8)
    assert any(got[k] != t for k, (_, t) in pages.items())


def test_blocks_that_articles_of_a_host_share(spark):
    share, passage = "follow us here and there for more of this", "a passage that two articles have in common as it is"
    rows = []
    for k in range(6):
        rows.append((k, f"http://h.org/{k}", f"<article><p>only {k}</p><p>{passage if k < 2 else 'x'}</p><p>{share}</p></article>"))
    # Copies count once, so the host of the copies has two articles only; short blocks and other hosts stay.
    rows += [(10 + k, f"http://copies.org/{k}", f"<article><p>{share}</p><p>the same</p></article>") for k in range(9)]
    rows += [(30, "http://copies.org/x", f"<article><p>{share}</p><p>another</p></article>"), (31, None, f"<article>{share}</article>")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    for k in range(6):
        assert got[k] == f"only {k} {passage if k < 2 else 'x'}"
    assert all(share in got[k] for k in (*range(10, 19), 30, 31))


@pytest.mark.parametrize("articles, gone", [(2, False), (3, True), (4, True), (5, True)])
def test_a_footer_in_every_article_of_a_small_host(spark, articles, gone):
    footer = "this is the footer paragraph of the host that all its articles have"
    rows = [(k, f"http://h.org/{k}", f"<article><p>{' '.join(f'word{k}x{j}' for j in range(30))}</p><p>{footer}</p></article>") for k in range(articles)]
    assert {footer in r.text for r in extract_main_text(spark.createDataFrame(rows, PAGE)).collect()} == {not gone}


def test_near_copies_keep_what_they_share(spark):
    same = "".join(f"<p>{' '.join(f's{j}x{k}' for k in range(20))}</p>" for j in range(9))
    rows = [(k, f"http://h.org/{k}", f"<article>{same}<p>only {k}</p></article>") for k in range(6)]
    assert {r.n_chars > 500 for r in extract_main_text(spark.createDataFrame(rows, PAGE)).collect()} == {True}


def test_long_marked_page(spark):
    long_ = " ".join(f"t{k}" for k in range(100_000))
    rows = [(1, "http://a.b/", f"<article><p>{long_}</article>"), (1, "http://a.b/", f"<article><p>{long_}</article>"), (2, "http://a.b/2", "<main></main>")]
    got = sorted((r.page_id, r.n_chars) for r in extract_main_text(spark.createDataFrame(rows, PAGE + "")).collect())
    assert got == [(1, len(long_)), (1, len(long_)), (2, 0)]
