"""Wrappers and the main text of pages of many layouts, well formed or not."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from tidewatch.llm import html_wrappers, queries


def plain_article(page):
    """The article of the given pages, whose layout is known."""
    body = re.search("(?s)<article>(.*?)</article>", page)[1].replace("<br>", " ")
    blocks = (html.unescape(re.sub("<[^>]*>", "", b)).split() for b in re.split("</?(?:p|h1)>", body))
    return "\n".join(" ".join(b) for b in blocks if b)


def test_query_gives_the_articles(spark, folder, monkeypatch):
    monkeypatch.setattr(html_wrappers, "FAN_IN", 2)
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op12_html_extraction(spark, folder).collect()}
    assert got == {r.page_id: (r.url, t := plain_article(r.html), len(t)) for r in pages}


WORDS = [f"word{i}" for i in range(400)]


def sentences(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.randint(15, 60))).capitalize() + "." for _ in range(n)]


def layouts():
    """Functions of (title, paragraphs, rng) that make a page; its text is the title and the paragraphs."""
    few = lambda rng, n: " ".join(rng.choices(WORDS, k=n))

    def semantic(title, ps, rng):
        return f"""<html><head><title>x</title><style>a>b{{}}</style></head><body class="has-sidebar nav-open"><header><h2>Site</h2>
            <form>Search <input></form></header><nav>{few(rng, 5)}</nav><main><article><header><h1>{title}</h1></header>
            {"".join(f"<p>{p}</p>" for p in ps)}<div class="share-buttons">Share {few(rng, 3)}</div></article>
            <section id="comments"><article class="comment"><p>{few(rng, 40)}</p></article></section></main>
            <aside>{few(rng, 30)}</aside><footer>{few(rng, 9)}</footer></body></html>"""

    def divs(title, ps, rng):
        return f"""<body><div id="header">{few(rng, 4)}</div><div class="cookie-notice">{few(rng, 30)} <button>OK</button></div>
            <div class="wrap"><ul class="menu">{"".join(f"<li><a href='/{few(rng, 1)}'>{few(rng, 2)}</a></li>" for _ in range(8))}</ul>
            <div class="post-{rng.randint(1, 9999)}"><h1>{title}</h1>{"".join(f"<p>{p}" for p in ps)}</div>
            <div class="sidebar"><p>{few(rng, 40)}</p></div></div><div class="comment-list"><p>{few(rng, 90)}</p></div>
            <div id="footer"><p>{few(rng, 20)}</p></div>"""

    def bare(title, ps, rng):
        links = "".join(f"<td><a href=/x>{few(rng, 2)}</a></td>" for _ in range(6))
        return f"""<table><tr>{links}</tr></table><div><p>Subscribe to our letters and read all about it every day of the week</p>
            <h1>{title}</h1>{"<br>".join(["", *(f"<p><b>{p}</b></p>" for p in ps)])}</div><p>All rights are with those who wrote this text for us</p>"""

    def boxed(title, ps, rng):
        return f"""<body><div class="page sidebar-left"><div role="banner">{few(rng, 9)}</div><article><div class="ad">{few(rng, 20)}</div>
            <h1>{title}</h1><!-- <p>{few(rng, 9)}</p> -->{"".join(f"<div><span>{p}</span></div>" for p in ps)}
            <script>document.write("<p>{few(rng, 9)}</p>")</script></article></div><div hidden>{few(rng, 9)}</div>"""

    return {"semantic": semantic, "divs": divs, "bare": bare, "boxed": boxed}


@pytest.mark.parametrize("name", layouts())
def test_layouts(spark, name):
    rng = random.Random(name)
    rows, wanted = [], {}
    for i in range(12):
        title, *ps = sentences(rng, rng.randint(3, 9))
        rows.append((i, f"https://{name}.example.org/{i}", layouts()[name](title, ps, rng)))
        wanted[i] = "\n".join([title, *ps])
    found = html_wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == wanted


def test_expressions_have_groups_options_and_slots():
    pages = [
        "<body><h1>A</h1><ul><li>a<li>b</ul><p>one</p><p>two</p><footer>same</footer>",
        "<body><h1>B</h1><ul><li>a<li>c<li>d</ul><p>three</p><footer>same</footer>",
        "<body><h1>C</h1><div>x</div><ul><li>a<li>b</ul><footer>same</footer>",
    ]
    places = []
    for page in pages:
        read = html_wrappers.Page(page).places
        places = html_wrappers.together(places, read) if places else read
    assert html_wrappers.expression(places) == (
        '<body><h1>#</h1>(<div>"</div>)?<ul>(<li>#</li>)+</ul>(<p>#</p>)*<footer>"</footer></body>'
    )
    repeated = html_wrappers.Page("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>").places
    assert html_wrappers.expression(repeated) == "<dl>(<dt>#</dt>)+(<dd>#</dd>)+</dl>"


def test_references_spaces_and_odd_markup():
    text = lambda page: html_wrappers.main_text(page, [])
    assert text("<article><p>a &amp;amp; b&nbsp;&eacute;&#233;  \n c<br>d<p>e <b>f</article>g") == "a &amp; b éé c d\ne f"
    assert text('<p title="a > b" data-x=\'>\'>x</p>1 < 2 <3 &lt;b&gt;') == "x\n1 < 2 <3 <b>"
    assert text("<p>a<script>if (x) '</p><p>no'</script>b<style>c</style></p><p>d <!-- e") == "ab\nd <!-- e"
    assert text("") == text("<nav>x</nav>") == ""


def test_repeated_pages_and_a_hot_host_keep_their_text(spark):
    rng = random.Random(3)
    one = layouts()["bare"]("Title", sentences(rng, 4), rng)
    rows = [(i, "http://h/1", one) for i in range(60)] + [(100 + i, "http://h/2", layouts()["bare"](*(lambda t, *p: (t, p))(*sentences(rng, 4)), rng)) for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    texts = {r.page_id: r.text for r in html_wrappers.extracted(frame).collect()}
    assert len({texts[i] for i in range(60)}) == 1 and texts[0].count("\n") >= 4


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, host string, wrapper string, n_chars string"
    rows = [(1, None, None), (None, "http://a/", "<p>x</p>"), (None, "http://a/", "<p>x</p>"), (2, "no url", ""), (3, "http://[", "plain")]
    frame = spark.createDataFrame([(*r, "t", "h", "w", "n") for r in rows], schema)
    got = sorted(map(str, ((r.page_id, r.url, r.text) for r in html_wrappers.extracted(frame).collect())))
    assert got == sorted(map(str, [(1, None, ""), (None, "http://a/", "x"), (None, "http://a/", "x"), (2, "no url", ""), (3, "http://[", "plain")]))
    assert html_wrappers.extracted(frame.limit(0)).collect() == []


@pytest.mark.parametrize("part", ["<!--", '<a "', "<script>", "<div>", "<", " ", "<b>", "<p>x", "</p>", "<div><p><span>x", "&", "<li>", "<h1>a<p>b<ul>", "<a href='"])
def test_a_megabyte_of_bad_markup(part):
    page = part * (1_000_000 // len(part))
    begun = time.monotonic()
    html_wrappers.main_text(page, [])
    assert time.monotonic() - begun < 10
    assert len(page) > 900_000
