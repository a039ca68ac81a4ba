"""Main text: single pages, the style tree by hand, entropies, awkward rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tagweave.llm import extract
from tagweave.llm.dom import Page, text_of
from tagweave.llm.extract import host_of, importance, main_text, parsed

PAGES = {
    "<p>a<p>b</p>c": "a\nb\nc",
    "<article><h1>T</h1><p><b>x\n y<br><p>z &amp; &lt;w&gt; &copy &am</article><footer>f</footer>": "T\nx y\nz & <w> © &am",
    '<nav><a href="/">Menu</a></nav><div class="ad">buy</div><p>text</p>': "text",
    "<script>var t='</p>';</script><style>p{}</style><title>t</title>body<!-- c --><form>q<input></form>": "body",
    '<main><p>in</p></main><p>out</p><section id="comments"><p>me too</p></section>': "in",
    '<article><p>a</p><div class="comments"><article class="comment"><p>no</p></article></div></article>': "a",
    "<ul><li>one<li>two</ul><table><tr><td>c<td>d</table>": "one\ntwo\nc\nd",
    "<p>cut off &am": "cut off &am",
    "<p>a<b": "a",
    "</div></p>x</b>": "x",
    "": "",
    "plain": "plain",
    '<aside>s</aside><header>h</header><article><header><h1>T</h1></header>b</article>': "T\nb",
    "a&nbsp;&nbsp;b&#233;&#x41;": "a béA",
}


@pytest.mark.parametrize("html", PAGES)
def test_pages(html):
    assert text_of(Page(html).pieces) == PAGES[html]


def test_deep_and_long_pages():
    assert text_of(Page("<div>" * 20_000 + "x" + "</div>" * 20_000).pieces) == "x"
    assert text_of(Page("<p>w</p>" * 30_000).pieces).count("\n") == 29_999
    assert text_of(Page("<p>" + "word " * 400_000).pieces).count(" ") == 399_999


def test_host(spark):
    urls = ["http://A.example.com/x?y=http://b", "https://u:p@h.example:80", "h.example/x", None, "", "ftp://é/"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string").select(host_of(F.col("url")).alias("h"))
    assert [r.h for r in frame.collect()] == ["a.example.com", "h.example", None, None, None, "é"]


def site(i, text, box="Follow us"):
    return f'<body><div class="top">{box}</div><div class="text"><p>{text}</p></div><div class="n{i % 2}">by line {i % 2}</div></body>'


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_importance_by_hand(spark):
    """Ten pages: a box with one text and one link, texts that five pages share by twos, lists of two layouts."""
    link = '<div class="top">Follow <a href="/us">us</a> here <img src="i"></div>'
    rows = []
    for i in range(10):
        items = "<b class=x>y</b>" if i < 5 else "<b class=x>y</b><i class=z>y</i>"
        rows.append((i, "http://h.example/", f'{link}<div class="text">t{i % 5} is it now</div><ul>{items}</ul>'))
    rows.append((99, "http://h.example/2", rows[0][2]))
    got = sorted((r.n_pages, round(r.importance, 6)) for r in importance(parsed(frame(spark, rows))).collect())
    half = math.log(2) / math.log(10)
    # windows "t0 is it" on two pages each, "is it now" on all; the list has two layouts on five pages each
    text = ((1 - half) * 10 + 0 * 10) / 20
    assert got == sorted([(10, 0.0), (10, round(text, 6)), (10, round(half, 6)), (10, 0.0), (5, 0.0)])


def test_menus_notices_and_adverts_of_any_name_go_by_the_tree(spark):
    """One link of the menu, the date of the notice and the offer of the advert change; the bio does not."""
    rows = []
    for i in range(60):
        links = [f'<li class="q{j % 2}"><a href="/s{j}">Section {j}</a></li>' for j in range(9)]
        menu = f'<ul class="k1">{"".join(links)}<li class="q1"><a href="/p{i}">Latest {i}</a></li></ul>'
        notice = f'<div class="zz7">We have changed our terms of use as of last week {i % 3}, please read them with care</div>'
        advert = f'<section id="m{i % 2}"><p>Buy one of {("red", "blue", "green")[i % 3]} lamps today and get another one free</p></section>'
        body = f'<div class="w"><h1>Title {i}</h1><p>{" ".join(f"word{i * 31 + j * j}" for j in range(40))}</p></div>'
        rows.append((i, "http://h.example/", f"<body>{menu}{advert}{body}{notice}</body>"))
    got = {r.page_id: r.text for r in main_text(frame(spark, rows)).collect()}
    for i in range(60):
        assert got[i].startswith(f"Title {i}\nword{i * 31} ") and got[i].count("\n") == 1 and "Section" not in got[i]


def test_site_boxes_go(spark):
    rows = [(i, "http://h.example/", site(i, f"text number {i}")) for i in range(40)]
    copies = [(100 + i, "http://h.example/c", rows[0][2]) for i in range(60)]
    alone = [(900, "http://other.example/", site(0, "alone")), (901, None, site(1, "no host")), (902, "x", None), (None, "http://h.example/", "")]
    pages = frame(spark, rows + copies + alone).withColumns({"low": F.lit(1), "host": F.lit("x"), "text": F.lit("y")})
    got = {r.page_id: r for r in main_text(pages).collect()}
    assert len(got) == len(rows + copies + alone)
    for i in range(40):
        assert got[i].text == f"text number {i}"
    assert got[100].text == "text number 0"
    assert got[900].text == "Follow us\nalone\nby line 0" and got[901].text == "Follow us\nno host\nby line 1"
    assert got[902].text == got[None].text == "" and got[902].n_chars == 0 and got[0].url == "http://h.example/"


def test_an_article_that_a_site_repeats_stays(spark):
    rows = [(i, "http://h.example/", f"<nav>{i}</nav><article><h1>T</h1><p>one text</p><div class='bio'>bio</div></article><i>{i}</i>") for i in range(30)]
    rows += [(100 + i, "http://h.example/", f"<article><h1>T{i}</h1><p>text {i}</p><div class='bio'>bio</div></article>") for i in range(30)]
    got = {r.page_id: r.text for r in main_text(frame(spark, rows)).collect()}
    assert got[0] == "T\none text" and got[105] == "T5\ntext 5"


def test_empty(spark):
    assert main_text(frame(spark, [])).collect() == []


def test_a_box_on_few_pages_of_a_large_host_goes(spark):
    box = '<div class="teaser">Read this</div>'
    rows = [(i, "http://h.example/", f"<body><div class='text'><p>text {i}</p></div>{box if i < 8 else ''}</body>") for i in range(1_000)]
    rows += [(2_000 + i, "http://h.example/c", rows[0][2]) for i in range(3)] + [(3_000, None, rows[0][2])]
    rows += [(4_000 + i, "http://other.example/", site(i, f"text number {i}")) for i in range(10)]
    got = {r.page_id: r.text for r in main_text(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i] == f"text {i}" for i in range(1_000))
    assert got[2_000] == got[2_002] == "text 0" and got[3_000] == "text 0\nRead this"
    assert all(got[4_000 + i].startswith(f"text number {i}") and "Follow" not in got[4_000 + i] for i in range(10))
