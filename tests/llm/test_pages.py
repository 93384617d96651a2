import html
import re
import time

import pytest

from wardlight.llm import pages

LONG = "Many words of plain prose stand here, one after the other, without any link."


def page(*parts):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"


@pytest.mark.parametrize(
    "text,want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain text", "plain text"),
        ("<p>only", "only"),
        (page("<nav><a href=/>Home</a></nav>", f"<div><p>{LONG}</p><p>Short.</p></div>", "<footer>f</footer>"), f"{LONG}\n\nShort."),
        (page(f"<div class='main-text'><h2>T &amp; U</h2><p>a&nbsp; b<br>c {LONG}</p></div>"), f"T & U\n\na b c {LONG}"),
        (page('<script>var t="</p>";</script>', f"<p>{LONG}", f"<p><b>{LONG}<br><p>x &lt;y&gt;"), f"{LONG}\n\n{LONG}\n\nx <y>"),
        (page(f"<article><header><h1>Top</h1></header><section><p>{LONG}</p></section><section><p>Two</p></section><aside>no</aside></article>"), f"Top\n\n{LONG}\n\nTwo"),
        (page(f"<header>no</header><div id=sidebar>no</div><div class='ad-box'>no</div><article><p>{LONG}</p></article><div class=comments><p>{LONG} no</p></div>"), LONG),
        (page(f"<div role=navigation>no</div><p>{LONG}</p><form><input>no</form><div class='cookie-notice'>no</div>"), LONG),
        (page(f"<table><tr><td>{LONG}<td>2<tr><td>3</table>"), f"{LONG} 2\n\n3"),
        (page(f"<div class='layout with-sidebar'><div class=header>no</div><div class='post'><div class=header>Top</div><p>{LONG}</p></div></div>"), LONG),
        (page(f"<div class='header'>no</div><article><div class='header'>Top</div><p>{LONG}</p><p style='display: none'>no</p></article>"), f"Top\n\n{LONG}"),
        (page(f"<div class='widget-main'><p>{LONG}</p></div>"), LONG),
        (page("<!-- a > b --><p>1 < 2 and", f" 3 > 2 {LONG}</p>"), f"1 < 2 and 3 > 2 {LONG}"),
    ],
)
def test_texts(text, want):
    assert pages.main_text(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        (f'<div class="content-sidebar-left"><article><p>{LONG}</p><p>{LONG}</p></article></div><small>fine print</small>', f"{LONG}\n\n{LONG}"),
        (f'<article><p>{LONG}</p><section class="related-work"><p>Related: {LONG}</p></section></article>', f"{LONG}\n\nRelated: {LONG}"),
        (f"<div class=post><header><h1>Title</h1></header><p>{LONG}</p><p>{LONG}</p></div>", f"Title\n\n{LONG}\n\n{LONG}"),
        (f'<p title="a<b>c">{LONG}</p>', LONG),
        (f"<form><div><p>{LONG}</p><p>{LONG}</p></div><input></form>", f"{LONG}\n\n{LONG}"),
        (f"<p>where <math>x</math> is {LONG}</p>", f"where x is {LONG}"),
        (f"<div><p>{LONG}</p><svg><path d=1><p>two {LONG}</p></div>", f"{LONG}\n\ntwo {LONG}"),
        (f"<div><p>{LONG}</p><textarea><p>two {LONG}</p></div>", f"{LONG}\n\ntwo {LONG}"),
        (f"<fieldset><label>{LONG}</label></fieldset>", LONG),
        (f"<!-- open <p>{LONG}</p>", f"open\n\n{LONG}"),
        (f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><article><p>a reader</p></article><ul><li><a href=1>x</a><li><a href=2>y</a><li><a href=3>z</a></ul></article>", f"{LONG}\n\n{LONG}\n\n{LONG}"),
    ],
)
def test_odd_markup(text, want):
    assert pages.main_text(text) == want


OTHERS = [
    '<section id="comments"><h2>Comments</h2><p>A reader has written this here, at some length.</p></section>',
    '<div class="comment-list"><h3>3 replies</h3><div class=comment><p>First of them.</p></div></div>',
    '<div class="newsletter"><h3>Subscribe</h3><p>Get our letter each week, it is free.</p></div>',
    '<div class="ad"><h4>Buy now</h4><p>A thing that you need, for less.</p></div>',
    '<div class="cookie-notice"><h4>We use cookies</h4><p>Say yes to them.</p></div>',
    '<div class="related"><h3>Related</h3><ul><li><a href=1>One more story</a></li><li><a href=2>Another one</a></li></ul></div>',
]


@pytest.mark.parametrize("holder", ["article", "main", "div"])
@pytest.mark.parametrize("other", OTHERS)
def test_boilerplate_with_headings_goes(holder, other):
    text = f"<h1>Title</h1><p>{LONG}</p><p>{LONG} Two.</p><h2>Part</h2><p>{LONG} Three.</p><p>{LONG} Four.</p>"
    want = f"Title\n\n{LONG}\n\n{LONG} Two.\n\nPart\n\n{LONG} Three.\n\n{LONG} Four."
    for body in (f"<{holder}>{text}{other}</{holder}>", f"<{holder}>{text.replace('<h2>', other + '<h2>')}</{holder}>", f"<{holder}>{text}</{holder}>{other}", f"{other}<{holder}>{text}</{holder}>"):
        assert pages.main_text(page(LINKS, body, "<footer>us</footer>")) == want


def test_many_comments_and_comments_alone():
    comment = f'<div class="comment"><h4>Reader</h4><p>{LONG} {LONG}</p></div>'
    assert pages.main_text(page(f"<article><h1>Title</h1><p>{LONG}</p><section id=comments>{comment * 9}</section></article>")) == f"Title\n\n{LONG}"
    assert pages.main_text(page(f'<div class="comments">{comment}</div>')) == ""
    assert pages.main_text(page(f"<p id=comment-count>{LONG}</p><p>{LONG}</p>")) != ""


def test_lists_of_sources_stay():
    sources = "<ul><li><a href=1>First source of this</a></li><li><a href=2>Second source of this</a></li><li><a href=3>Third source of this</a></li></ul>"
    lines = "First source of this\n\nSecond source of this\n\nThird source of this"
    for holder in ("article", "main", "div"):
        assert pages.main_text(page(f"<{holder}><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{sources}<p>{LONG}</p></{holder}>")) == f"{LONG}\n\n{LONG}\n\n{LONG}\n\n{lines}\n\n{LONG}"
        assert pages.main_text(page(f"<{holder}><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><h2>Sources</h2>{sources}</{holder}>")) == f"{LONG}\n\n{LONG}\n\n{LONG}\n\nSources\n\n{lines}"


LINKS = "<div class=q1><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>About us</a></div><div><a href=4>Contact</a></div></div>"
PLAIN = [
    (f"{LINKS}<div class=q2>Buy a thing today.</div><div class=q3><h1>Head</h1>{{}}</div><div class=q4>(c) us, <a href=5>terms</a></div>", 6),
    (f"<div class=w><div class=w1>{LINKS}<div class=w2><div class=w3><h1>Head</h1><div class=w4>{{}}</div></div><div class=w5>One line of a teaser.</div></div></div></div>", 5),
    (f"<table><tr><td>{LINKS}</td></tr></table><div><div class=k>{{}}</div></div><div class=m><p>Short <a href=1>remark</a>.</p></div>", 4),
]


@pytest.mark.parametrize("shape,n", PLAIN)
def test_density_chooses_where_markup_says_nothing(shape, n, monkeypatch):
    text = shape.format("".join(f"<p>{k} {LONG}</p>" for k in range(n)))
    want = "\n\n".join(["Head"] * ("Head" in shape) + [f"{k} {LONG}" for k in range(n)])
    assert pages.main_text(text) == want
    monkeypatch.setattr(pages, "chosen", lambda root: ({id(root)}, set()))
    assert pages.main_text(text) != want


def test_sections_of_one_text_come_whole():
    parts = ["".join(f"<p>{k} {j} {LONG}</p>" for j in range(n)) for k, n in enumerate((6, 2, 3))]
    got = pages.main_text(f"{LINKS}<div>" + "".join(f"<div class=s{k}>{p}</div>" for k, p in enumerate(parts)) + f"</div><div><p>tiny</p></div>")
    assert got.split("\n\n") == [f"{k} {j} {LONG}" for k, n in enumerate((6, 2, 3)) for j in range(n)]


def test_given_pages_without_their_names():
    """Articles, menus, adverts and footers of the given pages as divs of meaningless classes give the same text."""
    import duckdb

    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    names = {"<article>": "<div class=q7>", "</article>": "</div>", 'class="ad"': "class=k3", "<nav>": "<div class=z>", "</nav>": "</div>", "<footer>": "<div class=y>", "</footer>": "</div>"}
    for (page_html,) in rows:
        bare = page_html
        for a, b in names.items():
            bare = bare.replace(a, b)
        assert pages.main_text(bare) == brute(page_html)


@pytest.mark.parametrize("part", ["<!-- a ", "<a href='", "<a ='><a' ", "<svg>", "<textarea>", "<p><table><tr><td><div>", "<div class=ad>", "<header>", "<article>", "<!x ", "</ "])
def test_time_is_linear(part):
    began = time.time()
    pages.main_text(part * 100_000 + "x")
    assert time.time() - began < 15  # 2 s alone; other work may share the machine


def test_deep_and_long_pages_end_soon():
    assert pages.main_text("<div>" * 20_000 + "x").endswith("x")
    assert pages.main_text("<a href='" * 20_000) is not None
    assert len(pages.main_text(page(*[f"<p>{LONG}</p>"] * 20_000))) == 20_000 * (len(LONG) + 2) - 2
    assert pages.main_text("<ul>" + "<li>x" * 20_000) is not None


def test_densities_by_hand():
    root = pages.parse("<div><p>abcd <a>ef</a></p></div>")
    nodes = {x.name: x for x in pages.measure(root)}
    assert (nodes["p"].chars, nodes["p"].tags, nodes["p"].link_chars, nodes["p"].link_tags) == (6, 1, 2, 1)
    assert nodes["div"].total == nodes["p"].density and nodes["body"].total == nodes["div"].density


def brute(page_html):
    """Made pages: what stands in the article element, by its p and h1 elements."""
    inner = re.search(r"<article>(.*?)</article>", page_html, re.S)[1]
    found = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in found if x)


def test_given_pages_and_rows(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in given.collect()}
    got = pages.extract(given).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == brute(rows[r.page_id].html) and r.url == rows[r.page_id].url
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<p>a", "x"), (1, "u", "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in pages.extract(odd).collect()) == ["", "", "a", "a"]
    assert pages.extract(odd.limit(0)).count() == 0
