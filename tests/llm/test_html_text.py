import re

import pytest

from lakescribe.llm import html_text, queries
from lakescribe.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><div class="cookie-notice"><p>We use cookies.</p></div><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="ad">Buy now, it is cheap.</div>%s<aside><p>Other stories</p></aside><section id="comments"><article class="comment"><p>First!</p></article></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>Title</h1><p><b>One &amp; two.<br><p>Be.</p><div class='share'><a>x</a></div><p>Three\n four &lt;b&gt;.</p></article>", "Title\nOne & two.\nBe.\nThree four <b>."),
        ("<main><h2>H</h2><ul><li>a<li>b</ul><blockquote>q</blockquote><!-- <p>no</p> --></main>", "H\na\nb\nq"),
        ("<div><h1>Head</h1><p>A long paragraph of plain text.</p><p>And <i>another</i> one follows here.</p></div>", "Head\nA long paragraph of plain text.\nAnd another one follows here."),
        ("<article><header><h1>Inner</h1><span>by me</span></header><p>Text.</p><footer>tags</footer></article>", "Inner\nText."),
        ("<div class='top'>Hello!</div><div id='content'><div><p>One paragraph of text, quite long.</p></div><p>End.</p></div><div>Tail of the page</div>", "One paragraph of text, quite long.\nEnd."),
        ("<article></article>", ""),
    ],
)
def test_parts(body, want):
    assert main_text(PAGE % body) == want


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<p title='x>y'>a &quot;b", 'a "b'), ("<script>x", ""), ("<p>1 < 2</p>", "1 < 2"), ("<p a='", "")])
def test_odd_markup(page, want):
    assert main_text(page) == want


def test_surge_and_dive():
    assert html_text.runs([0, 5, 0, 7, 0, 0, 0, 0, 2, 0], 3) == [(1, 6, 12), (8, 10, 2)]


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>line {i}</p>" for i in range(50_000)) + "</article>"
    assert main_text(page).count("\n") == 49_999


def brute(page):
    """The article element's blocks, for the driver's template."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    import html

    blocks = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    blocks = [" ".join(html.unescape(re.sub(r"</?\w+[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_query_matches_template(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: brute(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op2_html_text(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id]))


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TEXT = "A long paragraph of the article's own text, which has to stay."


@pytest.mark.parametrize("name", ["content no-sidebar", "has-comments", "with-header", "layout-no-sidebar"])
def test_layout_names_drop_nothing(name):
    assert main_text(f"<div class='{name}'><article><p>{TEXT}</p></article></div>") == TEXT
    assert main_text(f"<div class='{name}'><p>{TEXT}</p></div>") == TEXT


def test_card_does_not_discard_the_text():
    assert TEXT in main_text(f"<div><p>{TEXT}</p><p>{TEXT}</p></div><article><p>A card.</p></article>")


@pytest.mark.parametrize("anchor", ["<a name='x'>", "<a id=top>", "<p><a href='/x'>x</p>"])
def test_unclosed_anchors_are_no_links(anchor):
    assert TEXT in main_text(f"<div>{anchor}</div><div><p>{TEXT}</p><p>{TEXT}</p></div>")


def test_part_that_holds_the_article_stays():
    card = "<div class='related'><article><p>A card.</p></article></div>"
    assert main_text(f"<div class='sidebar-page'><div class='ad'>Buy!</div><div id='promo'><article><p>{TEXT}</p></article></div></div>{card}") == TEXT
    assert main_text(f"<article><p>{TEXT}</p></article>{card}") == TEXT


def test_closed_link_around_blocks():
    page = f"<div><p>{TEXT}</p></div><div><a href='/x'><h3>Other</h3><p>Its teaser is here</p></a></div>"
    assert main_text(page) == TEXT


LONG = "Here the story goes on with many plain words, one after the other, until the line is long enough. " * 4


def test_parts_inside_a_line_and_inside_an_article():
    page = f"""<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1>
    <p>{LONG}</p><p>Before<button>Share me</button> the <b>middle</b> <svg><text>icon</text></svg>after.</p>
    <p>One <span class='ad'>Buy now!</span>two <em>three</em>.</p>
    <div class='related-work'><p>Earlier papers did this. {LONG}</p></div><section class='legal'><p>The law of rivers is old. {LONG}</p></section>
    <div class='notice'><p>We use cookies.</p></div><aside>More stories</aside><p>{LONG}</p></article><footer>Imprint</footer></body></html>"""
    lines = html_text.main_text(page).split("\n")
    story = " ".join(LONG.split())
    assert lines == ["Title", story, "Before the middle after.", "One two three.", f"Earlier papers did this. {story}", f"The law of rivers is old. {story}", story]


def test_layouts_around_an_article():
    for wrapper in ("layout has-sidebar", "no-sidebar", "with-banner", "search-result-page", "site-header-below content", "comment-free"):
        page = f"<body><div class='{wrapper}'><article><p>{LONG}</p></article></div><div class='sidebar'>Side</div></body>"
        assert html_text.main_text(page) == " ".join(LONG.split()), wrapper


def test_hostile_markup_is_linear():
    import time

    for piece in ("<script ", "<!", "<style>", "<!--", "<a '", "</", "<p class='"):
        page, began = piece * (1_000_000 // len(piece)), time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 20, piece
    began = time.perf_counter()
    assert html_text._without_raw("<script " * 125_000) == "<script " * 125_000
    assert html_text._without_raw("a<script>x</SCRIPT >b<!--c-->d<!doctype html>e<![CDATA[f]]>g<style") == "a b d e g<style"
    assert time.perf_counter() - began < 2


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, "u", f"<p>{LONG}</p>")] * 2 + [(2, None, None), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted((r.page_id, r.url or "", r.text) for r in html_text.extract(pages).collect())
    assert got == [(1, "u", " ".join(LONG.split()))] * 2 + [(2, "", ""), (3, "v", "")]


WORDS = "layout-sidebar sidebar-layout banner-page page-header-large legal-document search-results social-post header-fixed ad-supported login-required cookie-policy sponsored-content comment-page promo-article story-share menu-open hidden-gems notice-text"
AROUND = ["post-comments-enabled", "comments-open", "reply-enabled-post", "discussion-page", *WORDS.split()]
FULL = """<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><div class='top-menu'><ul><li><a href='/a'>A</a><li><a href='/b'>B</a></ul></div>
<div class='X'>%s<div class='ad-box'>Buy this now, it is very cheap today and only today, dear reader.</div></div>
<div id='comments' class='comments-area'><h2>2 replies</h2><article class='comment'><p>%s</p></article></div><div class='sidebar-right'><p>About us, in a few words.</p></div><footer>us</footer></body></html>"""
BODY = "A paragraph that tells the story in a good many words, so that it is longer than a line of a menu. "


@pytest.mark.parametrize("name", WORDS.split())
@pytest.mark.parametrize("holds", ["", "<div class='post-content'>"])
def test_containers_with_names_of_other_parts_keep_their_text(name, holds):
    own = f"{holds}<h2>Head</h2><p>{BODY * 2}</p><p>{BODY * 3}</p>{'</div>' if holds else ''}"
    page = (FULL % (own, "Nice.")).replace("class='X'", f"class='{name}'").replace("<div id='comments'", "<div hidden><div id='comments'").replace("<footer>", "</div><footer>") if "comment" in name else (FULL % (own, "Nice read.")).replace("class='X'", f"class='{name}'")
    assert main_text(page) == "\n".join(["Head", (BODY * 2).strip(), (BODY * 3).strip()])


@pytest.mark.parametrize("name", AROUND)
def test_articles_in_such_containers_stay(name):
    own = f"<article><h1>Head</h1><p>{BODY * 2}</p><p>{BODY * 3}</p></article>"
    page = (FULL % (own, BODY)).replace("class='X'", f"class='{name}'")
    assert main_text(page) == "\n".join(["Head", (BODY * 2).strip(), (BODY * 3).strip()])


@pytest.mark.parametrize("name", ["sidebar", "sidebar-right", "comments", "comment-list", "ad", "ad-box", "cookie-notice", "related-posts", "newsletter-signup"])
def test_long_other_parts_go(name):
    """Even with more text than the article, beside it."""
    page = f"<body><div class='entry'><h1>Head</h1><p>{BODY}</p></div><div class='{name}'><h3>More</h3><p>{BODY * 4}</p></div></body>"
    assert main_text(page) == f"Head\n{BODY.strip()}"


@pytest.mark.parametrize("tag", ["div", "section", "p", "li"])
def test_nested_parts_take_linear_time(tag):
    import time

    page = f"<{tag} class='sidebar'>" * 5000 + f"<article><p>{BODY}</p></article>" + f"</{tag}>" * 5000
    began = time.perf_counter()
    assert main_text(page) == BODY.strip() and time.perf_counter() - began < 1


def test_unclosed_and_crossed_elements():
    assert main_text(f"<div><p class='notice'>Cookies.<div><p>{BODY}</div></div>") == BODY.strip()
    assert main_text(f"<div class='ad'><section><p>Buy.</div><p>{BODY}</p>") == BODY.strip()
    assert main_text(f"<article><p>{BODY}</p><article class='comment'><p>No.</p></article><p>End.</p></article>") == f"{BODY.strip()}\nEnd."
