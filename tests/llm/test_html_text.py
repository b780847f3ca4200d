from __future__ import annotations

import html
import random
import time

import pytest

from rasterloom.llm.html_text import extract, main_text

MENU = '<ul class="menu">' + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8)) + "</ul>"
PARTS = {
    "nav": f"<nav>{MENU}</nav>",
    "header": '<header class="site"><a href="/">Site name</a><p>Slogan of the site, not very short at all.</p></header>',
    "roles": '<div role="navigation"><a href=x>Home</a> and <a href=y>more</a></div>',
    "aside": "<aside><h3>Popular</h3><p>An aside on other things, with some words of its own.</p></aside>",
    "sidebar": '<div id="sidebar-left"><p>Sidebar text that is as long as a paragraph of the article would be, or nearly so.</p></div>',
    "cookie": '<div class="cookie-notice">We use cookies to make this page better for all of its readers. <button>OK</button></div>',
    "ad": '<div class="ad">Buy this now, it is very cheap and very good and only here.</div>',
    "form": '<form action="/go"><label>Mail</label><input name="mail"><textarea>type here</textarea><p>Get our letter each week.</p></form>',
    "script": "<script>if (a < b && c > d) { document.write('<p>written</p>'); }</script>",
    "style": "<style>p > b { content: '</p>' }</style>",
    "noscript": "<noscript><p>Turn scripts on, please, to read this page.</p></noscript>",
    "comments": '<section id="comments"><h2>Comments</h2>' + "".join(f'<article class="comment"><p>Reader {i} says that the article is all wrong, and says so at some length, longer than it.</p></article>' for i in range(12)) + "</section>",
    "hidden": '<div style="display: none"><p>Nobody sees this paragraph on the page at all.</p></div>',
    "unnamed menu": "<div>" + " | ".join(f'<a href="{i}">Topic number {i}</a>' for i in range(9)) + "</div>",
    "remark": "<!-- <p>commented out</p> -->",
    "footer": "<footer><p>&copy; 2020 all rights are reserved by the owner of the site.</p></footer>",
}
BODY = ["Title of it &amp; all", "First paragraph with <b>bold</b> and <a href='#'>one link</a> in it, of some length.", "Second one,\n  wrapped   over lines &lt;b&gt; &#8212; &eacute;.", "Third, short."]
TEXT = ["Title of it & all", "First paragraph with bold and one link in it, of some length.", "Second one, wrapped over lines <b> — é.", "Third, short."]


def article(opening: str, closing: str) -> str:
    return f"{opening}<h1>{BODY[0]}</h1>" + "".join(f"<p>{p}</p>" for p in BODY[1:]) + closing


@pytest.mark.parametrize("opening, closing", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="content">', "</div>"), ("<div><div><section>", "</section></div></div>"), ('<body class="has-sidebar no-comments"><div id="wrapper">', "</div>")])
@pytest.mark.parametrize("part", list(PARTS))
def test_the_article_and_nothing_else(opening, closing, part):
    for before, after in ((PARTS[part], ""), ("", PARTS[part]), (PARTS["nav"] + PARTS[part], PARTS["footer"])):
        page = f"<!DOCTYPE html><html><head><title>No text</title></head><body>{before}{article(opening, closing)}{after}</body></html>"
        assert main_text(page) == "\n".join(TEXT)


@pytest.mark.parametrize("part", ["ad", "sidebar", "script", "form", "remark", "comments", "cookie", "aside"])
def test_boilerplate_inside_the_article(part):
    page = f"<body>{PARTS['header']}<article><h1>{BODY[0]}</h1><p>{BODY[1]}</p>{PARTS[part]}<p>{BODY[2]}</p><p>{BODY[3]}</p>{PARTS['comments']}</article>"
    assert main_text(page) == "\n".join(TEXT)


def test_broken_markup():
    assert main_text("<article><h1>T &amp</h1><p><b>One.<br><p>Two &am</p><p>Three</article><footer>f") == "T &\nOne.\nTwo &am\nThree"
    assert main_text("<p>a < b and 2<3 </notag> c<br/>d") == "a < b and 2<3 c d"
    assert main_text("<p title=it's>An apostrophe in a value</p><p>and after</p>") == "An apostrophe in a value\nand after"
    assert main_text('<p>before</p><p title="never closed>lost</p>') == "before"
    assert main_text("<div><b><p>one</b> two</p>three</div>") == "one two\nthree"
    assert main_text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>d") == "a\nb\nc\nd"
    assert main_text("<article><p>x<script>never closed <p>y") == "x"
    assert main_text("<p>&amp;amp; &#x41;&#0; &nbsp; z</p>") == "&amp; A� z"
    assert main_text("<ARTICLE><P CLASS=x>Upper case</P></ARTICLE><NAV>menu</NAV>") == "Upper case"


def test_nothing_and_plain_text():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text(PARTS["nav"]) == ""
    assert main_text(" plain \n text ") == "plain text"


def test_sections_are_kept_together():
    page = "<body><div class='post'><h1>Head</h1><div><p>" + "one " * 60 + "</p><p>" + "two " * 60 + "</p></div><div><p>" + "three " * 60 + "</p></div></div><div class='related'><p>" + "other " * 90 + "</p></div>"
    assert [b.split()[0] for b in main_text(page).split("\n")] == ["Head", "one", "two", "three"]


def test_long_and_deep_pages_in_linear_time():
    """Pages that make a parser look back again and again, ten times as long: not a hundred times as slow."""
    kinds = [lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<b><p>" * n, lambda n: "<!--" * n, lambda n: '<p a="' * n, lambda n: "<" * n, lambda n: "</i>" * n + "x", lambda n: "<script>" * n, lambda n: "<table><td>" * n, lambda n: "<p>w</p>" * n, lambda n: "<a = " * n, lambda n: "&" * n]
    for kind in kinds:
        took = []
        for n in (3000, 30000):
            began = time.process_time()
            main_text(f"<article><p>first</p>{kind(n)}</article>")
            took.append(time.process_time() - began)
        assert took[1] < 40 * max(took[0], 0.01)


def test_random_pages_keep_every_paragraph():
    draw = random.Random(5)
    for _ in range(200):
        texts = [" ".join(draw.choice(["ab", "c&d", "e<f", "gh.", "ïj", "kl"]) for _ in range(draw.randint(1, 80))) for _ in range(draw.randint(1, 12))]
        wrapped = "".join(f"<{t}>{html.escape(x)}</{t}>" for x in texts for t in [draw.choice(["p", "h2", "blockquote", "div", "pre"])])
        around = [PARTS[p] for p in draw.sample(list(PARTS), 4)]
        assert main_text(f"{around[0]}{around[1]}<article>{wrapped}</article>{around[2]}{around[3]}") == "\n".join(texts)


def test_extract(spark):
    rows = [(1, "u", "<article><p>a b</p></article>", "x"), (1, "u", "<article><p>a b</p></article>", "x"), (None, None, None, "y"), (2, "v", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string").selectExpr("*", "1 as `a.b`", "2 as n_chars")
    got = extract(pages)
    assert [c.lower() for c in got.columns] == ["page_id", "url", "html", "text", "a.b", "n_chars"]
    assert sorted((r[0] or 0, r[3]) for r in got.collect()) == [(0, ""), (1, "a b"), (1, "a b"), (2, "")]
    assert extract(pages.limit(0)).count() == 0
