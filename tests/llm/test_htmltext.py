"""Main text of pages: given pages against their articles, and small pages of many shapes."""

from __future__ import annotations

import html
import re

import pytest

from tallyframe.llm import htmltext
from tallyframe.llm.htmltext import main_text_of

HEAD = '<!DOCTYPE html><html><head><title>A title, long. Very long.</title><style>p > b{}</style><script>var t="</p><p>no";if(a<b&&c>d){}</script></head><body class="has-sidebar">'
MENU = "<nav><ul><li><a href='/a'>One</a><li><a href='/b'>Two</a></ul></nav>"
LONG = "This is a sentence, with commas, and it goes on; there is more of it. And one more."


def page(body, end="</body></html>"):
    return HEAD + body + end


def article(source):
    """The blocks of a given page's article, by plain splitting."""
    inner = source.split("<article>", 1)[1].split("</article>")[0]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.extract(pages).collect()}
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"{MENU}<article><h1>T</h1><p>Be.</p></article><footer>&copy; {LONG}</footer>", "T\nBe."),
        (f"<header><h1>Site</h1><p>{LONG}</p></header><main><p>Short</p></main><aside><p>{LONG}</p></aside>", "Short"),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><footer>By me, here.</footer></article>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p><ul><li>one</li><li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG}\none\ntwo\na\nb\nc"),
        (f"<article><p>{LONG}<div class='ad'>Buy this, now. Or that.</div><p>End</p><section id=comments><p>{LONG}</p><article class=comment>{LONG}</article></section></article>", f"{LONG}\nEnd"),
        (f"<article><p>{LONG}</p><form><label>Mail, please.</label><input value='x'><textarea>t</textarea></form></article>", LONG),
        (f"<div class='cookie-notice'><p>{LONG}</p></div><div id=sidebarLeft>{LONG}</div><div class=content><h2>H</h2><p>{LONG}</p><p>a</p></div><div class=newsletter>{LONG}</div>", f"H\n{LONG}\na"),
        (f"<div><a href=/>One</a> <a href=/>Two</a></div><h1>H</h1><p>{LONG}</p><p>{LONG}</p><div>(c) me</div>", f"H\n{LONG}\n{LONG}"),
        (f"<form action=/><main><p>{LONG}</p></main></form>", LONG),
        (f"<nav><a>x</a><article><p>{LONG}</p></article>", LONG),
        (f"<article><h1><a href=/>Linked title</a></h1><p>{LONG}</p><ul class=links><li><a>x</a></li><li><a>y</a></li></ul></article>", f"Linked title\n{LONG}"),
        ("<article><p><b>a<br>b<p>c</b> d <i>e</i>f<!-- no > --><script>x</script>g</article>", "a b\nc d efg"),
        ("<article><p>&lt;b&gt; &amp;amp; &eacute &#x41;&#8364;&nbsp;&am 3 < 4 &amp</article>", "<b> &amp; é A€ &am 3 < 4 &"),
        ("<article>bare text<p>then <span class=ad>no</span>more</article>", "bare text\nthen more"),
        ("<article><p>cut <a hre", "cut"),
        ("<article><p>cut <!-- never", "cut"),
        ('<article><p title="a > b" data-x=\'</article>\'>in</p></article>', "in"),
        ("<article></article>", ""),
        (MENU, ""),
        ("", ""),
    ],
)
def test_shapes_of_pages(body, want):
    assert main_text_of(page(body, "" if "<a hre" in body or "never" in body else "</body></html>")) == want


def test_paths_decide_where_a_page_names_no_parts():
    menu = "".join(f"<td><a href=/{i}>Item {i}</a></td>" for i in range(9))
    text = "".join(f"<div><div>{LONG} {i}</div></div>" for i in range(5)) + "<div><div>ok</div></div>"
    got = main_text_of(page(f"<table><tr>{menu}</tr></table><div>{text}</div><span>tiny</span>"))
    assert got == "\n".join([*(f"{LONG} {i}" for i in range(5)), "ok"])


def test_nulls_repeats_long_pages_and_clashing_names(spark):
    long = "<article>" + "<p>wörd &amp; word.</p>" * 60_000 + "<div>" * 3000 + "deep"
    rows = [(1, "u", "<article><p>a</article>", "x"), (1, "u", "<article><p>a</article>", "x"), (None, None, "<article>b", "y"), (2, "v", None, None), (3, "w", "", "z"), (4, "x", long, "t"), (5, "y", "no markup, at all.", "t"), (6, "z", "< > <", "t")]
    pages = spark.createDataFrame([(*r, 9, "c") for r in rows], "page_id long, url string, html string, text string, n_chars int, path string")
    got = htmltext.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = "\n".join(["wörd & word."] * 60_000 + ["deep"])
    assert [tuple(r) for r in got.collect()] == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "b", 1), (2, "v", "", 0), (3, "w", "", 0), (4, "x", want, len(want)), (5, "y", "no markup, at all.", 18), (6, "z", "< > <", 5)]
    assert htmltext.extract(pages.limit(0)).count() == 0
