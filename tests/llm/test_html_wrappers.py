"""Pages whose article would lose text to its own list, or to a wrapper's name."""

import pytest

from skein.llm.html_text import main_text

LONG = " ".join(f"Point {i}, of the long list, with marks." for i in range(60))


@pytest.mark.parametrize("inner", ["ul><li", "pre><b", "blockquote><p", "section><p", "div class='entry'><p", "table><tr><td"])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_an_article_keeps_its_ends(inner, outer):
    page = f"<body><nav>Menu, of it.</nav><{outer}><h1>Title</h1><p>An introduction, of one line.</p><{inner}>{LONG}</"
    page += f"{inner.split('><')[0].split()[0]}><p>The end, of it all.</p></{outer}></body>"
    assert main_text(page) == f"Title An introduction, of one line. {LONG} The end, of it all."


@pytest.mark.parametrize(
    "wrapper", ["div class='with-sidebar'", "div class=no-sidebar", "div class='layout-side'", "div id='search-page'", "form action='/'"]
)
def test_a_wrapper_is_no_furniture(wrapper):
    tag = wrapper.split()[0]
    for text in (f"<p>{LONG}</p>", f"<article><p>{LONG}</p></article>"):
        page = f"<body><div class='menu'>Home, and more.</div><{wrapper}>{text}</{tag}></body>"
        assert main_text(page) == LONG
