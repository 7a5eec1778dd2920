"""Which nodes the tag paths select: unmarked pages, linked text, hints, deep markup."""

import re
import time
import tracemalloc
from html import unescape

import pytest

from skein.llm.html_text import main_text
from tests.conftest import SMALL

LONG = " ".join(f"Sentence {i}, of the article, with marks." for i in range(40))


def test_pages_without_an_article_element(spark):
    """Recall and precision in words over all pages whose <article> tags are taken away."""
    right = found = wanted = 0
    for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", p.html, re.S)[1]
        want = unescape(re.sub(r"<[^>]*>", " ", inner)).split()
        got = main_text(re.sub(r"</?article>", "", p.html)).split()
        same = len(set(got) & set(want))
        right, found, wanted = right + same, found + len(set(got)), wanted + len(set(want))
    assert right / found > 0.97 and right / wanted > 0.97


@pytest.mark.parametrize(
    "part",
    [
        "<p><a href='/x'>A paragraph that is a link as a whole.</a></p>",
        "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be it.</p>",
        f"<section id='legal'><p>{LONG}</p></section>",
        f"<div class='social'><p>{LONG}</p></div>",
        f"<blockquote class='related'><p>{LONG}</p></blockquote>",
        "<ul><li><a href='/1'>First reference</a></li><li><a href='/2'>Second</a></li></ul>",
        "<svg><text>A label</text></svg>",
    ],
)
def test_an_article_loses_nothing_else(part):
    body = " ".join(unescape(re.sub(r"</?(?:math|m[a-z])>", "", part)).split())
    body = " ".join(re.sub(r"<[^>]*>", " ", body).split())
    page = f"<body><nav>Menu</nav><article><h1>Title</h1><p>{LONG}</p>{part}<p>The end.</p></article></body>"
    assert main_text(page) == f"Title {LONG} {body} The end."


def test_link_lists_by_hint_and_named_parts_go():
    share = "<ul class='share'><li><a href='/1'>Mail</a></li><li><a href='/2'>Post</a></li></ul>"
    notice = f"<div class='comments'><p>{LONG}</p></div><p class='notice'>Closed now.</p>"
    page = f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{share}{notice}</article></body>"
    assert main_text(page) == f"Title {LONG} {LONG}"


def test_every_article_of_a_page_is_kept():
    page = f"<body><div>Top</div><article><p>{LONG}</p></article><hr><article><h2>Two</h2><p>{LONG}</p></article></body>"
    assert main_text(page) == f"{LONG} Two {LONG}"


@pytest.mark.parametrize("tag", ["<div>a", "<p><b>x", "<li><i>y", "<div>", "</div>", "<table><tr><td>z", "<ul><li>"])
def test_unclosed_tags_take_linear_memory(tag):
    page = tag * (100_000 // len(tag))
    tracemalloc.start()
    before = time.perf_counter()
    main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and time.perf_counter() - before < 60


def split_pages(spark):
    for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        yield p.html, main_text(p.html), main_text(re.sub(r"</?article>", "", p.html))


def test_pages_with_and_without_marks_give_the_same_words_in_order(spark):
    """As sequences: a lost or doubled paragraph of common words shows."""
    from difflib import SequenceMatcher

    same = whole = 0
    for _, marked, bare in split_pages(spark):
        a, b = marked.split(), bare.split()
        whole += max(len(a), len(b))
        same += len(a) if a == b else sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert same > 0.97 * whole


@pytest.mark.parametrize(
    "part, text",
    [
        (f"<section id='notice-periods'><h2>Notice</h2><p>{LONG}</p></section>", f"Notice {LONG}"),
        ("<h2 id='search'>How search works</h2>", "How search works"),
        ("<h3 class='menu'>The menu of the day</h3>", "The menu of the day"),
        (f"<div id='banner-history'><p>{LONG}</p></div>", LONG),
        ("<div id='cookie-banner'><p>Take our cookies, please.</p></div>", ""),
        ("<div id='comments-2'><p>I do not agree, at all.</p></div>", ""),
        ("<div id='footer-links'><p>Terms, and all.</p></div>", ""),
    ],
)
@pytest.mark.parametrize("outer", ["article", "div"])
def test_an_id_that_names_a_subject_is_no_furniture(part, text, outer):
    page = f"<body><nav>Menu</nav><{outer}><h1>Title</h1><p>{LONG}</p>{part}<p>The end, of it.</p></{outer}></body>"
    assert main_text(page) == " ".join(f"Title {LONG} {text} The end, of it.".split())


def test_a_last_line_of_rights_goes_from_an_unmarked_page():
    page = f"<body><div><h1>Title</h1><p>Copyright law, explained, at length.</p><p>{LONG}</p><p>Copyright 2020 A. Person. All rights reserved.</p></div></body>"
    assert main_text(page) == f"Title Copyright law, explained, at length. {LONG}"
