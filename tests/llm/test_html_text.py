"""Expected texts of pages with and without a container, and pages of many tags."""

import time

import pytest

from chartmeter.llm import html_text

LONG = "A long paragraph that goes on about some matter of interest. " * 4
TEXT = LONG.strip()
MENU = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(8))


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_short_paragraphs_in_an_article_stay():
    page = f"<nav>Menu</nav><article><h1>Title</h1>{paragraphs(LONG, 'Ok.', LONG)}</article><footer>End</footer>"
    assert html_text.main_text(page).split("\n") == ["Title", TEXT, "Ok.", TEXT]


def test_a_list_of_links_in_an_article_goes():
    page = f"<article>{paragraphs(LONG, LONG)}<ul>{MENU}</ul>{paragraphs(LONG)}<p><a href='/'>one link</a></p></article>"
    assert html_text.main_text(page).split("\n") == [TEXT, TEXT, TEXT, "one link"]


def test_two_links_in_a_row_or_links_in_sentences_stay():
    items = "<li><a href='/'>first</a></li><li><a href='/'>second</a></li>"
    page = f"<main>{paragraphs(LONG)}<ul>{items}</ul>{paragraphs('See <a>this</a> and that.', LONG)}</main>"
    assert html_text.main_text(page).split("\n") == [TEXT, "first", "second", "See this and that.", TEXT]


def test_the_end_of_a_region_is_not_lost():
    body = paragraphs(*[LONG] * 6) + "<h2>Heading</h2>" + paragraphs("Ok.", LONG)
    page = f"<html><body><ul>{MENU}</ul>{body}<ul>{MENU}</ul></body></html>"
    assert html_text.main_text(page).split("\n") == [TEXT] * 6 + ["Heading", "Ok.", TEXT]


def test_a_page_of_links_only_and_odd_pages():
    for page in ("", "<p>", "<html></html>", "<nav>x</nav>"):
        assert html_text.main_text(page) == ""
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("</b></article><p>a</p>") == "a"


@pytest.mark.parametrize("page", ["<b>x " * 100_000, "<b>x" * 50_000 + "</i>" * 50_000, "<li><a>x" * 50_000, "<div>x" * 50_000 + "</div>" * 50_000])
def test_pages_of_unclosed_tags_take_linear_time(page):
    began = time.monotonic()
    assert len(html_text.main_text(page).replace("\n", "").replace(" ", "")) == page.count("x")
    assert time.monotonic() - began < 15


def test_stray_ends_do_not_end_what_is_left_out():
    assert html_text.main_text("<p>a</p><nav><b>x</p></b>y</nav><p>b</p>") == "a\nb"
    assert html_text.main_text("<div><aside>x</div><p>b</p>") == "b"


def test_regions_and_menus():
    import numpy as np

    chosen = np.array([0, 1, 0, 0, 1, 0, 0, 0, 0, 0], dtype=bool)
    own = np.array([0, 0, 0, 0, 0, 0, 0, 1, 0, 0], dtype=bool)
    assert html_text.regions(chosen, own).tolist() == [False] + [True] * 7 + [False] * 2
    own = np.array([0, 0, 0, 0, 0, 0, 0, 0, 1, 1], dtype=bool)
    assert html_text.regions(chosen, own).tolist() == [False] + [True] * 4 + [False] * 5
    blocks = [("abcd", 1, 4, 1)] * 3 + [("abcd", 1, 0, 1)] + [("abcd", 1, 4, 1)] * 2
    assert html_text.menus(blocks, np.zeros(6, dtype=bool)).tolist() == [True] * 3 + [False] * 3
    assert not html_text.menus(blocks, np.ones(6, dtype=bool)).any()
