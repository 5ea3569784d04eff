from __future__ import annotations

import time

import pytest

from probatum.llm import html_extract

TEXT = "A sentence of the text proper with a dozen words or so in it."
PAGE = "<html><body><article>" + f"<p>{TEXT}</p>" * 5


def timed(page):
    start = time.time()
    got = html_extract.main_text(page, {})
    return got, time.time() - start


@pytest.mark.parametrize("end", [
    "<img src=\"a\" alt='b' " + " ".join(f'a{k}="v{k}"' for k in range(30)) + ' title="cut',
    "<img " + " ".join(f"a{k}='v{k}'" for k in range(3_000)) + " title='cut",
    "<img " + " ".join(f"a{k}=don't" for k in range(3_000)),
    "<a " + "\"'=" * 5_000,
    "<p class=", "<!--" + " -" * 50_000, "<script>" + "x<" * 20_000,
])
def test_markup_that_is_cut_off_ends_soon(end):
    got, took = timed(PAGE + end)
    assert got == "\n".join([TEXT] * 5) and took < 2


@pytest.mark.parametrize("unit", ["<b>x ", "<div>x ", "<p>x ", "<li>x ", "<span><li>x ", "<ul><li>x ", "</b>x ", "<b></i>x "])
def test_many_open_elements(unit):
    got, took = timed(unit * 100_000)
    assert took < 6 and got.count("x") == 100_000


def test_an_apostrophe_in_a_bare_value_is_no_quote():
    assert html_extract.main_text("<body><p title=don't>" + TEXT + "</p><p>It's " + TEXT + "</p>", {}) == f"{TEXT}\nIt's {TEXT}"


@pytest.mark.parametrize("name", "article-comments post-comments comment-body content-ad text-advert main-nav main-sidebar entry-footer comments_body".split())
def test_compound_names_of_boilerplate(name):
    page = PAGE + f'<div class="{name}"><p>Thanks for this, I liked all of it a lot.</p></div><p>{TEXT}</p></article>'
    assert html_extract.main_text(page, {}) == "\n".join([TEXT] * 6)


@pytest.mark.parametrize("name", ["post category-notices", "entry-header", "with-sidebar", "no-nav", "article-body", "content", "story-text", "has-comments content"])
def test_names_of_content_stay(name):
    page = PAGE + f'<div class="{name}"><p>{TEXT}</p></div></article>'
    assert html_extract.main_text(page, {}) == "\n".join([TEXT] * 6)
