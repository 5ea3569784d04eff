from __future__ import annotations

import re

import pytest

from probatum.llm import html_extract

MAIN = "".join(f"<p>Sentence {k} of the text proper has a dozen words or so in it.</p>" for k in range(30))
TEXT = "\n".join(f"Sentence {k} of the text proper has a dozen words or so in it." for k in range(30))
PAGE = "<html><body><nav><a href=x>Home</a></nav>%s<footer>me</footer></body></html>"


@pytest.mark.parametrize("lone", [
    "<article><h3>Elsewhere</h3><p>A teaser of another page.</p></article>",
    '<article class="comment"><p>Thanks for this, I liked it a lot.</p></article>',
])
@pytest.mark.parametrize("inner", [MAIN, MAIN.replace("<p>", "<div>").replace("</p>", "</div>")])
def test_a_lone_unrelated_article_does_not_displace_the_text(lone, inner):
    got = html_extract.main_text(PAGE % f"<div class=text>{inner}</div><div><div>{lone}</div></div>", {})
    assert got.startswith(TEXT)
    assert "comment" not in lone or got == TEXT


def test_pages_with_the_marks_stripped():
    page = PAGE % f"<div><h3>Other news</h3></div><article>{MAIN}</article>"
    assert html_extract.main_text(page, {}) == TEXT
    assert html_extract.main_text(re.sub(r"</?article>", "", page), {}).endswith(TEXT)
