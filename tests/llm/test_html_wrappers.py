"""Main text inside wrappers that are named like page furniture, and beside short sections."""

import pytest

from augury.llm import html_text

LONG = "A long paragraph, with commas, and words that go on, and on, until the line is full enough to count as text."
MENU = "<nav><a href=x>Home</a></nav><div class='ad-box'>Buy this now</div>"


@pytest.mark.parametrize("tag", ["div class='content with-sidebar'", "div class='no-sidebar'", "div id=has-header", "div class='page-widget'", "form action=x", "form class='site-header'"])
@pytest.mark.parametrize("inner", ["<article><p>{0}<p>End.</article>", "<div><p>{0}<p>End.</div>"])
def test_wrappers_keep_their_text(tag, inner):
    page = f"<{tag}>{MENU}{inner.format(LONG)}<form>Your mail</form></{tag.split()[0]}>"
    assert html_text.extract(page) == f"{LONG}\nEnd."


def test_furniture_beside_the_text_goes():
    page = f"<div class=sidebar><p>{LONG}</div><article><p>Short.</article><div class=comments><p>{LONG}<p>{LONG}</div><form><p>{LONG}</form>"
    assert html_text.extract(page) == "Short."
    page = f"<div><p>{LONG}<p>{LONG}</div><div class=comments><article><p>{LONG * 5}</article></div>"
    assert html_text.extract(page) == f"{LONG}\n{LONG}"
    page = f"<div><p>{LONG}<p>{LONG}</div><div class=related><article><p>Also, of interest.</article></div>"
    assert html_text.extract(page) == f"{LONG}\n{LONG}"


def test_short_sections_stay():
    page = f"<div><section><p>One short one.</section><section>{f'<p>{LONG}' * 12}</section><div><p>Last, and short.</div><div><a href=x>More of it here</a></div></div>"
    assert html_text.extract(page) == "\n".join(["One short one.", *[LONG] * 12, "Last, and short."])
