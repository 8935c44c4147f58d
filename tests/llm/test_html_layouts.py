"""Pages without one article element: no part of the text may go because another one is long."""

from postmill.llm import html_main

LONG = "\n".join(f"A long paragraph, number {k}, with words; and more words, all of it text." for k in range(200))
BODY = "".join(f"<p>{line}</p>" for line in LONG.split("\n"))
FIRST, LAST = "The first part is short, but text.", "The last part is short as well, but text."
NAV, FOOT = '<nav><a href="/">Home</a></nav>', "<footer>No, none of this.</footer>"


def page(main):
    return html_main.main_text(f"<html><body>{NAV}{main}{FOOT}</body></html>")


def test_lead_and_title_beside_a_long_part():
    for lead in (f"<div class=lead><p>{FIRST}</p></div>", f"<div class=lead>{FIRST}</div>"):
        assert page(f"<div class=post><h1>Title</h1>{lead}<div class=text>{BODY}</div></div>") == f"Title\n{FIRST}\n{LONG}"


def test_sections_with_one_long():
    short = f"<section><h2>A</h2><p>{FIRST}</p></section><section><h2>B</h2>{BODY}</section><section><h2>C</h2><p>{LAST}</p></section>"
    want = f"A\n{FIRST}\nB\n{LONG}\nC\n{LAST}"
    assert page(short) == page(f"<div id=page>{short}</div>") == want
    assert page(short.replace("section", "div")) == want


def test_articles_with_one_long():
    pages = f"<article><p>{FIRST}</p></article><article>{BODY}</article><article><p>{LAST}</p></article>"
    assert page(pages) == page(f"<main>{pages}</main>") == f"{FIRST}\n{LONG}\n{LAST}"


def test_lead_in_main_beside_the_article():
    lead = LONG.split("\n")[:2]
    assert page(f"<main><div><p>{lead[0]}<p>{lead[1]}</div><article>{BODY}</article></main>") == "\n".join([*lead, LONG])


def test_one_article_stays_alone():
    assert page(f"<article>{BODY}</article><div><p>{LAST}</p></div>") == LONG
