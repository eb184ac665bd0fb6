"""Class and id words, and attributes, that once cost a page its article."""

import time

import pytest

from scribespark.llm.html_text import _attributes, main_text

TITLE = "A headline"
LINES = [f"Paragraph {i} of the article is long enough, has marks; and says something of its own." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
WANT = "\n".join(LINES)
HEAD, FOOT = "<html><body><nav><a>Home</a></nav>", "<footer>c</footer></body></html>"


def test_attributes_by_name():
    got = _attributes(""" id="comments" width="300" style='overflow:hidden' href=/hidden-lake data-id=7 HIDDEN class = "a b" id="x" """)
    assert got == {"id": "comments", "width": "300", "style": "overflow:hidden", "href": "/hidden-lake", "data-id": "7", "hidden": "", "class": "a b"}


@pytest.mark.parametrize(
    "start",
    [
        '<div style="overflow:hidden">',
        '<div data-state="hidden" data-role="dialog">',
        '<div class="container has-sidebar">',
        '<div class="no-sidebar">',
        '<div id="modal">',
        '<div class="banner"><div class="social">',
        "<form>",
    ],
)
def test_a_wrapper_keeps_its_text(start):
    ends = "".join(f"</{x.split('>')[0].split()[0]}>" for x in reversed(start.split("<")[1:]))
    assert main_text(HEAD + start + BODY + ends + FOOT) == WANT
    assert main_text(HEAD + start + "<article>" + BODY + "</article>" + ends + FOOT) == WANT


def test_headline_and_links_stay():
    page = f'{HEAD}<article><header class="entry-header"><h1>{TITLE}</h1></header>{BODY}<p>See <a href="/hidden-lake">the lake</a>, too.</p></article>{FOOT}'
    assert main_text(page) == f"{TITLE}\n{WANT}\nSee the lake, too."


def test_parts_beside_the_article_go():
    comments = '<div id="comments" width="300"><p>Nice, said a reader at some length, twice over.</p></div>'
    page = f'{HEAD}<div class="page has-sidebar"><div class="story">{BODY}</div><div class="sidebar">Related things</div>{comments}<div hidden><p>{LINES[0]} Not shown.</p></div></div><form>Subscribe</form>{FOOT}'
    assert main_text(page) == WANT
    inside = f'{HEAD}<article>{BODY}<div class="ad"><p>Buy this now.</p></div><ul class="share"><li>Share</li></ul></article><div class="related"><article><p>Another, shorter one.</p></article></div>{FOOT}'
    assert main_text(inside) == WANT


@pytest.mark.parametrize("page", ["<span>" * 50_000 + "x", "<div>x" * 20_000, "<span>" * 20_000 + "<li>a</li>" * 20_000, "<div class=ad>y" * 20_000, "<span>" * 20_000 + "</b>" * 20_000 + "z", "<p>a<span>" * 20_000])
def test_tags_left_open_cost_no_more_than_others(page):
    began = time.monotonic()
    assert main_text(page)
    assert time.monotonic() - began < 10
