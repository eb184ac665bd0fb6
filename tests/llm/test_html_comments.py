"""Readers' comments beside articles without an article tag, and path ratios computed another way."""

import math
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from scribespark.llm.html_text import PUNCTUATION, main_text, nodes, path_scores

POST = ["The council met on Monday to talk about the new bridge over the river.", "It was built in stages, says the paper, and will cost more than planned.", "Work begins next spring; the old bridge stays open until then."]
SAID = [f"I think that this is comment number {i}, which goes on for quite a while. It has sentences, too!" for i in range(10)]
WANT = "\n".join(POST)
BODY = "".join(f"<p>{x}</p>" for x in POST)
PLAIN = "".join(f"<p>{x}</p>" for x in SAID)


def page(*parts):
    return "<html><body><nav><a>Home</a></nav>" + "".join(parts) + "<footer>c</footer></body></html>"


def items(shape):
    return "".join(shape.format(name=f"Reader {i}", day=i + 1, text=x) for i, x in enumerate(SAID))


@pytest.mark.parametrize(
    "comments",
    [
        f"<div class='comments'>{PLAIN}</div>",
        f"<div id='disqus_thread'>{PLAIN}</div>",
        f"<section class='user-comments'><h2>What readers say</h2>{PLAIN}</section>",
        f"<div class='discussion'>{PLAIN}</div>",
        "<div class='reader-opinions'>" + items("<div class='op'><b>{name}</b> <span>{day} May 2021</span><p>{text}</p></div>") + "</div>",
        "<div class='x1'>" + items("<div class='x2'><span class='author'>{name}</span><p>{text}</p></div>") + "</div>",
        "<ol class='thread'>" + items("<li><cite>{name}</cite><div>{text}</div></li>") + "</ol>",
        "<ul>" + items("<li><p>{name} wrote:</p><p>{text}</p><a href='#'>Reply</a></li>") + "</ul>",
        items("<div class='voice'><time>{day}:30</time><p>{text}</p></div>"),
        "<div class='talk'>" + items("<div class='row'><p>{day} hours ago</p><p>{text}</p></div>") + "</div>",
        "<table class='board'>" + items("<tr><td>2021-05-0{day}</td><td>{text}</td></tr>") + "</table>",
        "<div class='below'><h3>Ten voices</h3>" + items("<blockquote><p>{text}</p><a rel='author'>{name}</a></blockquote>") + "</div>",
    ],
)
@pytest.mark.parametrize("post", ["<div class='post'>{}</div>", "<div class='wrap'><div class='post'>{}</div></div>"])
def test_comments_longer_than_the_article_go(comments, post):
    assert main_text(page(post.format(BODY), comments)) == WANT
    # in one wrapper, and before the article
    assert main_text(page("<div class='all'>", post.format(BODY), comments, "</div>")) == WANT
    assert main_text(page(comments, post.format(BODY))) == WANT


def test_comments_inside_an_article_go():
    said = "<div class='voices'>" + items("<div class='v'><time>{day}:30</time><p>{text}</p></div>") + "</div>"
    assert main_text(page(f"<article>{BODY}{said}</article>")) == WANT


def test_what_is_no_list_of_comments_stays():
    dated = "".join(f"<div class='part'><h2>Day {i}</h2><p>{x}</p></div>" for i, x in enumerate(POST))
    assert main_text(page(f"<div class='story'>{dated}</div>")) == "\n".join(f"Day {i}\n{x}" for i, x in enumerate(POST))
    # the only text there is, whatever its parts are called
    assert main_text(page(f"<div class='comments'>{PLAIN}</div>")) == "\n".join(SAID)
    thread = "<div class='thread'>" + items("<div class='v'><b>{name}</b><p>{text}</p></div>") + "</div>"
    assert SAID[0] in main_text(page(thread))
    # one byline is an article's own
    assert main_text(page(f"<div class='post'><div class='meta'>By Ann, 2 May 2021</div>{BODY}</div>")).endswith(WANT)


class Ratios(HTMLParser):
    """Tag paths of text nodes by the standard library's parser; pages without class names, all tags closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.path.append(tag)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        if data.strip():
            self.found.append((tuple(self.path), data.strip()))


def test_path_ratios():
    """Length and punctuation by path, smoothed along the page and fused, against a second computation."""
    html = "<html><body><div><p>One, two; three.</p><p>Four is a longer text, is it not?</p><ul><li>a</li><li>b c</li></ul></div><main><h1>Head</h1><p>Inside main: words.</p></main><p>Tail</p></body></html>"
    other = Ratios()
    other.feed(html)
    length, marks, count, smooth = (defaultdict(float) for _ in range(4))
    for path, text in other.found:
        count[path] += 1
        length[path] += len(text)
        marks[path] += sum(c in PUNCTUATION for c in text)
    ratio = [length[p] / count[p] for p, _ in other.found]
    for i, (path, _) in enumerate(other.found):
        weights = {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 2), min(len(ratio), i + 3))}
        smooth[path] += sum(w * ratio[j] for j, w in weights.items()) / sum(weights.values())
    want = {p: smooth[p] / n * (1 + math.log1p(marks[p] / n)) * (4 if "main" in p else 1) for p, n in count.items()}

    paths, found = nodes(html)
    parts = [(p, t.strip()) for p, _, t in found if t.strip()]
    assert [t for _, t in parts] == [t for _, t in other.found]
    name = {p: q for (p, _), (q, _) in zip(parts, other.found)}
    got = {name[p]: s for p, s in path_scores(paths, parts).items()}
    assert got == pytest.approx(want)
