"""Operator 2: the main text of a page by tag-path ratios.

Every text node has a root-to-leaf path of tags (generic containers with their class). Text length and
punctuation are aggregated by path and divided by the path's nodes, smoothed along the page, and fused
with what the path's own tags say: parts that are never article text (menus, forms, hidden ones ...) are
out, ``article`` and ``main`` count for more, and parts whose class or id names something else (adverts,
comments ...) count for less, unless they hold the article, or most of the text of a page
without one that has no article-like text elsewhere. Lists whose items each name an author or a date, as readers' comments do, count
as such parts whatever they are called. Paths above a threshold vote for the container they lie
in; all paths of that container are content, however short their text.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes these open elements, up to the containers after the bar.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Parts of a page that are not its article, by tag, role, and word of a class or id.
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select menu dialog search fieldset head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
BOILERPLATE_WORDS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dialog footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words for what readers wrote, and for who wrote an item and when; those are tags, properties and words of classes.
COMMENT_WORDS = frozenset("comment comments commentaires comentarios discussion discussions disqus feedback guestbook kommentare opinions reactions remarks replies respond responses talkback".split())
BYLINE_WORDS = frozenset("ago author avatar byline commenter date nick nickname posted published reply time timestamp user username".split())
BYLINE_TAGS = frozenset(("time", "cite"))
BOILERPLATE_WORDS = BOILERPLATE_WORDS | COMMENT_WORDS
#: Words that make a class name say what is beside an element, and those that make a header an article's own.
BESIDE_WORDS = frozenset("has no with without".split())
HEADLINE_WORDS = frozenset("article entry post story".split())
#: Factor on the ratio of a path with a boilerplate word, and its mark in the path.
SUSPECT, MARK = 0.1, ".!"
CONTENT_TAGS = frozenset(("article", "main"))
ITEMS = frozenset("article section div li dd dl blockquote tr td".split())
CONTAINERS = frozenset("article main section div td body blockquote center table".split())
PUNCTUATION = frozenset(".,;:!?\"'()…–—«»¿¡。，、；：！？")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[a-z]+")
#: Short texts that name a time, or who says what follows, or offer to answer.
_BYLINE = re.compile(
    r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2}:\d\d|\b(?:\d+|an?|one) (?:second|minute|hour|day|week|month|year)s? ago\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d|\d\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"|\b(?:says|said|wrote|writes):?$|^(?:reply|answer|report|like|antworten|répondre|responder)$",
    re.I,
)
_SENTENCE = re.compile(r"[.!?…。！？]")
#: Characters of a byline at most, and of a node of article-like text at least; characters of such nodes that make an article.
BYLINE, SENTENCE, ARTICLE = 40, 40, 100
#: Share of like siblings that must have a byline; share of a marked part's article-like text that must stand elsewhere for another part to be the article.
MOST_ITEMS, ELSEWHERE = 0.6, 0.25
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] or ""
        found.setdefault(m[1].lower(), (value[1:-1] if value[:1] in ("'", '"') else value).lower())
    return found


def _is_boilerplate(name: str, attributes: dict[str, str], in_content: bool) -> bool:
    if name in BOILERPLATE_TAGS and not (name == "header" and in_content):
        return True
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in BOILERPLATE_ROLES


def _is_suspect(name: str, attributes: dict[str, str], in_content: bool) -> bool:
    """Whether a class or id has a word of boilerplate that is about the element itself."""
    if name in ("html", "body"):
        return False
    for token in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = _WORDS.findall(token)
        bad = BOILERPLATE_WORDS.intersection(words)
        if bad and words[0] not in BESIDE_WORDS and not (bad == {"header"} and (in_content or not HEADLINE_WORDS.isdisjoint(words))):
            return True
    return False


class _Page:
    """A page's elements in page order, each with its parent, and its text nodes; as far as parsed, what is open.

    Element 0 stands for the page. Nothing here looks through all open elements, of which a page may leave very
    many: it is known where the last open one of each tag stands.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.component, self.bad = [0], [""], [""], [False]
        #: the nearest element, itself included, that may be boilerplate; 0 if none
        self.part = [0]
        #: by such element: whether it is a form
        self.form: dict[int, bool] = {0: False}
        #: whether an element itself tells who wrote something or when, and whether its name is one of readers' comments
        self.byline, self.comments = [False], [False]
        #: (element, block number, decoded text)
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self.open: list[int] = [0]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def text(self, string: str) -> None:
        if string:
            self.texts.append((self.open[-1], self.block, html.unescape(string)))

    def push(self, tag: str, component: str, bad: bool, may_be: bool, form: bool, byline: bool = False, comments: bool = False) -> None:
        above, at = self.open[-1], len(self.tag)
        self.parent.append(above)
        self.tag.append(tag)
        self.component.append(component)
        self.bad.append(bad or self.bad[above])
        self.part.append(at if may_be else self.part[above])
        if may_be:
            self.form[at] = form
        self.byline.append(byline)
        self.comments.append(comments)
        self.places[tag].append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(at)

    def close(self, place: int) -> None:
        """Closes the open elements from a place on."""
        self.block += bool(self.blocks) and self.blocks[-1] >= place
        while len(self.open) > place:
            tag = self.tag[self.open.pop()]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags: frozenset[str]) -> int:
        return max((self.places[x][-1] for x in tags if self.places[x]), default=0)

    def lowest(self, tags: frozenset[str], above: int) -> int | None:
        """The first place after ``above`` of an open element with one of the tags."""
        found = [own[i] for x in tags if (i := bisect.bisect_right(own := self.places[x], above)) < len(own)]
        return min(found, default=None)

    def _sums(self) -> tuple[list[int], list[int], list[bool]]:
        """For each element, of all text in it that is not certainly boilerplate: characters, those of article-like nodes, whether it has a byline."""
        length, like, byline = [0] * len(self.tag), [0] * len(self.tag), self.byline[:]
        for at, _, text in self.texts:
            n = len(text := text.strip())
            if n and not self.bad[at]:
                length[at] += n
                like[at] += n if n >= SENTENCE and _SENTENCE.search(text) else 0
                byline[at] = byline[at] or (n <= BYLINE and bool(_BYLINE.search(text)))
        for at in range(len(self.tag) - 1, 0, -1):
            up = self.parent[at]
            length[up], like[up], byline[up] = length[up] + length[at], like[up] + like[at], byline[up] or byline[at]
        return length, like, byline

    def mark_lists(self) -> None:
        """Lists of like items that mostly have a byline become parts that may be boilerplate: the whole list, or its items where it holds an article as well."""
        _, like, byline = self._sums()
        items: dict[tuple[int, str], list[int]] = defaultdict(list)
        for at in range(1, len(self.tag)):
            if self.tag[at] in ITEMS and not self.bad[at]:
                items[self.parent[at], self.component[at]].append(at)
        lists = {}
        for (up, _), own in items.items():
            if len(own) > 1 and sum(byline[x] for x in own) >= max(2, MOST_ITEMS * len(own)):
                whole = up and self.tag[up] not in ("html", "body", *CONTENT_TAGS) and like[up] - sum(like[x] for x in own) < ARTICLE
                lists |= dict.fromkeys([up] if whole else own)
        if not lists:
            return
        for at in range(1, len(self.tag)):
            if at in lists:
                self.part[at] = at
                self.form.setdefault(at, False)
                self.comments[at] = True
            elif self.part[at] != at:
                self.part[at] = self.part[self.parent[at]]

    def is_ordinary(self) -> dict[int, bool]:
        """Which elements that may be boilerplate are ordinary ones: those that hold the page's ``main``, or all its
        articles; on a page that has neither, most of its text, while what stands outside of all such elements is no article."""
        length, like, _ = self._sums()
        held = [Counter() for _ in self.tag]
        outside = 0
        for at in range(len(self.tag) - 1, -1, -1):
            if self.tag[at] in CONTENT_TAGS and not self.bad[at]:
                held[at][self.tag[at]] += 1
            if at and held[at]:
                held[self.parent[at]] += held[at]
        for at, _, text in self.texts:
            n = len(text := text.strip())
            if not self.part[at] and not self.bad[at] and n >= SENTENCE and _SENTENCE.search(text):
                outside += n
        tag = next((x for x in ("main", "article") if held[0][x]), None)

        def ordinary(x: int) -> bool:
            if tag:
                return held[x][tag] == held[0][tag]
            elsewhere = outside >= ARTICLE and (self.comments[x] or outside >= ELSEWHERE * like[x])
            return 2 * length[x] > length[0] and not elsewhere

        return {x: ordinary(x) for x in self.form}


def parsed(page: str) -> _Page:
    out = _Page()
    at = 0
    while m := _TOKEN.search(page, at):
        out.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if out.places[name]:
                out.close(out.places[name][-1])
            continue
        if name in RAW:
            end = _END[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in BLOCK:
            out.block += 1
            if out.blocks and out.tag[out.open[out.blocks[-1]]] == "p":
                out.close(out.blocks[-1])
        if name in CLOSES:
            closed, until = CLOSES[name]
            if (place := out.lowest(closed, out.last(until))) is not None:
                out.close(place)
        if name == "br":
            out.text(" ")
        if name in VOID or m[3].endswith("/"):
            continue
        attributes = _attributes(m[3])
        in_content = any(out.places[x] for x in CONTENT_TAGS)
        certain = _is_boilerplate(name, attributes, in_content)
        form = certain and name == "form" and not _is_boilerplate("div", attributes, in_content)
        kind = attributes.get("class", "").split()[:1] if name in CONTAINERS else []
        named = " ".join(attributes.get(x, "") for x in ("class", "id"))
        told = _WORDS.findall(named + " " + attributes.get("itemprop", "") + " " + attributes.get("rel", ""))
        byline = name in BYLINE_TAGS or not BYLINE_WORDS.isdisjoint(told)
        suspect = _is_suspect(name, attributes, in_content)
        comments = suspect and not COMMENT_WORDS.isdisjoint(_WORDS.findall(named))
        out.push(name, ".".join([name, *kind]), certain and not form, form or suspect, form, byline, comments)
    out.text(page[at:])
    return out


class Paths:
    """Tag paths from the root, each known by its number; 0 is the root's, and a path's parent has a lower number."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.up, self.depth, self.marks, self.inside, self.container, self.is_content = [0], [0], [0], [False], [0], [False]

    def number(self, up: int, tag: str, component: str, marked: bool) -> int:
        """The path of an element in ``up``; a marked one is under suspicion of being boilerplate."""
        key = (up, component + MARK if marked else component)
        if key not in self.numbers:
            self.numbers[key] = at = len(self.up)
            self.up.append(up)
            self.depth.append(self.depth[up] + 1)
            self.marks.append(self.marks[up] + marked)
            self.is_content.append(tag in CONTENT_TAGS)
            self.inside.append(self.inside[up] or tag in CONTENT_TAGS)
            self.container.append(at if tag in CONTAINERS else self.container[up])
        return self.numbers[key]


def nodes(page: str) -> tuple[Paths, list[tuple[int, int, str]]]:
    """The page's paths, and (path, block number, text) of each text node that is not certainly boilerplate, in page order.

    Elements with a boilerplate word that are no ordinary ones are marked in the path.
    """
    found = parsed(page)
    found.mark_lists()
    ordinary = found.is_ordinary()
    paths, of, bad = Paths(), [0], [False]
    for at in range(1, len(found.tag)):
        up, odd = found.parent[at], found.part[at] == at and not ordinary[at]
        of.append(paths.number(of[up], found.tag[at], found.component[at], odd))
        bad.append(found.bad[at] or bad[up] or (odd and found.form[at]))
    return paths, [(of[at], block, string) for at, block, string in found.texts if not bad[at]]


def path_scores(paths: Paths, parts: list[tuple[int, str]]) -> dict[int, float]:
    """The fused ratio of each path of (path, text) nodes; suspect nodes are smoothed among themselves."""
    odd = [x for x in parts if paths.marks[x[0]]]
    if odd and len(odd) < len(parts):
        return path_scores(paths, [x for x in parts if not paths.marks[x[0]]]) | path_scores(paths, odd)
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    for path, text in parts:
        count[path] += 1
        length[path] += len(text)
        marks[path] += sum(c in PUNCTUATION for c in text)
    ratio = [length[p] / count[p] for p, _ in parts]
    kernel = [math.exp(-(k * k) / 2) for k in range(-2, 3)]
    smooth: dict[int, float] = defaultdict(float)
    for i, (path, _) in enumerate(parts):
        near = [(kernel[k + 2], ratio[i + k]) for k in range(-2, 3) if 0 <= i + k < len(ratio)]
        smooth[path] += sum(w * r for w, r in near) / sum(w for w, _ in near)
    return {p: smooth[p] / n * (1 + math.log1p(marks[p] / n)) * (4 if paths.inside[p] else 1) * (SUSPECT if paths.marks[p] else 1) for p, n in count.items()}


def content_paths(paths: Paths, parts: list[tuple[int, str]], share: float = 0.3) -> set[int]:
    """The paths of the container that holds most text of the paths above the threshold."""
    scores = path_scores(paths, parts)
    if not scores:
        return set()
    mass: dict[int, int] = defaultdict(int)
    for path, text in parts:
        mass[path] += len(text)
    sure = [p for p in scores if not paths.marks[p]] or list(scores)
    mean = sum(scores[p] * mass[p] for p in sure) / max(1, sum(mass[p] for p in sure))
    chosen = {p for p in scores if scores[p] >= 0.5 * mean}
    weight: dict[int, float] = defaultdict(float)
    for p in chosen:
        weight[paths.container[p]] += mass[p] * scores[p]
    best = max(weight, key=lambda c: (weight[c], -paths.depth[c]))
    # what each path and those below it hold: paths, text, text times ratio
    below = [[0, 0, 0.0] for _ in paths.up]
    for p in scores:
        if p in chosen or not paths.marks[p]:
            below[p] = [1, mass[p], scores[p] * mass[p]]
    for p in range(len(below) - 1, 0, -1):
        below[paths.up[p]] = [a + b for a, b in zip(below[paths.up[p]], below[p])]
    # a container is left for the one around it while that one adds text of like ratio
    while best and not paths.is_content[best]:
        around = paths.container[paths.up[best]]
        added = [a - b for a, b in zip(below[around], below[best])]
        level = lambda x: x[2] / max(1, x[1])
        if not added[0] or level(added) < share * level(below[best]):
            break
        best = around
    inside = [False] * len(paths.up)
    for p in range(len(inside)):
        inside[p] = p == best or (p > 0 and inside[paths.up[p]])
    return {p for p in scores if inside[p] and (p in chosen or paths.marks[p] == paths.marks[best])}


def main_text(page: str) -> str:
    """The text of a page's content nodes, a line a block; empty if none."""
    paths, found = nodes(page)
    content = content_paths(paths, [(p, t.strip()) for p, _, t in found if t.strip()])
    blocks: dict[int, list[str]] = defaultdict(list)
    for path, block, text in found:
        if path in content:
            blocks[block].append(text)
    lines = (" ".join("".join(x).split()) for _, x in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of each page: the article without menus, forms, adverts and the like.

    A null page is empty and has the empty text; null ids and urls stay null; repeated rows are extracted
    each; extra columns are left out; an empty table gives no rows. A page is parsed whole.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = [main_text(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(parse, "page_id long, url string, text string")
