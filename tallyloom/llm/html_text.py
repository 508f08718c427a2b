"""Main text of web pages by line-block distribution.

A page is cut into lines: its blocks of text, between tags that end a block. A line's
length is what the distribution looks at, and markup is looked at for lengths alone:

* inside menus, footers, forms, adverts, comments and other furniture it is nothing;
* of a line that is mostly link text only a character counts as nothing, so menus
  without a name are flat;
* inside the page's article or main element every character counts as ``SURGE``, and
  outside of it, on such a page, or in an element of a doubtful class, as a quarter;
* a heading's characters count fourfold.

Where a line and the next lie in different elements, neither inside the other nor
alike in name and class, and where the article ends, empty lines are put between
them. Lengths are summed over
windows of ``BLOCK_LINES`` lines. The text surges where a sum reaches ``SURGE`` and
dives where it returns to nothing, and lines between the last rise from nothing and
the next dive are kept if the text surges between them. Kept as well is a line that
lies beside kept ones in the same element: a closing line after a menu, a paragraph
that is one reference link. Nothing else is dropped, whatever its share of the page.

Defined results: a null or empty page has no text. Text without any tag is one
block and is kept whatever its length, as are all blocks of a page on which nothing
surges. A page that is furniture alone has no text. Equal blocks of a page stay as
often as they stand there; repeated rows give a row each. Very long pages are read
whole. An empty table gives no rows. Unknown character references stay as written.
Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines in a window, and empty lines between elements that have nothing to do with each other.
BLOCK_LINES = 3
#: Length of a window at which text surges.
SURGE = 80
#: Weight of a character outside of the article, where there is one, or in an element of a doubtful class; and in a heading.
DOUBT, HEADING = 0.25, 4.0
#: Share of a line's characters in links from which it counts as a menu's.
LINK_SHARE = 0.6

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav footer aside form head menu button dialog label fieldset legend datalist output".split())
_MAIN = frozenset(("article", "main"))
#: Elements a start tag of the same kind closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAMED = re.compile(r"""\b(class|id|role|data-component|data-testid|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# fixed values: words by which classes and ids name furniture; words around them that still name it (comment-list) and that don't (has-sidebar)
_NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promos promotion promoted"
    " nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager toc tabs toolbar topbar"
    " sidebar sidebars aside rail widget widgets related recommended recommendations recirc trending popular teaser teasers"
    " footer foot colophon copyright legal disclaimer masthead siteheader header"
    " comment comments commentlist disqus reply replies respond responses discussion"
    " cookie cookies consent gdpr ccpa notice notices notification notifications alert popup modal overlay lightbox paywall toast"
    " newsletter subscribe subscription signup signin login register search searchbox searchform form share sharing social socials follow"
    " skip hidden sr print noprint tags taglist".split()
)
_STATES = frozenset("has have no not with without is are show hide js open closed enabled disabled tag category type format status post hentry".split())
_AROUND = frozenset(
    "list lists box boxes block blocks container wrapper wrap section area slot unit inner outer item items link links bar row column col left right top bottom main content"
    " signup form banner posts articles stories icons buttons button group panel header footer title heading text message body thread template only reader".split()
)
_IN_ARTICLES = frozenset("header foot footer banner share legal form print alert popular search discussion notice copyright register".split())
_ARTICLE_WORDS = frozenset("article post entry story content".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose lines belong together.
_CONTAINERS = frozenset("html body div section article main nav aside header footer form ul ol dl table figure blockquote details fieldset center".split())
_SPACE = re.compile(r"\s+")


#: How an element is known for furniture: not at all but by a word that raises doubt, by a compound class or id, by a whole one, by its tag, role or being hidden.
_DOUBT, _WITHIN, _WHOLE, _SURE = range(1, 5)


def _named(one: str) -> int:
    """What a class or id says of its element."""
    low = one.lower()
    if low in _NOT_TEXT:
        return _WHOLE
    words = _WORDS.findall(_CAMEL.sub(" ", one).lower())
    pairs = ["".join(two) for two in zip(words, words[1:], strict=False)]
    found = _NOT_TEXT.intersection([*words, *pairs])
    if not found or found <= _IN_ARTICLES and _ARTICLE_WORDS & set(words):
        return 0
    if words[0] not in _STATES and (words[-1] in _NOT_TEXT or pairs[-1:] and pairs[-1] in _NOT_TEXT or words[-1] in _AROUND or words[-1].isdigit()):
        return _WITHIN
    return _DOUBT


def _furniture(name: str, rest: str, inside_main: bool) -> int:
    if name in _FURNITURE:
        return _SURE
    if name == "header":
        return 0 if inside_main else _SURE
    if name in ("html", "body", "main"):
        return _SURE if rest and _HIDDEN.search(rest) else 0
    if not rest or "=" not in rest and "hidden" not in rest:
        return 0
    if _HIDDEN.search(rest):
        return _SURE
    most = 0
    for key, *values in _NAMED.findall(rest):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "role":
            if value.strip().lower() in _ROLES:
                return _SURE
        elif key == "itemprop":
            if value.strip().lower() == "comment":
                return _SURE
        else:
            most = max([most, *map(_named, value.split())])
    return most


class _Article:
    """An article or main element: where it and the elements around it begin, its characters, and what makes it furniture."""

    def __init__(self, opened: list[int], known: int):
        self.opened, self.known, self.size = opened, known, 0


class Line(NamedTuple):
    """A block with text: characters of it in links, how it is known for furniture, whether an article or main element or a heading holds it, its container."""

    text: str
    linked: int
    known: int
    main: bool
    heading: bool
    container: int


class Page(NamedTuple):
    """The lines of a page, and of each container the one around it (-1: none) and its name with its classes."""

    lines: list[Line]
    around: list[int]
    names: list[str]


def read(html: str) -> Page:
    """The lines of a page.

    The article with the most text isn't taken for furniture by words within classes
    or ids of it or of what is around it; nor by any, where no other article has text.
    """
    page, articles = _read(html, frozenset())
    best = max(articles, key=lambda a: (a.known < _SURE, a.size), default=None)
    if best and best.size and (best.known == _WITHIN or best.known == _WHOLE and not any(x.main and x.known < _WITHIN for x in page.lines)):
        page, _ = _read(html, frozenset(best.opened))
    return page


def _read(html: str, spared: frozenset[int]) -> tuple[Page, list[_Article]]:
    """The page, with no class or id looked at of elements that begin at ``spared``; and its articles."""
    page = Page([], [-1], [""])
    stack: list[tuple[str, int, bool, bool, int]] = []  # open elements: name, what they and those around are known by, in the article, in a heading, container
    around: list[tuple[int, int, _Article | None, bool]] = []  # where they begin, what they are known by, their article, in furniture inside it
    articles: list[_Article] = []
    pieces: list[str] = []
    linked = links = known_by = container = 0
    main = heading = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                page.lines.append(Line(text, linked, known_by, main, heading, container))
                if around and around[-1][2] and not around[-1][3]:
                    around[-1][2].size += len(text)
            pieces.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal known_by, main, heading, container, links
        for name, *_ in stack[at:]:
            links -= name == "a"
        del stack[at:], around[at:]
        known_by, main, heading, container = stack[-1][1:] if stack else (0, False, False, 0)

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text.strip())

    at = 0
    for tag in _TAG.finditer(html):
        if tag.start() > at:
            add(html[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if name is None:
            raw = tag["raw"]
            if raw and raw.lower() == "title":
                continue
            if tag[0].startswith("<![CDATA["):
                add(tag[0][9:-3])
            continue
        name = name.lower()
        if name in _BLOCKS:
            flush()
        if tag["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in _VOID:
            continue
        closes = _CLOSES.get(name)
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    close(i)
                    break
                if stack[i][0] in _BLOCKS:
                    break
        elif name in _BLOCKS and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        rest = tag["rest"]
        if rest.rstrip().endswith("/") and name not in _BLOCKS:
            continue
        known = _furniture(name, rest, main)
        if known < _SURE and tag.start() in spared:
            known = 0
        _, outer, article, inner = around[-1] if around else (0, 0, None, False)
        if name in _MAIN:
            article, inner = _Article([*(a[0] for a in around), tag.start()], max(outer, known)), False
            articles.append(article)
        else:
            inner = inner or known >= _WITHIN
        around.append((tag.start(), max(outer, known), article, inner))
        if name in _CONTAINERS:
            page.around.append(container)
            page.names.append(" ".join([name, *(v or w or x for key, v, w, x in _NAMED.findall(rest) if key.lower() == "class")]))
            container = len(page.around) - 1
        main = main or name in _MAIN or 'role="main"' in rest
        heading = heading or name in _HEADINGS
        known_by = max(known_by, known)
        stack.append((name, known_by, main, heading, container))
        links += name == "a"
    if at < len(html):
        add(html[at:])
    flush()
    return page, articles


def lengths(page: Page) -> list[float]:
    """What each line counts."""
    has_main = any(x.main and x.known < _WITHIN for x in page.lines)
    out = []
    for x in page.lines:
        if x.known >= _WITHIN:
            out.append(0.0)
        elif x.main:
            out.append(float(SURGE * len(x.text)))
        elif x.linked > LINK_SHARE * len(x.text):
            out.append(0.0)
        else:
            out.append((len(x.text) - x.linked) * (HEADING if x.heading else 1.0) * (DOUBT if has_main or x.known == _DOUBT else 1.0))
    return out


def _parted(page: Page, a: int, b: int) -> bool:
    """Whether two containers have nothing to do with each other."""
    for x, y in ((a, b), (b, a)):
        while x > y:  # containers are numbered as they open
            x = page.around[x]
        if x == y:
            return False
    return page.around[a] != page.around[b] or page.names[a] != page.names[b]


def stretches(lengths: list[float], surge: float, window: int = BLOCK_LINES) -> list[tuple[int, int]]:
    """From surge to dive: where the sums of line lengths over windows leave nothing, by ``surge`` once, and return to it."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    found = []
    i = 0
    while i < len(lengths):
        if not lengths[i]:
            i += 1
            continue
        end = i
        while end < len(lengths) and sums[end]:
            end += 1
        if max(sums[i:end]) >= surge:
            last = max(j for j in range(i, end) if lengths[j]) + 1
            found.append((i, last))
        i = max(end, i + 1)
    return found


def kept_lines(page: Page, counts: list[float]) -> list[int]:
    """The numbers of the lines between surge and dive, and of those beside them."""
    spread, line_of = [], []
    for i, x in enumerate(page.lines):
        before = page.lines[i - 1] if i else x
        if x.main != before.main or _parted(page, before.container, x.container):
            spread += [0.0] * BLOCK_LINES
            line_of += [-1] * BLOCK_LINES
        spread.append(counts[i])
        line_of.append(i)
    spans = stretches(spread, SURGE) or stretches(spread, 0)
    text = {line_of[j] for a, b in spans for j in range(a, b) if spread[j]}
    beside = {page.lines[i].container for i in text}
    return [i for i, x in enumerate(page.lines) if i in text or x.known < _WITHIN and x.container in beside]


def main_text(html: str | None) -> str:
    """The blocks of a page's main text, joined by one line feed."""
    page = read(html or "")
    return "\n".join(page.lines[i].text for i in kept_lines(page, lengths(page)))


def extract(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """The columns ``keep`` and text, n_chars (code points) of every page."""
    kept = pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("__html"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [main_text(x) for x in batch.column("__html").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"), "html", "page_id", "url")
