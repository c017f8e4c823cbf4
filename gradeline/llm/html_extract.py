"""Main text of web pages by scoring the element tree.

Paragraphs give points for their length and their commas to their ancestors, less with every step
up and less with the share of their text that lies in links. The container with the most points, or the
article around it, is kept. Outside of an article the siblings of that container belong to the text as well, unless most of theirs is
links. Elements whose kind, name or role says that they are not article text never take part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

#: A comment, a raw element with its text, a declaration, or a tag.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(/?)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What the start of an element ends, up to the nearest of the barriers.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ENDS_P = BLOCKS - {"br"}
DROPPED = frozenset(
    "head nav aside footer header form button select input menu dialog object embed canvas audio video map template".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption".split())
NOT_TEXT = re.compile(
    r"^(?:ad|ads|advert.*|adsense|banner.*|sponsor.*|promo.*|side-?bar.*|comments?|comment-.*|comments?-?(?:list|form|box|area|section|thread)s?|"
    r"respond|reactions|disqus.*|replies|cookies?|consent|"
    r"notice|alert|popup|modal|overlay|share|sharing|social|related|recommend.*|breadcrumbs?|menu|nav|navbar|navigation|footer|"
    r"header|masthead|newsletter|subscribe|subscription|widget|pagination|pager|toolbar|login|signup|hidden|skip-link)$"
)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
TEXT_NAMES = re.compile(r"^(?:article|body|content|entry|main|page|post|story|text|blog)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
LEAST_PARAGRAPH = 25


class Element:
    __slots__ = ("tag", "parent", "items", "points", "weight", "dropped", "length", "linked", "commas")

    def __init__(self, tag: str, parent: Element | None, weight: int = 0, dropped: bool = False):
        self.tag, self.parent, self.weight, self.dropped = tag, parent, weight, dropped
        self.items: list[Element | str] = []
        self.points = 0.0
        self.length = self.linked = self.commas = 0


def _is_not_text(name: str, in_article: bool) -> bool:
    """Does a class or id name something beside the article? ``has-sidebar`` does not.

    Around the article its first or last word is enough; inside it, where ``share-price`` may be text, the whole name counts.
    """
    if in_article:
        return NOT_TEXT.match(name) is not None
    parts = name.split("-")
    last = [] if len(parts) < 2 or parts[-2] in ("has", "with", "no", "is", "without") else parts[-1:]
    return any(map(NOT_TEXT.match, (name, *parts[:1], *last)))


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """(weight, dropped) of an element by its kind, names and role."""
    weight = 25 if tag in ("article", "main") else 0
    if tag in DROPPED:
        # the heading of an article is part of it
        return weight, not (tag == "header" and in_article)
    if not attributes.strip():
        return weight, False
    names: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names += value.lower().replace("_", "-").split()
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return weight, True
        elif name == "style" and HIDDEN.search(value):
            return weight, True
    if tag not in ("html", "body", "article", "main"):
        if any(_is_not_text(n, in_article) for n in names):
            return weight, True
    if any(TEXT_NAMES.match(n) for n in names):
        weight = max(weight, 25)
    return weight, False


def parse(page: str) -> Element:
    """The element tree; end tags that are missing are supplied, those without a start are passed over."""
    root = here = Element("html", None)
    articles = at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            here.items.append(html.unescape(page[at : token.start()]))
        at = token.end()
        tag = token[3] or token[7]
        if not tag:
            continue
        tag = tag.lower()
        if token[2] or token[6]:
            if tag == "br":
                here.items.append(Element("br", here))
                continue
            found = here
            while found is not None and found.tag != tag:
                found = found.parent
            if found is not None and found.parent is not None:
                while here is not found:
                    articles -= here.tag == "article"
                    here = here.parent
                articles -= here.tag == "article"
                here = here.parent
            continue
        ended, barrier = CLOSES.get(tag, (frozenset(), frozenset()))
        if tag in ENDS_P:
            ended, barrier = ended | {"p"}, barrier | (BLOCKS - {"p"})
        if ended:
            found = here
            while found is not None and found.tag not in ended and found.tag not in barrier:
                found = found.parent
            if found is not None and found.tag in ended:
                while here is not found.parent:
                    articles -= here.tag == "article"
                    here = here.parent
        weight, dropped = _judge(tag, token[4] or token[8] or "", articles > 0)
        element = Element(tag, here, weight, dropped)
        here.items.append(element)
        if tag not in VOID and not (token[5] or token[9]):
            here = element
            articles += tag == "article"
    if at < len(page):
        here.items.append(html.unescape(page[at:]))
    return root


def _below(root: Element) -> list[Element]:
    """The elements that are not dropped, each before its children."""
    found, todo = [], [root]
    while todo:
        element = todo.pop()
        found.append(element)
        todo += [x for x in reversed(element.items) if type(x) is Element and not x.dropped]
    return found


def _measure(elements: list[Element]) -> None:
    for element in reversed(elements):
        for item in element.items:
            if type(item) is Element:
                if not item.dropped:
                    element.length += item.length
                    element.linked += item.length if item.tag == "a" else item.linked
                    element.commas += item.commas
            else:
                text = item.strip()
                element.length += len(text)
                element.commas += text.count(",") + text.count("，") + text.count("、")


def _unlinked(element: Element) -> float:
    return 1 - element.linked / element.length if element.length else 0.0


def _best(elements: list[Element]) -> Element | None:
    for element in elements:
        plain = element.tag == "div" and not any(type(x) is Element and x.tag in BLOCKS for x in element.items)
        if (element.tag in PARAGRAPHS or plain) and element.length >= LEAST_PARAGRAPH:
            points = (1 + element.commas + min(element.length / 100, 3)) * _unlinked(element)
            above, step = element.parent, 0
            while above is not None:
                above.points += points / (1 if step == 0 else 2 * step if step < 2 else 3 * step)
                above, step = above.parent, step + 1
    scored = [e for e in elements if e.points > 0]
    return max(scored, key=lambda e: (e.points + e.weight) * _unlinked(e)) if scored else None


def _kept(root: Element) -> list[Element | str]:
    elements = _below(root)
    _measure(elements)
    best = _best(elements)
    if best is None:
        named = [e for tag in ("article", "main", "body") for e in elements if e.tag == tag]
        return named[:1] or [root]
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around or best
    if best.parent is None:
        return [best]
    article = best.tag in ("article", "main")
    kept: list[Element | str] = []
    for item in best.parent.items:
        if type(item) is str:
            if not article:
                kept.append(item)
        elif item is best:
            kept.append(item)
        elif not item.dropped and _unlinked(item) > 0.5 and (not article or item.points >= 0.2 * best.points):
            kept.append(item)
    return kept


def _texts(element: Element | str) -> Iterator[str]:
    """Texts in page order, with white space where blocks begin and end."""
    todo: list[Element | str] = [element]
    while todo:
        item = todo.pop()
        if type(item) is str:
            yield item
        elif not item.dropped:
            gap = [" "] if item.tag in BLOCKS else []
            todo += [*gap, *reversed(item.items), *gap]


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, white space collapsed, character references decoded."""
    if not page:
        return ""
    return " ".join("".join(t for kept in _kept(parse(page)) for t in _texts(kept)).split())


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, in one pass without a shuffle.

    A null or empty page has an empty text. Null ids and urls stay, repeated rows give repeated results, other
    columns are not read. Pages that are cut off or lack end tags are read as far as they go.
    """

    def of_row(page_id, url, page):
        text = main_text(page)
        return page_id, url, text, len(text)

    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(per_row(lambda: of_row, RESULT, rows=200), "page_id bigint, url string, text string, n_chars bigint")
