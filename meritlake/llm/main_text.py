"""Main text of web pages by tree scoring.

Each page becomes a tree of elements. Every paragraph gives points, for its length and its
commas, to its parent and half of them to its grandparent; an element's points are discounted by
the share of its text that lies in links. The best element and those of its siblings that score
nearly as well, or are running text, headings, lists or sections without links themselves, are the
article. Blocks whose class says that they are something else are left out, unless they hold an
article or much of the page's text. Pages are independent rows, so the work is one pass without a
shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from meritlake.llm.frames import with_fields

# Fixed values of the HTML language: elements without content, elements whose content is not
# markup, and elements that start a line of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
# Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = BLOCK - frozenset("td th tr tbody thead tfoot legend summary body html".split())
# Elements that end when one of the same kind starts, and where that rule stops.
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
         "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Elements that are never part of an article.
APART = frozenset(
    "head nav header footer aside form button select input label dialog menu svg object audio video canvas "
    "math applet map".split()) | RAW
# Whole class names and ids of blocks that are not the article: parts of the layout, and texts of others. A name may
# have a place in front and name more parts behind (site-header, sidebar-left, cookie-notice), never another word
# (no-sidebar, content-sidebar-wrap).
_LAYOUT = (r"banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|notice|popup|modal|"
           r"overlay|share|sharing|social|related|recommended|widgets?|toolbar|pager|pagination|skip-link|hidden|legal|disclaimer")
_OTHERS = (r"ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|cookies?|consent|gdpr|newsletter|subscribe|"
           r"subscription|signup|login|comments?|replies|disqus|respond")
_PLACES = r"(?:(?:site|page|main|primary|secondary|mobile|global|top|bottom|left|right)[_-])?"
_MORE = rf"(?:[_-](?:{_LAYOUT}|{_OTHERS}|list|links?|items?|buttons?|bar|box|body|area|left|right|top|bottom|[0-9]+))*"
_LAYOUT_NAME = re.compile(rf"(?<!\S){_PLACES}(?:{_LAYOUT}){_MORE}(?!\S)", re.I)
_OTHERS_NAME = re.compile(rf"(?<!\S){_PLACES}(?:(?:{_LAYOUT})[_-])?(?:{_OTHERS}){_MORE}(?!\S)", re.I)
# A block with such a name stays when it holds so large a share of the page's unlinked text; what is
# named as the text of others has to be so long as well.
LAYOUT_SHARE, OTHERS_SHARE, OTHERS_SIZE = 0.2, 0.5, 80
# Texts of others are never the article of a page that has so much text in paragraphs outside them.
PARAGRAPHS_SIZE = 60
_APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Elements that hold an article whatever their class says.
_KEEPS = frozenset("html body article main".split())
# Blocks beside the best container that belong to it when they are not links.
_BESIDE = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl pre section blockquote table figure".split())
_PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())

# a quote opens a value only after an equals sign; a tag that does not end goes on to the end of the page
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_COMMA = re.compile("[,،、，]")


class Element:
    __slots__ = ("tag", "parent", "parts", "apart", "named", "points", "text_size", "link_size")

    def __init__(self, tag: str, parent: Element | None, apart: bool = False, named: str = ""):
        self.tag, self.parent, self.apart, self.named = tag, parent, apart, named
        self.parts: list[Element | str] = []
        self.points = 0.0
        self.text_size = self.link_size = 0


def _is_apart(tag: str, written: str) -> tuple[bool, str]:
    """Whether an element is never part of an article, and what its class or id says: layout, others or nothing."""
    if tag in APART:
        return True, ""
    named = ""
    if not written or written.isspace():
        return False, named
    for name, value in _ATTRIBUTE.findall(written):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if _OTHERS_NAME.search(value):
                named = "others"
            elif not named and _LAYOUT_NAME.search(value):
                named = "layout"
        elif tag in _KEEPS:
            continue
        elif name == "role":
            if value.lower() in _APART_ROLES:
                return True, named
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, named
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, named
    return False, named


def _part_named(root: Element) -> None:
    """Sets apart what is named so, but for blocks that hold an article or much of the page's unlinked text."""
    elements = _in_order(root)
    if not any(e.named and e.tag not in _KEEPS for e in elements):
        return
    links, sizes, holds = set(), {}, set()
    for element in elements:
        if element.tag == "a" or id(element.parent) in links:
            links.add(id(element))
        sizes[id(element)] = 0 if id(element) in links else sum(
            len(p.strip()) for p in element.parts if isinstance(p, str))
    for element in reversed(elements):
        if element.parent is not None:
            sizes[id(element.parent)] += sizes[id(element)]
            # an article that is named as the text of others is a comment or an advertisement
            if element.tag in ("article", "main") and element.named != "others" or id(element) in holds:
                holds.add(id(element.parent))
    beside = set()
    outside = 0
    for element in elements:
        if element.named and element.tag not in _KEEPS and id(element) not in holds or id(element.parent) in beside:
            beside.add(id(element))
        elif element.tag == "p":
            outside += sizes[id(element)]
    for element in elements:
        if element.named and element.tag not in _KEEPS and id(element) not in holds:
            size, of_others = sizes[id(element)], element.named == "others"
            much = size > 0 and size >= sizes[id(root)] * (OTHERS_SHARE if of_others else LAYOUT_SHARE)
            element.apart = not much or of_others and (size < OTHERS_SIZE or outside >= PARAGRAPHS_SIZE)


def parse(page: str) -> Element:
    """The page's tree; text keeps its character references. Ends that are missing are put where they must be."""
    root = here = Element("#page", None)
    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            here.parts.append(page[at:])
            break
        if found.start() > at:
            here.parts.append(page[at:found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            scope = here
            while scope is not None and scope.tag != tag:
                scope = scope.parent
            if scope is not None and scope.parent is not None:
                here = scope.parent
            continue
        if tag in ENDS_PARAGRAPH:
            # inline elements left open inside the paragraph end with it
            scope = here
            while scope.tag not in BLOCK and scope.parent is not None:
                scope = scope.parent
            if scope.tag == "p":
                here = scope.parent
        if tag in ITEMS:
            same, stop = ITEMS[tag]
            scope, last = here, None
            while scope is not None and scope.tag not in stop:
                if scope.tag in same:
                    last = scope
                scope = scope.parent
            if last is not None and scope is not None:
                here = last.parent
        element = Element(tag, here, *_is_apart(tag, found[3]))
        here.parts.append(element)
        if tag in VOID or found[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        here = element
    _part_named(root)
    return root


def _in_order(root: Element) -> list[Element]:
    """Elements that can be part of an article, parents before their children."""
    found, waiting = [], [root]
    while waiting:
        element = waiting.pop()
        found.append(element)
        waiting.extend(p for p in reversed(element.parts) if not isinstance(p, str) and not p.apart)
    return found


def _plain(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def _own_text(element: Element) -> str:
    """Text of a paragraph with its inline elements, without blocks inside."""
    parts, waiting = [], list(reversed(element.parts))
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            parts.append(part)
        elif part.tag == "br":
            parts.append(" ")
        elif not part.apart and part.tag not in BLOCK:
            waiting.extend(reversed(part.parts))
    return "".join(parts)


def best_parts(root: Element) -> list[Element]:
    """The best container and the siblings that belong to it, in page order."""
    elements = _in_order(root)
    links = set()
    for element in elements:
        if element.tag == "a" or id(element.parent) in links:
            links.add(id(element))
        size = sum(len(p.strip()) for p in element.parts if isinstance(p, str))
        element.text_size += size
        if id(element) in links:
            element.link_size += size
    for element in reversed(elements):
        if element.parent is not None:
            element.parent.text_size += element.text_size
            element.parent.link_size += element.link_size
    scored = []
    for element in elements:
        loose = element.tag in ("#page", "html", "body", "div", "section", "article", "main") and any(
            isinstance(p, str) and not p.isspace() for p in element.parts)
        if element.tag not in _PARAGRAPHS and not loose:
            continue
        text = _plain(_own_text(element))
        if not text:
            continue
        points = 1 + len(_COMMA.findall(text)) + min(len(text) / 100, 3)
        owner = element if loose else element.parent
        for share, holder in ((1, owner), (0.5, owner.parent if owner is not None else None)):
            if holder is not None:
                scored.append(holder)
                holder.points += share * points
    if not scored:
        return []
    for element in {id(e): e for e in scored}.values():
        element.points *= 1 - element.link_size / max(1, element.text_size)
    best = max(scored, key=lambda e: e.points)  # ties: the first in page order
    # lists, tables and quotations are parts of what holds them
    while best.parent is not None and best.tag in ("ul", "ol", "dl", "table", "tbody", "tr", "blockquote", "p", "pre", "a", "b", "i", "span"):
        best = best.parent
    # an article holds all of itself, also when one of its sections scores best
    scope = best
    while scope is not None:
        if scope.tag in ("article", "main"):
            best = scope
            break
        scope = scope.parent
    if best.parent is None:
        return [best]
    least = max(10.0, best.points * 0.2)
    chosen = []
    for sibling in best.parent.parts:
        if isinstance(sibling, str) or sibling.apart:
            continue
        if sibling is best or sibling.points >= least:
            chosen.append(sibling)
        elif sibling.tag == "p":
            text = _plain(_own_text(sibling))
            linked = sibling.link_size / max(1, sibling.text_size)
            if len(text) > 80 and linked < 0.25 or text and not linked and re.search(r"[.!?]\s|[.!?]$", text):
                chosen.append(sibling)
        elif sibling.tag in _BESIDE and sibling.text_size and sibling.link_size < 0.25 * sibling.text_size:
            chosen.append(sibling)
    return chosen


def blocks_of(parts: list[Element]) -> list[str]:
    """Texts of the blocks in page order; a block ends where a block element starts or ends."""
    blocks, open_block = [], []

    def close() -> None:
        text = _plain("".join(open_block))
        if text:
            blocks.append(text)
        open_block.clear()

    for part in parts:
        close()
        waiting: list[Element | str | None] = [part]
        while waiting:
            item = waiting.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                open_block.append(item)
            elif item.apart:
                continue
            elif item.tag == "br":
                open_block.append(" ")
            else:
                if item.tag in BLOCK:
                    close()
                    waiting.append(None)
                waiting.extend(reversed(item.parts))
    close()
    return blocks


def main_text(page: str | None) -> str:
    """Blocks of the article joined by an empty line; empty when the page has no text."""
    return "\n\n".join(blocks_of(best_parts(parse(page)))) if page else ""


def extract_main_text(pages: DataFrame, markup: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the markup by default) with text and n_chars.

    A null page counts as empty and has an empty text. Input columns named text or n_chars are
    replaced. Rows, repeated or not, are independent; whole pages are read, however long.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in (markup, "text", "n_chars")]
    given = pages.select(*[pages[c] for c in keep], pages[markup].alias("__page"))
    schema = with_fields(given.schema, "text string, n_chars long", drop_last=True)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"])

    return given.mapInArrow(extract, schema)
