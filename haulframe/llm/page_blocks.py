"""HTML to blocks: the text runs of a page, each with its element.

A tolerant reader for what pages hold: optional end tags (``p``, ``li``,
table parts), stray end tags, raw text, comments, unclosed quotes and cut-off
pages.  Work is linear in the page's length; elements nested deeper than
``DEEPEST`` count as their ancestor's.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DEEPEST = 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption caption address summary".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html head body div section article main header footer nav aside form fieldset legend ul ol dl menu table thead tbody tfoot tr "
    "figure details dialog center dir hr search hgroup option optgroup select template".split())
#: Blocks that end an open paragraph.
NOT_IN_P = BLOCKS - frozenset("html head body td th tr thead tbody tfoot caption legend option optgroup select template".split())
#: What the start of an element closes, and the elements at which the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})), "tr": ({"tr", "td", "th"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select"})),
}
CELLS = frozenset(("td", "th", "caption"))
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th".split())
IN_HEAD = frozenset("head title style script meta link base noscript template".split())


@dataclass(slots=True)
class Element:
    name: str
    parent: int
    link: bool
    attributes: str
    in_article: bool
    holds_article: bool = False


@dataclass(slots=True)
class Page:
    """``elements`` in page order (0 is the root); ``blocks``: the element of each text run and its pieces (element, text)."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, list[tuple[int, str]]]] = field(default_factory=list)


def attributes_of(text: str) -> dict[str, str]:
    found = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def words_of(*values: str) -> list[str]:
    """The words of class names and ids, in lower case: ``siteHeader-top`` has site, header and top."""
    return [w.lower() for v in values for w in WORD.findall(v)]


class _Reader:
    def __init__(self) -> None:
        self.page = Page([Element("", -1, False, "", False)])
        self.stack = [0]
        self.open = {"": 1}
        self.pieces: list[tuple[int, str]] = []

    def text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], html.unescape(text) if "&" in text else text))

    def flush(self) -> None:
        if self.pieces:
            elements = self.page.elements
            at = self.stack[-1]
            while elements[at].name not in BLOCKS and elements[at].parent >= 0:
                at = elements[at].parent
            self.page.blocks.append((at, self.pieces))
            self.pieces = []

    def pop_to(self, depth: int) -> None:
        """Close all elements from ``depth`` of the stack on."""
        for i in self.stack[depth:]:
            self.open[self.page.elements[i].name] -= 1
        del self.stack[depth:]

    def find(self, names: set[str], barriers: frozenset | set) -> int | None:
        """Depth of the innermost open element of ``names`` inside the nearest barrier."""
        if any(self.open.get(n) for n in names):
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.page.elements[self.stack[depth]].name
                if name in names:
                    return depth
                if name in barriers:
                    return None
        return None

    def close(self, names: set[str], barriers: frozenset | set) -> None:
        depth = self.find(names, barriers)
        if depth is not None:
            self.pop_to(depth)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append((self.stack[-1], " "))
            return
        block = name in BLOCKS
        if block:
            self.flush()
        if self.open.get("head") and name not in IN_HEAD:
            self.close({"head"}, ())
        if name in NOT_IN_P:
            self.close({"p"}, CELLS)
        if name in HEADINGS and self.page.elements[self.stack[-1]].name in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if name in CLOSES:
            self.close(*CLOSES[name])
        if name == "a":
            self.close({"a"}, BLOCKS)
        if name in VOID or len(self.stack) > DEEPEST or (not block and attributes.endswith("/")):
            return
        parent = self.page.elements[self.stack[-1]]
        main = name in ("article", "main") or ("main" in attributes or "rticle" in attributes) and is_main(attributes_of(attributes))
        if main:
            for i in reversed(self.stack):
                if self.page.elements[i].holds_article:
                    break
                self.page.elements[i].holds_article = True
        self.page.elements.append(Element(name, self.stack[-1], parent.link or (name == "a" and "href" in attributes.lower()), attributes,
                                          parent.in_article or main))
        self.stack.append(len(self.page.elements) - 1)
        self.open[name] = self.open.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "br":
            self.pieces.append((self.stack[-1], " "))
            return
        if name not in BLOCKS:
            self.close({name}, BLOCKS)
            return
        if name in HEADINGS and not self.open.get(name):
            depth = self.find(HEADINGS, CELLS)
        else:
            depth = self.find({name}, () if name in TABLE_PARTS else CELLS)
        self.flush()
        if depth is not None:
            self.pop_to(depth)


def is_main(attributes: dict[str, str]) -> bool:
    return attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"


def read(text: str) -> Page:
    """The elements and blocks of one page."""
    reader, tag, pos = _Reader(), TAG, 0
    while pos < len(text):
        at = text.find("<", pos)
        if at < 0:
            reader.text(text[pos:])
            break
        reader.text(text[pos:at])
        m = tag.match(text, at)
        if m is None:
            after = text[at + 1:at + 3]
            if text.startswith("<!--", at):
                end = text.find("-->", at + 2)
                pos = end + 3 if end >= 0 else len(text)
            elif re.match(r"/?[a-zA-Z]", after):
                if tag is PLAIN_TAG:  # the page is cut off inside a tag
                    break
                tag, pos = PLAIN_TAG, at  # a quote is never closed: from here on quotes do not count
            elif after[:1] in ("!", "?", "/"):
                end = text.find(">", at)
                pos = end + 1 if end >= 0 else len(text)
            else:
                reader.text("<")
                pos = at + 1
            continue
        pos, name = m.end(), m[2].lower()
        if m[1]:
            reader.end(name)
            continue
        reader.start(name, m[3])
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, pos)
            pos = end.end() if end else len(text)
            reader.close({name}, ())
    reader.flush()
    return reader.page
