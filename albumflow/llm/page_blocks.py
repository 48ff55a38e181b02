"""Leaf blocks of web pages: a forgiving scan of HTML into runs of text with the elements they stand in.

Text between two edges of block-level elements is one block; inline elements, line breaks and comments do
not end it.  Scripts, styles, templates, drawings, embedded documents and the page's head give no text.  Elements that a
browser closes by itself (paragraphs, list items, table cells) are closed.  Time and memory are linear in
the page's size, whatever its markup.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from typing import NamedTuple

BLOCKS = set(
    "address article aside audio blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr"
    " html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, up to their own end tag.
OPAQUE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style textarea title noscript iframe noembed noframes xmp".split()}
#: Elements whose whole content is left out.
HIDDEN = ("head", "template", "svg", "math")
_TABLE = set("table caption thead tbody tfoot tr td th".split())
_LISTS = ("ul", "ol", "dl", "menu", "dir", "table")
#: Which open elements a start tag closes, unless an element of the second group stands between.
_CLOSES = {
    "li": (("li",), _LISTS), "dt": (("dt", "dd"), _LISTS), "dd": (("dt", "dd"), _LISTS), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
OUTER, INNER = 8, 12  # elements of a block's path that are kept, from the page and from the block

_STOP = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_HINT = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element(NamedTuple):
    name: str
    hints: tuple[str, ...]  # words of its class, id and role


class Block(NamedTuple):
    path: tuple[Element, ...]  # block-level elements, the page's first
    text: str
    linked: int  # characters inside links


def _hints(attributes: str) -> tuple[str, ...]:
    found = (part.lower() for m in _HINT.finditer(attributes) for part in _PART.findall(m[1] or m[2] or m[3] or ""))
    return tuple(dict.fromkeys(found))


class _Page:
    """The open elements and the block being read."""

    def __init__(self):
        self.blocks: list[Block] = []
        self._open: list[tuple[str, tuple[Element, ...]]] = []
        self._at: dict[str, list[int]] = defaultdict(list)  # places of each name's open elements
        self._block_at: list[int] = []  # places of block-level ones
        self._pieces: list[str] = []
        self._path: tuple[Element, ...] | None = None
        self._linked = 0

    def text(self, raw: str) -> None:
        if any(self._at[h] for h in HIDDEN):
            return
        text = unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if self._path is None and not text.isspace():
            self._path = self._open[-1][1] if self._open else ()
        if self._at["a"]:
            self._linked += len(text)

    def edge(self) -> None:
        """A block ends here."""
        if self._path is not None:
            self.blocks.append(Block(self._path, " ".join("".join(self._pieces).split()), self._linked))
        self._pieces, self._path, self._linked = [], None, 0

    def _last(self, names) -> int:
        return max((self._at[n][-1] for n in names if self._at[n]), default=-1)

    def _close(self, place: int) -> None:
        """End the element at this place and all inside it."""
        while len(self._open) > place:
            name, _ = self._open.pop()
            self._at[name].pop()
            if name in BLOCKS:
                self._block_at.pop()

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.edge()
            for foreign in ("svg", "math"):  # left open
                if self._at[foreign] and not self._at["foreignobject"]:
                    self._close(self._at[foreign][0])
            if name not in ("head", "html") and self._at["head"]:
                self._close(self._at["head"][0])
            for closed, between in (_CLOSES.get(name, ((), ())), (("p",), ("td", "th", "caption", "button", "table"))):
                place = self._last(closed)
                if place > self._last(between):
                    self._close(place)
        elif name == "a" and self._at["a"] and self._at["a"][-1] > (self._block_at[-1] if self._block_at else -1):
            self._close(self._at["a"][-1])
        if name == "br":
            self.text(" ")
        if name in VOID:
            return
        path = self._open[-1][1] if self._open else ()
        if name in BLOCKS:
            path = (*path, Element(name, _hints(attributes) if "=" in attributes else ()))
            if len(path) > OUTER + INNER:
                path = path[:OUTER] + path[-INNER:]
            self._block_at.append(len(self._open))
        self._at[name].append(len(self._open))
        self._open.append((name, path))

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.edge()
            least = -1 if name in _TABLE else self._last(("td", "th", "caption"))
        else:  # an inline element ends only what is inside it
            least = self._block_at[-1] if self._block_at else -1
        if self._at[name] and self._at[name][-1] > least:
            self._close(self._at[name][-1])


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, or -1; one inside a quoted value does not."""
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.start()
        close = page.find(m[1], m.end())
        at = m.end() if close < 0 else close + 1
    return -1


def page_blocks(page: str) -> list[Block]:
    """All blocks of a page that have text, in order."""
    out, at = _Page(), 0
    while (tag := page.find("<", at)) >= 0:
        if tag > at:
            out.text(page[at:tag])
        if m := _NAME.match(page, tag + 1):
            end = _tag_end(page, m.end())
            name = m[0].lower()
            if end >= 0 and name in OPAQUE:
                if name != "noscript" and name in BLOCKS:
                    out.edge()
                close = OPAQUE[name].search(page, end + 1)
                end = page.find(">", close.end()) if close else -1
            elif end >= 0:
                out.start(name, page[m.end() : end])
        elif page.startswith("<!--", tag):
            end = page.find("-->", tag + 2)
            end = end + 2 if end >= 0 else -1
        elif m := _NAME.match(page, tag + 2) if page.startswith("</", tag) else None:
            end = _tag_end(page, m.end())
            if end >= 0:
                out.end(m[0].lower())
        elif page[tag + 1 : tag + 2] in ("!", "?", "/"):
            end = page.find(">", tag)
        else:  # a bare < is text
            out.text("<")
            end = tag
        if end < 0:  # markup up to the end of the page
            at = len(page)
            break
        at = end + 1
    out.text(page[at:]) if at < len(page) else None
    out.edge()
    return out.blocks
