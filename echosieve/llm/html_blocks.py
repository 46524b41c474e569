"""Leaf blocks of an HTML page: its text between block-level tags, with the open elements."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

#: Fixed values of HTML: elements that break a line of text, that have no content, whose content
#: is not text of the page, and which open element a new one of its kind closes up to.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe "
    "legend li main menu nav noscript ol option p pre section select summary table tbody td "
    "template textarea tfoot th thead title tr ul video audio".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style title textarea iframe".split())
CLOSED_WITHIN = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"},
    "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"},
}
SAME = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_GOLD = re.compile(r'\bdata-gold="([01])"')
_PARTS = re.compile(r"[^a-z0-9]+")
_RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


INLINE = ("b", "i", "em", "a")


class Element:
    """An open element, linked to the one around it, so that blocks share their paths.

    ``fresh``: its features (tag and names) that no element around it has; ``inner``: the closest
    tag that is not ``INLINE``; ``gold``: the closest ``data-gold``.  ``score`` is for the reader.
    """

    __slots__ = ("parent", "tag", "names", "gold", "depth", "fresh", "inner", "score")

    def __init__(self, parent, tag, names, gold, fresh):
        self.parent, self.tag, self.names, self.fresh = parent, tag, names, fresh
        self.gold = parent.gold if gold is None and parent else gold
        self.depth = parent.depth + 1 if parent else 0
        self.inner = (parent.inner if parent else "none") if tag in INLINE else tag
        self.score = None

    def path(self):
        """The elements from the outermost to this one."""
        found, element = [], self
        while element.parent:
            found.append(element)
            element = element.parent
        return found[::-1]


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element, text, linked):
        self.element, self.text, self.linked = element, text, linked

    @property
    def gold(self):
        return self.element.gold


def _decoded(piece: str) -> str:
    return html.unescape(piece) if "&" in piece else piece


def blocks(page: str | None) -> list[Block]:
    """The blocks with any text, in page order.

    ``element``: the innermost open one; the names of an element are the parts of its class, id
    and role.  ``linked``: characters within links.  ``gold``: the ``data-gold`` of the closest
    element that has one, for labelled pages.  Broken markup is taken as it comes: a close tag
    without its open one is skipped, an open one ends with its parent.  Time and memory grow with
    the page, however deep its elements are.
    """
    page = page or ""
    root = Element(None, "none", (), None, ())
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements by tag
    solid: list[int] = []  # places of the open block-level elements
    held: Counter = Counter()  # features of the open elements
    found: list[Block] = []
    pieces: list[str] = []
    linked = at = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(stack[-1] if stack else root, text, linked))
            pieces.clear()
        linked = 0

    def own_features(tag: str, names: tuple) -> list[str]:
        return [f"tag:{tag}", *(f"name:{n}" for n in names)]

    def open_one(tag: str, names: tuple, gold: int | None):
        own = own_features(tag, names)
        fresh = tuple(f for f in own if not held[f])
        held.update(own)
        places[tag].append(len(stack))
        if tag in BLOCKS:
            solid.append(len(stack))
        stack.append(Element(stack[-1] if stack else root, tag, names, gold, fresh))

    def close_to(index: int):
        while len(stack) > index:
            element = stack.pop()
            held.subtract(own_features(element.tag, element.names))
            places[element.tag].pop()
            if solid and solid[-1] == len(stack):
                solid.pop()

    def last_of(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    while at < len(page):
        tag = _TAG.search(page, at)
        piece = page[at:tag.start() if tag else len(page)]
        if piece:
            text = _decoded(piece)
            pieces.append(text)
            if places["a"]:
                linked += len(text)
        if not tag:
            break
        at = tag.end()
        slash, name, rest = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        block = name in BLOCKS
        if slash:
            if block:
                flush()
            if name in places and places[name]:
                index = places[name][-1]
                if not block and solid and solid[-1] > index:
                    continue  # an inline end within a newer block
                close_to(index)
            continue
        if block:
            flush()
            if solid and stack[solid[-1]].tag == "p":  # a paragraph ends where a block begins
                close_to(solid[-1])
            if name in CLOSED_WITHIN:
                same = last_of(SAME.get(name, {name}))
                if same > last_of(CLOSED_WITHIN[name]):
                    close_to(same)
        elif name == "br":
            pieces.append(" ")
        if name in RAW:
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or rest.endswith("/"):
            continue
        names, gold = (), None
        if rest:
            names = tuple(sorted({
                part for m in _NAMES.finditer(rest)
                for part in _PARTS.split((m[1] or m[2] or m[3] or "").lower()) if part
            }))
            if "data-gold" in rest and (mark := _GOLD.search(rest)):
                gold = int(mark[1])
        open_one(name, names, gold)
    flush()
    return found
