"""HTML cut into leaf blocks: runs of text between block-level tags, with the path of tags and of class and id words above each."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Fixed values of HTML: elements that begin and end a block, that have no end tag, whose content isn't text, and that end an open one of the same set.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol option optgroup p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select div article section body".split())
#: Elements in which "/>" ends an element and which a block ends, and those in them that hold blocks again.
FOREIGN, HOLDS = frozenset(["svg", "math"]), frozenset(["foreignobject", "desc", "annotation-xml"])
_UNQUOTED = re.compile(r"=[ \t\n\r\f]*[^ \t\n\r\f\"'>]+\Z")
#: Attributes whose words tell what a block is.
NAMED = frozenset("class id role aria-hidden itemprop".split())
#: Elements that can't be in a paragraph, so that they end it.
ENDS_P = BLOCK - frozenset("body head html label button option optgroup select".split())

#: An attribute: a name, and a value in quotes if one begins right after "=", else up to white space. A quote elsewhere is a plain character, and so is one
#: that is never closed.
_ATTRIBUTE = r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>]*+)))?+"""
_PLAIN = re.sub(r"\((?=\[)", "(?:", _ATTRIBUTE)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\r\f/>]*)((?:[ \t\n\r\f/]++|{_PLAIN})*+)(?:>|\Z)", re.S)
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """An element's place: its tag with its class and id words, and the node above. Nodes of equal paths are one, by their parent's ``below``."""

    __slots__ = ("names", "above", "depth", "below", "vector")

    def __init__(self, names: tuple[str, ...] = (), above: Node | None = None):
        self.names, self.above, self.depth, self.below, self.vector = names, above, above.depth + 1 if above else 0, {}, None

    def child(self, names: tuple[str, ...]) -> Node:
        if (n := self.below.get(names)) is None:
            n = self.below[names] = Node(names, self)
        return n

    def path(self) -> list[tuple[str, ...]]:
        """The names from the page's root down to this node."""
        out, at = [], self
        while at.above:
            out.append(at.names)
            at = at.above
        return out[::-1]


@dataclass
class Leaf:
    node: Node
    text: str
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for kind, a, b, c in _ATTRIBUTES.findall(attributes) if attributes else ():
        kind = kind.lower()
        if kind == "hidden" or kind == "aria-hidden" and (a or b or c).lower() == "true":
            out.append("hidden")
        elif kind in NAMED:
            out += [f".{w.lower()}" for w in _WORDS.findall(a or b or c)]
    return tuple(out)


def leaves(html: str, root: Node | None = None) -> list[Leaf]:
    """The blocks that have text, in page order; white space is one space. Comments and what is in ``RAW`` (scripts, styles, titles and the like) aren't text.
    Nodes are made below ``root``, which pages may share."""
    out: list[Leaf] = []
    root = root or Node()
    stack: list[Node] = []
    opened: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    links, foreign, at, size = 0, 0, 0, len(html)
    low = None

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                out.append(Leaf(stack[-1] if stack else root, text, sum(len(p.strip()) for p, inside in parts if inside)))
            parts.clear()

    def close(k: int) -> None:
        nonlocal links, foreign
        for e in stack[k:]:
            links -= e.names[0] == "a"
            foreign -= e.names[0] in FOREIGN
            opened[e.names[0]] -= 1
        del stack[k:]

    while at < size:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else size
        if stop > at:
            parts.append((unescape(html[at:stop]), links > 0))
        if not m:
            break
        at, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                parts.append((" ", False))
                continue
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened.get(tag) else ():
                if stack[k].names[0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].names[0] in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag == "br" or tag == "wbr":
            parts.append((" ", False) if tag == "br" else ("", False))
            continue
        if tag in BLOCK:
            flush()
        if (foreign or tag in FOREIGN) and m[3].endswith("/") and not _UNQUOTED.search(m[3]):
            continue
        if foreign and tag in BLOCK and tag != "title":
            first = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].names[0] in HOLDS:
                    break
                first = k if stack[k].names[0] in FOREIGN else first
            if first is not None:
                close(first)
        if tag in RAW:
            low = html.lower() if low is None and len(html.lower()) == size else low
            end = (low or html).find(f"</{tag}", at)
            at = size if end < 0 else end
            if end >= 0:
                at = e + 1 if (e := html.find(">", end)) >= 0 else size
            if tag == "textarea":
                flush()
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1) if opened.get("p") else ():
                if stack[k].names[0] == "p":
                    close(k)
                    break
                if stack[k].names[0] in SCOPES:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1) if any(map(opened.get, CLOSES[tag])) else ():
                if stack[k].names[0] in CLOSES[tag]:
                    close(k)
                    if tag != "tr":
                        break
                elif stack[k].names[0] in SCOPES:
                    break
        if tag not in VOID:
            links += tag == "a"
            foreign += tag in FOREIGN
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((stack[-1] if stack else root).child((tag, *_names(m[3]))))
    flush()
    return out
