"""A page's leaf blocks: runs of text that no block-level tag interrupts, with the tags above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that end the block before them and the one within them.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page. For RAW ones, only their own end tag ends them.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
#: Within these, and for them, "/>" ends an element.
_FOREIGN = ("svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these open elements, up to the nearest one of the fences.
_IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_FENCE = frozenset({"td", "th", "table", "button", "body", "html"})

_NEXT = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile(r"""=\s*(["'])""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True, eq=False)
class Node:
    """An element with all words of its class, id and role. place: for those who derive something from it and what is above it."""

    tag: str
    names: tuple[str, ...]
    above: Node | None
    place: object = None


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None
    linked: int

    @property
    def path(self) -> list[Node]:
        """The elements above it, outermost first."""
        out, node = [], self.node
        while node is not None:
            out.append(node)
            node = node.above
        return out[::-1]


def _tag_end(page: str, at: int, hopeless: set[str]) -> int:
    """The place after the tag's `>`, quoted values aside; hopeless: quotes that don't occur again."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    pos = at
    while (m := _QUOTED.search(page, pos, end + 1)) is not None:
        if m[1] in hopeless:
            pos = m.end()
            continue
        close = page.find(m[1], m.end())
        if close < 0:
            hopeless.add(m[1])
            pos = m.end()
            continue
        pos = close + 1
        if pos > end:
            end = page.find(">", pos)
            if end < 0:
                return len(page)
    return end + 1


def blocks(page: str | None) -> list[Block]:
    """In page order; white space is one space, character references are decoded, empty blocks are left out."""
    page, out = page or "", []
    stack: list[Node] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = links = 0
    hopeless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(tags: frozenset[str] | set[str], fences: frozenset[str]) -> None:
        nonlocal links
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                for n in stack[i:]:
                    opened[n.tag] -= 1
                    links -= n.tag == "a"
                del stack[i:]
                return
            if stack[i].tag in fences:
                return

    pos = 0
    while pos < len(page):
        m = _NEXT.search(page, pos)
        text = page[pos : m.start()] if m else page[pos:]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        if not m[2]:
            if page.startswith("<!--", m.start()):
                end = page.find("-->", m.start() + 2)
                pos = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", m.start())
                pos = len(page) if end < 0 else end + 1
            continue
        tag, pos = m[2].lower(), _tag_end(page, m.end(), hopeless)
        if m[1]:
            if tag in BLOCK:
                flush()
            close({tag}, frozenset() if tag in BLOCK else BLOCK - {"p"})
            continue
        if tag in RAW:
            if page[pos - 2 : pos] != "/>" or tag in ("script", "style"):
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, pos)
                if tag == "xmp":  # shown as it stands
                    flush()
                    parts.append(html.escape(page[pos : end.start() if end else len(page)]))
                    flush()
                pos = _tag_end(page, end.end(), hopeless) if end else len(page)
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            close({"p"}, _FENCE)
            if tag in _HEADINGS and stack and stack[-1].tag in _HEADINGS:
                close(_HEADINGS, _FENCE)
            if tag in _IMPLIED:
                close(*_IMPLIED[tag])
        elif tag == "br":
            parts.append(" ")
        ended = page[pos - 2 : pos] == "/>" and (tag in _FOREIGN or any(opened.get(t) for t in _FOREIGN))
        if tag not in VOID and not ended:
            names = tuple(t.lower() for found in _NAMED.findall(page[m.end() : pos]) for v in found if v for t in _TOKEN.findall(v))
            stack.append(Node(tag, names, stack[-1] if stack else None))
            opened[tag] = opened.get(tag, 0) + 1
            links += tag == "a"
    flush()
    return out
