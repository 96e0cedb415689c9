"""A small tolerant HTML reader: a tree of elements and the text in their blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements without text of the page proper.
SILENT = frozenset("head script style title template svg canvas audio video object select option datalist textarea iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag closes these, where they are open nearer than the limits.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_NO_P = INLINE | {"p"}


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    names: str = ""
    role: str = ""
    hidden: bool = False


@dataclass
class Page:
    """elements: in page order, the first is the root. pieces: (element, block, text, inside a link)."""

    elements: list[Element] = field(default_factory=lambda: [Element("#root", -1, 0)])
    pieces: list[tuple[int, int, str, bool]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)}


def read_page(source: str) -> Page:
    """Never fails: what is no tag is text, what is not closed is closed at the end. Nesting has no limit."""
    page = Page()
    stack, block, at, links, silent = [0], 0, 0, 0, 0
    elements, pieces = page.elements, page.pieces
    #: Open elements by tag: a tag that is not open needs no search of the stack.
    held: Counter[str] = Counter()

    def close_to(n: int) -> None:
        nonlocal block, links, silent
        while len(stack) > n:
            tag = elements[stack.pop()].tag
            held[tag] -= 1
            block += tag not in INLINE
            links -= tag == "a"
            silent -= tag in SILENT

    def say(text: str) -> None:
        if text and not silent:
            pieces.append((stack[-1], block, html.unescape(text) if "&" in text else text, links > 0))

    n = len(source)
    while at < n:
        found = _OPEN.search(source, at)
        if not found:
            say(source[at:])
            break
        say(source[at : found.start()])
        if found[2] is None:
            end = source.find("-->", found.end()) + 3 if found[0] == "<!--" else source.find(">", found.end()) + 1
            at = end if end > 2 or (end > 0 and found[0] != "<!--") else n
            continue
        rest = _REST.match(source, found.end())
        end = rest.end() if rest else source.find(">", found.end()) + 1 or n
        tag, raw = found[2].lower(), source[found.end() : end - 1]
        at = end
        if found[1]:
            for i in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if elements[stack[i]].tag == tag:
                    close_to(i)
                    break
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in _NO_P or tag == "p":
            for i in range(len(stack) - 1, 0, -1) if held["p"] else ():
                if elements[stack[i]].tag == "p":
                    close_to(i)
                    break
                if elements[stack[i]].tag not in INLINE:
                    break
        closes, limits = _CLOSES.get(tag, ((), ()))
        for i in range(len(stack) - 1, 0, -1) if any(held[c] for c in closes) else ():
            if elements[stack[i]].tag in closes:
                close_to(i)
                break
            if elements[stack[i]].tag in limits:
                break
        block += tag not in INLINE
        if tag in VOID:
            continue
        found_attributes = attributes(raw) if raw and raw != "/" else {}
        style = found_attributes.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in found_attributes or "display:none" in style or found_attributes.get("aria-hidden") == "true"
        elements.append(Element(tag, stack[-1], len(stack), f"{found_attributes.get('class', '')} {found_attributes.get('id', '')}".strip().lower(), found_attributes.get("role", "").lower(), hidden))
        stack.append(len(elements) - 1)
        held[tag] += 1
        links += tag == "a"
        silent += tag in SILENT
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = stop.start() if stop else n
    return page


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()
