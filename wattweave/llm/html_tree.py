"""HTML to a tree of block elements with features, and its text blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

# Fixed values of HTML: elements without an end tag, with raw text, that break lines, and what closes a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button datalist".split())
TO_THE_END = frozenset("script style textarea title iframe".split())  # without an end tag, all that follows is theirs
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head".split()
)
CLOSES_P = BLOCKS - frozenset("html body dd dt li legend summary td th tr tbody thead tfoot caption figcaption head".split())
HOLDS_P = ("td", "th", "table", "article", "body")  # an open p outside the uppermost of these stays open
# An element that starts closes an open one of these, up to the element that holds them.
SIBLINGS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"),
    "tfoot": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "body": ("head", "html"),
}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}

# A quote opens a value only behind "="; one that nothing closes stands for itself.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>?""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """Nodes in document order (a parent before its children) and text blocks (node, text) in document order."""

    tags: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)  # of the node's own text
    linked: list[int] = field(default_factory=list)  # of them, inside links


def parse(source: str) -> Page:
    """Malformed markup is taken as browsers take it, as far as blocks go: nothing fails."""
    page = Page()
    stack: list[int] = []
    heights: dict[str, list[int]] = defaultdict(list)  # where elements of a tag are open in the stack, lowest first
    text: list[str] = []
    link_from = -1  # height of the stack at which a link opened

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                page.blocks.append((stack[-1], line))

    def open_node(tag: str, attributes: str) -> None:
        page.tags.append(tag)
        page.attributes.append(attributes)
        page.parents.append(stack[-1] if stack else -1)
        page.chars.append(0)
        page.linked.append(0)
        heights[tag].append(len(stack))
        stack.append(len(page.tags) - 1)

    def close_to(height: int) -> None:
        nonlocal link_from
        while len(stack) > height:
            heights[page.tags[stack.pop()]].pop()
        if link_from > height:
            link_from = -1

    def top(tags: Iterable[str]) -> int:
        """Height of the uppermost open element of these; -1 where none is open."""
        return max((heights[t][-1] for t in tags if heights[t]), default=-1)

    def add(run: str) -> None:
        if run:
            text.append(run)
            n = len(run) - run.count(" ")
            page.chars[stack[-1]] += n
            if link_from >= 0:
                page.linked[stack[-1]] += n

    open_node("root", "")
    closers: dict[str, re.Pattern | None] = {}
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link_from = -1
            elif tag == "br":
                text.append(" ")
            elif tag == "p" and not heights[tag]:
                flush()
            elif tag in BLOCKS and heights[tag]:
                flush()
                close_to(heights[tag][-1])
            continue
        if tag in RAW:
            if tag != "svg" or not m[3].endswith("/"):
                if tag not in closers:
                    closers[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)
                close = closers[tag].search(source, at) if closers[tag] else None
                if close is None:
                    closers[tag] = None  # nor is there one for a later element
                at = close.end() if close else end if tag in TO_THE_END else at
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            link_from = len(stack)
        elif tag in BLOCKS:
            flush()
            if tag in CLOSES_P and top(("p",)) > top(HOLDS_P):
                close_to(heights["p"][-1])
            if tag in SIBLINGS:
                shut, holders = SIBLINGS[tag]
                inside = top(holders)
                above = [own[bisect_right(own, inside)] for own in (heights[t] for t in shut) if own and own[-1] > inside]
                if above:
                    close_to(min(above))
            if tag not in VOID:
                open_node(tag, m[3])
    flush()
    return page


def names_of(attributes: str) -> list[str]:
    """What an element's attributes say about it: words of class, id, role and label, and whether it is hidden."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            out += _NAME.findall(_HUMP.sub(r"\1 \2", html.unescape(value)).lower())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display:\s*none", value)):
            out.append("~hidden")
    return out


def _bucket(n: float, bounds: tuple) -> int:
    return sum(n >= b for b in bounds)


def node_features(page: Page) -> list[list[str]]:
    """Feature names of each node: its tag, its names and how they begin and end, the size of its own text, the share of links below it."""
    n = len(page.tags)
    chars, linked = page.chars[:], page.linked[:]
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        linked[page.parents[i]] += linked[i]
    out = []
    for i in range(n):
        share = linked[i] / chars[i] if chars[i] else 0.0
        names = names_of(page.attributes[i])
        out.append(
            [
                f"tag {page.tags[i]}",
                f"own {_bucket(page.chars[i], (1, 25, 100, 400))}",
                f"links {_bucket(share, (0.01, 0.3, 0.7))}",
                *(f"name {x}" for x in names),
                *(f"begins {x[:4]}" for x in names if len(x) > 4),
                *(f"ends {x[-3:]}" for x in names if len(x) > 3),
            ]
        )
    return out
