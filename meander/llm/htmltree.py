"""HTML to a small tree: elements, and the text blocks in them as leaves."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object select textarea button title".split())
RAW = "script|style|textarea|title"
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may stand in a head; any other start tag, and text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = BLOCKS - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An element that its next sibling of these names ends, and where the search for it stops.
ENDED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW})\b([^>]*)>(.*?)(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""",
    re.S | re.I,
)
#: The slash of ``<svg width=10/>`` belongs to the value.
_VALUE_SLASH = re.compile(r"""=\s*[^\s"'>]*/\Z""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@dataclass
class Page:
    """Node 0 is the root.  A text block is a node with tag ``#text``; parents stand before their children."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, names: str = "", text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def _closed(attributes: str) -> bool:
    return attributes.endswith("/") and not _VALUE_SLASH.search(attributes)


def parse(html: str | None) -> Page:
    """The tree of visible text.  Only block elements are nodes; inline ones only tell whether text is a link.

    Null and empty pages have the root alone.  Missing and stray end tags are taken as browsers mostly do: a head
    ends at the first thing that may not stand in it, later heads are ignored.
    """
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # (name, node of the nearest block)
    where: dict[str, list[int]] = {}  # places of each name in the stack
    pieces: list[str] = []
    linked = 0
    hidden = links = 0
    fresh = True  # a head may still begin

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add("#text", stack[-1][1], "", text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def pop(count: int):
        nonlocal hidden, links
        for _ in range(count):
            name = stack[-1][0]
            if name in BLOCKS:
                flush()
            stack.pop()
            where[name].pop()
            hidden -= name in HIDDEN
            links -= name == "a"

    def find(names, stops=frozenset()) -> int:
        """How many elements from the top down to the nearest of ``names``; 0 if a stop or the root comes first."""
        at = max((where[n][-1] for n in names if where.get(n)), default=0)
        if not at or any(where[s][-1] > at for s in stops if where.get(s)):
            return 0
        return len(stack) - at

    def end_head(name: str = ""):
        """An open head ends at what may not stand in it; a body ends it from inside its elements too."""
        if stack[-1][0] == "head" and name not in IN_HEAD:
            pop(1)
        elif name == "body" and (depth := find({"head"}, {"template"})):
            pop(depth)

    def take(text: str):
        nonlocal linked, fresh
        if text and (fresh or stack[-1][0] == "head") and text.strip(" \t\n\f\r"):
            fresh = False
            end_head()
        if text and not hidden:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    html = html or ""
    while m := _TOKEN.search(html, at):
        take(html[at : m.start()])
        at = m.end()
        name = m[5]
        if name is None:
            if m[1]:
                fresh = False
                end_head(m[1].lower())
                if _closed(m[2]) and find({"svg", "math"}, {"foreignobject"}):
                    at = m.end(2) + 1  # empty: what follows is no raw text
            continue
        name = name.lower()
        if m[4]:
            if depth := find({name}):
                pop(depth)
            elif name in ("p", "br"):
                flush() if name == "p" else take(" ")
            continue
        if name == "head" and not fresh:
            continue
        fresh &= name == "html"
        end_head(name)
        if name in VOID:
            flush() if name == "hr" else take(" ")
            continue
        if name in CLOSES_P and (depth := find({"p"}, BLOCKS - {"p"})):
            pop(depth)
        if name in ENDED_BY or name in ("td", "th"):
            for end, (by, stops) in ENDED_BY.items():
                if name in by and (depth := find({end}, stops)):
                    pop(depth)
        if name == "a" and (depth := find({"a"}, BLOCKS)):
            pop(depth)
        if m[6].endswith("/") and name not in BLOCKS and name not in HIDDEN:
            continue
        if name in ("svg", "math") and _closed(m[6]):
            continue
        node = stack[-1][1]
        if name in BLOCKS:
            flush()
            attrs = m[6]
            words = " ".join(a or b or c for a, b, c in _NAMED.findall(attrs)).lower() if attrs else ""
            node = page.add(name, node, words)
        where.setdefault(name, []).append(len(stack))
        stack.append((name, node))
        hidden += name in HIDDEN
        links += name == "a"
    take(html[at:])
    pop(len(stack) - 1)
    flush()
    return page
