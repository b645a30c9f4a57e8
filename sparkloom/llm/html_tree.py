"""Pages as trees of blocks: a tolerant, linear scan of HTML.

Nodes are the block-level elements that hold text, in page order, and the runs of text directly inside
them (leaves).  Inline elements are no nodes; what never shows as text (scripts, styles, comments, titles,
templates, controls of forms) is left out.  Open elements are closed as browsers do for the cases that
matter to blocks: a block ends a paragraph, an item ends an item, a cell ends a cell, and an end tag
without its start does nothing.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements that are blocks; others are inline, but for those of a page's own names (with a hyphen).
BLOCK = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li "
    "listing main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead tr ul svg select button object canvas audio video datalist".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup, and others whose inside is not shown or belongs to a control.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("template svg select button object canvas audio video datalist head".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta script style title noscript template".split())
#: A start tag of the first kind ends an open element of the second, if none of the third lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "div", "section", "article", "table", "td", "th")), "dt": (("dt", "dd"), ("dl", "div", "section", "article", "table", "td", "th")), "dd": (("dt", "dd"), ("dl", "div", "section", "article", "table", "td", "th")),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)), "tfoot": (("tbody", "thead", "caption"), ("table",)),
}
#: An end tag finds no start outside of these.
SCOPES = frozenset(("table", "td", "th", "caption", "html", "template", "object"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_TOKEN = re.compile(
    r"<!--(?:-?>|[\s\S]*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*+>|<[/!?a-zA-Z][^>]*+\Z",
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|style|hidden|aria-hidden|data-label)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


@functools.lru_cache(1 << 14)
def attributes(attrs: str) -> tuple[tuple[str, ...], str]:
    """(words of class, id, role and itemprop, with ``!hidden`` of what isn't displayed; the value of data-label)."""
    words: dict[str, None] = {}
    label = ""
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "data-label":
            label = value
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                words["!hidden"] = None
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                words["!hidden"] = None
        else:
            words.update((p.lower(), None) for p in _PART.findall(html.unescape(value)))
    return tuple(words), label


@dataclass
class Tree:
    """Nodes by page order, a parent before its children; the first is the page itself."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    label: list[str] = field(default_factory=lambda: [""])
    #: Of a leaf its text and how many of its characters are links; of an element None and 0.
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: str, words: tuple[str, ...], label: str, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.label.append(label or self.label[parent])
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


class _Builder:
    def __init__(self) -> None:
        self.tree = Tree()
        self.open: list[tuple[str, int]] = [("#page", 0)]
        #: How many elements of a name are open since the last scope began, by scope.
        self.counts: list[dict[str, int]] = [{}]
        self.scopes = [""]
        self.names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.link, self.linked, self.hidden = False, 0, 0

    def words(self, raw: str) -> None:
        if self.open[-1][0] == "head" and raw.strip():
            self.pop()
        if not self.hidden:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.link:
                self.linked += len(raw.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.tree.add(self.open[-1][1], "#text", (), "", text, min(self.linked, len(text)))
            self.parts.clear()
        self.linked = 0

    def push(self, name: str, attrs: str) -> None:
        words, label = attributes(attrs) if attrs else ((), "")
        plain = self.hidden or name in HIDDEN or (name in ("html", "body") and not attrs)
        self.open.append((name, self.open[-1][1] if plain else self.tree.add(self.open[-1][1], name, words, label)))
        self.counts[-1][name] = self.counts[-1].get(name, 0) + 1
        self.names[name] += 1
        if name in SCOPES:
            self.counts.append({})
            self.scopes.append(name)
        self.hidden += name in HIDDEN

    def pop(self) -> str:
        if not self.hidden:
            self.flush()
        name, _ = self.open.pop()
        if name in SCOPES:
            self.counts.pop()
            self.scopes.pop()
        self.counts[-1][name] -= 1
        self.names[name] -= 1
        self.hidden -= name in HIDDEN
        return name

    def cut(self, size: int) -> None:
        """End open elements until so many are left."""
        while len(self.open) > size:
            self.pop()

    def close(self, *names: str) -> None:
        """End the innermost open element of one of the names, if its scope (or the scope's element) has one."""
        if self.scopes[-1] in names or any(self.counts[-1].get(n) for n in names):
            while self.pop() not in names:
                pass

    def within(self, names: tuple[str, ...], until: tuple[str, ...]) -> None:
        """End the innermost open element of one of the names, if none of ``until`` lies in it."""
        if any(self.names[n] for n in names):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in names:
                    return self.cut(k)
                if self.open[k][0] in until:
                    return None
        return None

    def end(self, name: str) -> None:
        if name == "a":
            self.link = False
        elif name in HEADINGS:
            self.close(*HEADINGS)
        elif name in ("tr", "tbody", "thead", "tfoot"):  # with their open cell
            self.within((name,), ("table",))
        elif name == "table":
            self.within((name,), ())
        elif name in BLOCK or "-" in name:
            if name == "p" and not self.hidden:  # a block of its own, if none is open
                self.flush()
            self.close(name)

    def start(self, name: str, attrs: str) -> None:
        if self.open[-1][0] == "head" and name not in HEAD:
            self.pop()
        if name == "br":
            self.words(" ")
        elif name == "a":
            self.link = True
        elif name == "hr":
            self.close("p")
            if not self.hidden:
                self.flush()
        elif name in BLOCK or ("-" in name and name not in VOID):
            if name in ENDS:
                self.within(*ENDS[name])
            if name not in HIDDEN:
                self.close("p")
            if name in HEADINGS and self.open[-1][0] in HEADINGS:
                self.cut(len(self.open) - 1)
            if name not in HIDDEN and not self.hidden:
                self.flush()
            self.push(name, attrs)


def parse(page: str) -> Tree:
    """The tree of a page; of a page without markup the page's node and one leaf."""
    b = _Builder()
    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            b.words(page[at:])
            break
        if found.start() > at:
            b.words(page[at : found.start()])
        at = found.end()
        name = found["tag"]
        if not name:
            continue
        name = name.lower()
        if found["end"]:
            b.end(name)
        elif name in RAW:
            if name != "title" and name not in ("script", "style"):
                b.words(" ")
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
        else:
            b.start(name, found["attrs"])
    b.flush()
    return b.tree
