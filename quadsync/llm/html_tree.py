"""A web page as a tree of blocks and text leaves.

Enough of HTML's rules for broken pages: implied ends of p, li, dt, dd, tr, td,
th and option, end tags without start are ignored, raw text elements end at
their end tag or with the page, comments and declarations are skipped.  Elements
that are no blocks leave no node; their text belongs to the block around them.  A tag ends at
the first > outside of quotes or, if its quotes don't close, at the first >; a < that begins no
tag is text.  The work is in proportion to the page, whatever is broken in it.
"""

from __future__ import annotations

import re
from html import unescape

START = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|(?:^|\s)(hidden)(?=\s|$)", re.S)
NAME = re.compile(r"[a-z]+")

#: fixed values: HTML's elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg canvas object textarea title xmp noframes".split())
BLOCK = frozenset(
    "html head body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th "
    "form fieldset legend label select option button figure figcaption address details summary dialog menu center hgroup search".split())
CLOSES_P = BLOCK - frozenset("html head body label select option button caption thead tbody tfoot tr td th".split()) | {"hr"}
#: a start tag ends an open element of the first set unless one of the second lies between
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_LIMIT = frozenset("article section main nav header footer aside div ul ol li table td th form fieldset blockquote body button figure dd details".split())
END_RAW = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "words", "parent", "text", "links", "children", "chars", "link_chars", "label")

    def __init__(self, tag: str, words: tuple[str, ...], parent: int):
        self.tag, self.words, self.parent, self.text, self.links = tag, words, parent, None, 0
        self.children = self.chars = self.link_chars = 0
        self.label = None


def attributes(raw: str) -> tuple[tuple[str, ...], str | None]:
    """(words of class, id, role and the like, the mark of a labelled page)."""
    words, label = [], None
    for m in ATTR.finditer(raw):
        if m[5]:
            words.append("hidden")
            continue
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words += NAME.findall(value)
        elif name == "data-label":
            label = value
        elif name == "style" and "display:none" in value.replace(" ", ""):
            words.append("hidden")
    return tuple(dict.fromkeys(words)), label


class Tags:
    """The tags of a page one after the other, each character looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.open_ended: set[int] = set()  # quotes after which some tag was found to have no end

    def end_of(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at ``at``."""
        seen, pos = [], at
        while (m := STOP.search(self.html, pos)) and m[0] != ">":
            close = -1 if m.start() in self.open_ended else self.html.find(m[0], m.end())
            seen.append(m.start())
            if close < 0:
                m = None
                break
            pos = close + 1
        if m:
            return m.start()
        self.open_ended.update(seen)
        return self.html.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, is an end tag, attributes) of the next tag, comment or declaration (no name) from ``at`` on."""
        html, look = self.html, at
        while (i := html.find("<", look)) >= 0:
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                return i, end + 3 if end >= 0 else len(html), "", False, ""
            if i > self.last:  # nothing but comments can follow
                i = html.find("<!--", i)
                return (i, len(html) if html.find("-->", i + 4) < 0 else html.find("-->", i + 4) + 3, "", False, "") if i >= 0 else None
            if html.startswith(("<!", "<?"), i):
                return i, html.find(">", i) + 1, "", False, ""
            m = START.match(html, i)
            if m:
                end = self.end_of(m.end())
                return i, end + 1, m[2].lower(), bool(m[1]), html[m.end():end]
            look = i + 1
        return None

    def end_of_raw(self, tag: str, at: int) -> int:
        end = END_RAW[tag].search(self.html, at, self.last + 1)
        return end.end() if end else len(self.html)


def parse(html: str) -> list[Node]:
    """Nodes in page order; a node's parent comes before it, text leaves have tag "#" and their text."""
    nodes = [Node("#page", (), -1)]
    stack, parts, in_link, link_chars, at, tags = [0], [], False, 0, 0, Tags(html)
    places: dict[str, list[int]] = {}  # of each open tag, its places in the stack

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and "head" not in [nodes[i].tag for i in stack[:3]]:
                leaf = Node("#", nodes[stack[-1]].words, stack[-1])
                leaf.text, leaf.links = text, min(link_chars, len(text))
                nodes.append(leaf)
        link_chars = 0

    def take(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                link_chars += len(text.strip())

    def innermost(some: frozenset | tuple) -> int:
        return max((places[t][-1] for t in some if places.get(t)), default=0)

    def close(some: frozenset | tuple, limit: frozenset) -> None:
        """Ends the innermost open element of ``some``, unless one of ``limit`` lies within it."""
        i = innermost(some)
        if i > innermost(limit):
            while len(stack) > i:
                places[nodes[stack.pop()].tag].pop()

    while True:
        found = tags.next(at)
        if not found:
            take(html[at:])
            break
        begin, end, tag, is_end, raw = found
        take(html[at:begin])
        at = end
        if not tag:
            continue
        if is_end:
            if tag == "a":
                in_link = False
            elif tag in BLOCK:
                flush()
                close((tag,), frozenset())
            continue
        if tag == "br":
            parts.append("\n")
        elif tag in RAW:
            at = tags.end_of_raw(tag, at)
        elif tag == "a":
            in_link = True
        elif tag in BLOCK or tag == "hr":
            flush()
            if tag in CLOSES_P:
                close(("p",), P_LIMIT)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag == "body":
                close(("head",), frozenset())
            if tag not in VOID:
                words, label = attributes(raw)
                node = Node(tag, words, stack[-1])
                node.label = label
                nodes.append(node)
                places.setdefault(tag, []).append(len(stack))
                stack.append(len(nodes) - 1)
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if n.text is not None:
            n.chars, n.link_chars = len(n.text), n.links
        p = nodes[n.parent]
        p.chars += n.chars
        p.link_chars += n.link_chars
        p.children += 1
    return nodes
