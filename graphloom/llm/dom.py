"""A lenient HTML scanner that gives a page's block elements, in page order, and their texts."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

#: Elements by kind, as the HTML standard's rendering section has them.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object head title select textarea button canvas audio video datalist".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
#: What may stand in a head; any other start tag ends it.
HEAD_CONTENT = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
CLOSES_P = BLOCKS - frozenset("html body td th caption tr tbody thead tfoot li dd dt summary legend figcaption".split())
#: What a start tag closes if it is open, the outermost of them first, and the elements beyond which it isn't looked for.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
ATTRIBUTES = ("class", "id", "role", "itemprop", "aria-label", "data-component")
TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    end: int = 0  # index after its last descendant
    inline: int = 0
    links: int = 0  # characters of its own text within links
    #: (place, text): the node's own runs of text; place is how many nodes had begun before; runs in page order are by place, then inner nodes first.
    runs: list[list] = field(default_factory=list)


def attribute_tokens(attrs: str) -> tuple[list[str], bool]:
    """Words of the telling attributes; whether the element is hidden."""
    tokens, hidden = [], False
    for m in ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ATTRIBUTES:
            tokens += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value == "true":
            hidden = True
    return tokens, hidden


def parse(page: str | None) -> list[Node]:
    """The page's block elements in order, below one root; scripts, styles, controls, hidden elements and comments leave none."""
    root = Node("root", -1, 0, [])
    nodes, stack = [root], [("root", 0, 0, 0)]  # stack: (tag, node or -1, the node that holds it, 1 if it is a counted link)
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack, so that none has to be looked for
    source = page or ""
    at, silent, linked = 0, 0, 0  # silent: stack size at which a silent element began
    current = 0

    def text(part: str) -> None:
        if silent or not part:
            return
        node = nodes[current]
        if "&" in part:
            part = html.unescape(part)
        if linked:
            node.links += len(part) - part.count(" ")
        if node.runs and node.runs[-1][0] == len(nodes):
            node.runs[-1][1].append(part)
        else:
            node.runs.append([len(nodes), [part]])

    def pop(size: int) -> None:
        nonlocal current, silent, linked
        while len(stack) > size:
            tag, node, current, link = stack.pop()
            places[tag].pop()
            if node > 0:
                nodes[node].end = len(nodes)
            linked -= link
        if silent > len(stack):
            silent = 0

    def push(tag: str, node: int, link: int = 0) -> None:
        places[tag].append(len(stack))
        stack.append((tag, node, current, link))

    def opened(tags, beyond=(), outermost: bool = False) -> int:
        """Size of the stack below the innermost (or outermost) of tags that no element of beyond separates from here, or 0."""
        edge = max((places[t][-1] for t in beyond if places[t]), default=0)
        found = [places[t][bisect_right(places[t], edge) if outermost else -1] for t in tags if places[t] and places[t][-1] > edge]
        return (min if outermost else max)(found, default=0)

    while at < len(source):
        m = TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if k := opened({name}, {"table"} if name not in BLOCKS else ()):
                pop(k)
            elif name == "br":
                text(" ")
            continue
        if name not in HEAD_CONTENT and stack[-1][0] == "head":
            pop(len(stack) - 1)
        if name in CLOSES and (k := opened(*CLOSES[name], outermost=True)):
            pop(k)
        elif name in CLOSES_P and (k := opened({"p"}, {"td", "th", "li", "div", "section", "article", "table", "button"})):
            pop(k)
        attrs = m["attrs"] or ""
        if name in VOID:
            text(" ") if name in ("br", "hr", "img", "wbr", "input") else None
            continue
        tokens, hidden = attribute_tokens(attrs) if attrs else ([], False)
        shut = attrs.endswith("/") and name in ("svg", "path")
        if shut:
            continue
        if (name in SILENT or hidden) and not silent:
            silent = len(stack) + 1
        if name in BLOCKS and not silent:
            nodes.append(Node(name, current, nodes[current].depth + 1, tokens))
            push(name, len(nodes) - 1)
            current = len(nodes) - 1
        else:
            link = 0
            if not silent:
                nodes[current].inline += 1
                link = int(name == "a")
                linked += link
            push(name, -1, link)
        if name in RAW:
            close = re.compile(rf"</{name}\b", re.I).search(source, at)
            at = close.start() if close else len(source)
    pop(1)
    root.end = len(nodes)
    for n in nodes:
        n.runs = [(place, SPACE.sub(" ", "".join(parts)).strip()) for place, parts in n.runs]
        n.runs = [r for r in n.runs if r[1]]
    return nodes
