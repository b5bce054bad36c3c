"""A small document tree on the standard library's tokenizer: parsing, selectors, text, serialising.

Comments and processing instructions never enter the tree, so text excludes them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("li dd dt td th tr tbody thead tfoot figcaption".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, kids: list | None = None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs or {}, None, []
        for k in kids or []:
            self.add(k)

    def add(self, kid: Node | str) -> None:
        if isinstance(kid, Node):
            kid.parent = self
        self.kids.append(kid)

    def replace_kids(self, kids: list) -> None:
        self.kids = []
        for k in kids:
            self.add(k)

    def walk(self) -> Iterator[Node]:
        """The node and its descendants in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def above(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def strings(self) -> Iterator[str]:
        stack: list = list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, Node):
                stack.extend(reversed(k.kids))
            else:
                yield k

    def text(self, joiner: str = "") -> str:
        return joiner.join(self.strings())

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag and n is not self), None)


class _Builder(HTMLParser):
    def __init__(self, root: Node):
        super().__init__(convert_charrefs=True)
        self.root, self.open = root, [root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._close({"p"}, BLOCK - {"p"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def _close(self, tags: set[str], within: set[str] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                top = i
                while top > 1 and self.open[top - 1].tag in tags:
                    top -= 1
                del self.open[top:]
                return
            if self.open[i].tag in within:
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag not in ("table", "ul", "ol", "div", "section", "article", "main", "body", "html") and self.open[i].tag in ("table", "td", "th"):
                return

    def handle_data(self, data: str) -> None:
        if data:
            self.open[-1].add(data)


def parse(html: str, root: str = "div") -> Node:
    """The fragment's or page's nodes below one root. Never fails: unclosed, crossed and stray tags are tolerated."""
    top = Node(root)
    builder = _Builder(top)
    builder.feed(html or "")
    builder.close()
    return top


def without(root: Node, gone: Callable[[Node], bool]) -> Node:
    """A copy of a tree without the nodes below the root that ``gone`` names, and what is in them."""
    top = Node(root.tag, root.attrs)
    waiting = [(root, top)]
    while waiting:
        old, new = waiting.pop()
        for k in old.kids:
            if not isinstance(k, Node):
                new.add(k)
            elif not gone(k):
                copy = Node(k.tag, k.attrs)
                new.add(copy)
                waiting.append((k, copy))
    return top


def serialise(node: Node, xhtml: bool = True) -> str:
    out: list[str] = []
    waiting: list[tuple[Node | str, bool] | None] = [(node, False)]
    closing: list[str] = []
    while waiting:
        top = waiting.pop()
        if top is None:
            out.append(f"</{closing.pop()}>")
            continue
        n, raw = top
        if isinstance(n, str):
            out.append(n if raw else escape(n, quote=False))
            continue
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items() if re.fullmatch(r"[A-Za-z_][\w.-]*", k))
        if not n.kids and (n.tag in VOID or xhtml):
            out.append(f"<{n.tag}{attrs}/>" if xhtml else f"<{n.tag}{attrs}>")
            continue
        out.append(f"<{n.tag}{attrs}>")
        closing.append(n.tag)
        waiting.append(None)
        waiting.extend((k, not xhtml and n.tag in ("script", "style")) for k in reversed(n.kids))
    return "".join(out)


def inner(node: Node, xhtml: bool = False) -> str:
    return "".join(serialise(k, xhtml) if isinstance(k, Node) else escape(k, quote=False) for k in node.kids)


def text_of(html: str | None) -> str:
    """Text nodes joined by a space, white space collapsed; empty for null."""
    return " ".join(parse(html or "").text(" ").split())


# ---- selectors: tag, *, #id, .class, [attr], [attr=v], [attr^=v], [attr$=v], [attr*=v], [attr~=v], descendant, >, comma ----

_PART = re.compile(r"(\*|[A-Za-z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\s*\]")
_TESTS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda a, v: a == v, "^=": lambda a, v: bool(v) and a.startswith(v), "$=": lambda a, v: bool(v) and a.endswith(v),
    "*=": lambda a, v: bool(v) and v in a, "~=": lambda a, v: v in a.split(), "|=": lambda a, v: a == v or a.startswith(v + "-"),
}


def _compound(text: str) -> Callable[[Node], bool]:
    tests: list[Callable[[Node], bool]] = []
    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"selector not understood: {text!r}")
        tag, ident, cls, attr, op = m[1], m[2], m[3], m[4], m[5]
        value = next((x for x in (m[6], m[7], m[8]) if x is not None), "")
        if tag and tag != "*":
            tests.append(lambda n, t=tag.lower(): n.tag == t)
        elif ident:
            tests.append(lambda n, i=ident: n.attrs.get("id") == i)
        elif cls:
            tests.append(lambda n, c=cls: c in n.attrs.get("class", "").split())
        elif attr:
            test = _TESTS[op] if op else None
            tests.append(lambda n, a=attr.lower(), t=test, v=value: a in n.attrs and (t is None or t(n.attrs[a], v)))
        at = m.end()
    return lambda n: all(t(n) for t in tests)


def selector(text: str) -> Callable[[Node], bool]:
    """Whether a node matches any of the comma-separated selectors."""
    options = []
    for one in re.split(r",(?![^\[]*\])", text):
        tokens = re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", one.strip())
        if not tokens:
            raise ValueError(f"selector not understood: {text!r}")
        chain: list[tuple[str, Callable[[Node], bool]]] = []
        link = " "
        for t in tokens:
            if t == ">":
                link = ">"
            else:
                chain.append((link, _compound(t)))
                link = " "
        options.append(chain)

    def fits(node: Node, chain: list, i: int) -> bool:
        if not chain[i][1](node):
            return False
        if i == 0:
            return True
        if chain[i][0] == ">":
            return node.parent is not None and fits(node.parent, chain, i - 1)
        return any(fits(a, chain, i - 1) for a in node.above())

    return lambda n: any(fits(n, c, len(c) - 1) for c in options)


def select(root: Node, text: str) -> list[Node]:
    match = selector(text)
    return [n for n in root.walk() if n is not root and match(n)]


def outermost(root: Node, selectors: list[str]) -> list[Node]:
    """Matches of any selector in document order, without those inside another match."""
    tests = [selector(s) for s in selectors]
    out: list[Node] = []
    waiting = [k for k in reversed(root.kids) if isinstance(k, Node)]
    while waiting:
        n = waiting.pop()
        if any(t(n) for t in tests):
            out.append(n)
        else:
            waiting.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return out
