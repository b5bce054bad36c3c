"""One pass over sloppy html: its lines with where they stand, what they are made of, and whether the end is whole.

Lines are those of ``htmllines``; here each keeps its place in the tree as well.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

from loomwell.functions.htmllines import BREAKS, HIDDEN, MARK, UNFINISHED

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE_CODE = frozenset("code samp kbd tt var".split())
PRE = frozenset("pre listing xmp textarea".split())
CODE = PRE | INLINE_CODE
CLOSES_P = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote section article aside nav main header footer figure form hr center".split())
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NEWLINE = re.compile(r"([\r\n])")
_PIECES = re.compile(MARK.pattern + r"|(?P<text>[^<]+|<)", re.S)


@dataclass(slots=True)
class Line:
    text: str = ""
    raw: str = ""
    prose: str = ""  # raw without what stands in code elements, which a ¤ stands for
    path: tuple[str, ...] = ()
    names: tuple[str, ...] = ()  # class, id and role words of the ancestors
    nodes: tuple[int, ...] = ()  # numbers of the open elements, outermost first
    pre: bool = False
    link_chars: int = 0
    links: int = 0
    end: int = 0  # offset in the html after the line's last visible character

    @property
    def tag(self) -> str:
        return self.path[-1] if self.path else ""


@dataclass(slots=True)
class Page:
    lines: list[Line] = field(default_factory=list)
    open_tags: tuple[str, ...] = ()  # still open at the end, implied ends left out
    cut_tag: bool = False  # the html ends within a tag
    cut_reference: bool = False  # or within a character reference
    size: int = 0


def parse_page(value: str | None) -> Page:
    """Lines in order. Null or empty html has none; unclosed, crossed and unknown tags are tolerated."""
    page = Page(size=len(value or ""))
    if not value:
        return page
    body = HIDDEN.sub(lambda m: "\x00" * len(m[0]), value)
    tail = UNFINISHED.match(body, body.rfind("<")) if "<" in body else None  # nothing unfinished holds another bracket
    page.cut_tag = tail is not None
    body = body[: tail.start()] if tail else body
    page.cut_reference = re.search(r"&#?\w{0,7}\Z", body) is not None
    stack: list[tuple[str, tuple[str, ...], int]] = []
    line, count = Line(), 0
    parts: list[str] = []
    prose: list[str] = []
    moved, in_code, in_pre, in_link = False, False, False, False

    def flush() -> None:
        nonlocal line, parts, prose
        if parts:
            raw = "".join(parts)
            raw = _html.unescape(raw) if "&" in raw else raw
            line.text = " ".join(raw.split())
            if line.text:
                said = "".join(prose)
                line.raw, line.prose = raw, _html.unescape(said) if "&" in said else said
                page.lines.append(line)
            line, parts, prose = Line(), [], []

    def add(text: str, end: int) -> None:
        nonlocal moved, in_code, in_pre, in_link
        text = text.replace("\x00", "")
        if not text:
            return
        if moved:
            tags = {t for t, _, _ in stack}
            moved, in_code, in_pre, in_link = False, not CODE.isdisjoint(tags), not PRE.isdisjoint(tags), "a" in tags
        if text.isspace():
            parts.append(text)
            prose.append(text)
            return
        if not line.end:
            line.path = tuple(t for t, _, _ in stack if t in BREAKS or t in CODE)
            line.names = tuple(n for _, names, _ in stack for n in names)
            line.nodes = tuple(k for _, _, k in stack)
            line.pre = in_pre
        parts.append(text)
        prose.append("¤" if in_code else text)
        line.end = end
        if in_link:
            line.link_chars += len(text.strip())

    for m in _PIECES.finditer(body):
        text = m["text"]
        if text is not None:
            at = m.start()
            if "\n" not in text and "\r" not in text:
                add(text, at + len(text.rstrip()))
                continue
            for i, piece in enumerate(_NEWLINE.split(text)):
                if i % 2:
                    flush()
                else:
                    add(piece, at + len(piece.rstrip()))
                at += len(piece)
            continue
        if m[2] is None:
            continue
        closing, name = m[1], m[2].lower()
        if name in BREAKS:
            flush()
        if name in VOID:
            continue
        moved = True
        if closing:
            scope = SCOPE.get(name)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if scope and stack[i][0] in scope:
                    break
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BREAKS:
                    break
        if name in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SIBLINGS[name]:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE[name]:
                    break
        attrs = m[3]
        if attrs and attrs.rstrip().endswith("/") and name not in BREAKS:
            continue
        names = tuple(w for a in _NAME.findall(attrs) for w in re.split(r"[^a-z0-9]+", "".join(a).lower()) if w) if attrs and "=" in attrs else ()
        count += 1
        stack.append((name, names, count))
        if name == "a":
            line.links += 1
    flush()
    page.open_tags = tuple(t for t, _, _ in stack)
    return page
