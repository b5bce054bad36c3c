"""Problem 2: the article of a page without navigation, notices, sidebars and footer, by a minimum cut over its lines.

A classifier trained on lines whose place is stated by their elements gives each line its terminal capacities; lines
that follow each other or stand in one element are tied by smoothness edges; the maximum flow separates the page.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions.htmlblocks import Line, parse_page
from loomwell.functions.htmllines import fold_line
from loomwell.llm.common import added_up
from loomwell.session import arrow_batches, spread

#: Parameters: pages that each kind weighs as at most, however many there are; weight in features of the common shares; capacities.
#: The words of a line count as so many at most, so that long lines aren't overconfident: each of more words counts less.
KIND_PAGES, PULL, MOST_COST, WORDS = 2_000, 60.0, 6.0, 12
#: Pages whose html is read together; lines and characters whose words a task holds before it counts them.
BATCH, HELD_LINES, HELD_CHARS = 1_000, 20_000, 4_000_000
#: Edges: lines in a row, in one innermost element, in one outermost element, entries of one list, a heading and the list
#: after it. BIAS is what calling a line boilerplate costs, STATED what elements that state a line's place add to the
#: capacity of that side.
NEXT, SAME_PARENT, SAME_TOP, SAME_LIST, HEADED, BIAS, STATED = 0.8, 1.2, 0.8, 2.0, 2.0, 1.5, 6.0

# Element names and words in class, id and role that state the part of a page.
PART_TAGS = frozenset(("nav", "footer", "aside"))
BODY_TAGS = frozenset(("article", "main"))
PART_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs cookie cookies consent gdpr sidebar side widget widgets footer bottom related popular banner contentinfo complementary subscribe newsletter".split()
)
QUOTING = frozenset(("blockquote", "figure"))
NOTE_NAMES = frozenset("note callout pullquote tip warning info admonition".split())
_WORD = re.compile(r"[^\W\d_]+")
_CLOSED = re.compile(r"[.!?:…]['\"”’)]*$")
_KINDS = frozenset(("li", "p", "td", "button", "h2", "h3", "h4", "div", "pre", "figcaption", "blockquote"))
_AROUND = frozenset(("aside", "nav", "footer", "table", "pre", "button", "form"))
_INSIDE = frozenset(("pre", "code", "blockquote", "figure", "small"))


def stated_part(line: Line) -> bool | None:
    """True for a part around the article, False for the article, None where the elements don't tell."""
    if BODY_TAGS.intersection(line.path):
        return bool({"nav"}.intersection(line.path))
    if QUOTING.intersection(line.path) or NOTE_NAMES.intersection(line.names):
        return None
    if PART_TAGS.intersection(line.path) or PART_NAMES.intersection(line.names):
        return True
    return None


def line_words(line: Line) -> list[str]:
    return _WORD.findall(line.text.lower())


def line_marks(lines: list[Line], counts: list[int]) -> list[list[str]]:
    """What is said about each line beside its words (given their numbers): links, length, elements and place; not its
    class names."""
    out = []
    n = len(lines)
    for i, (x, k) in enumerate(zip(lines, counts, strict=True)):
        linked = min(4, round(4 * x.link_chars / max(1, len(x.text)))) if x.link_chars else 0
        size = "0" if k == 0 else "1" if k < 3 else "2" if k < 6 else "3" if k < 10 else "4" if k < 20 else "5"
        closed = "." if _CLOSED.search(x.text) else "-"
        first, last = min(i, 8) // 2, min(n - 1 - i, 8) // 2
        tag = x.tag if x.tag in _KINDS else "other"
        f = [f"@link{linked}", f"@size{size}{closed}", f"@size{size}link{linked}", f"@first{first}", f"@last{last}", f"@{tag}link{linked}", f"@{tag}{size}"]
        if not _AROUND.isdisjoint(x.path) and QUOTING.isdisjoint(x.path):
            f += [f"@in-{t}" for t in _AROUND.intersection(x.path)]
        if "|" in x.text:
            f.append("@bar")
        if "©" in x.text:
            f.append("@copyright")
        if not _INSIDE.isdisjoint(x.path):
            f += [f"@of-{t}" for t in _INSIDE.intersection(x.path)]
        out.append(f)
    return out


def line_features(lines: list[Line]) -> list[list[str]]:
    """All that is said about each line: its marks and its words."""
    words = [line_words(x) for x in lines]
    return [m + w for m, w in zip(line_marks(lines, list(map(len, words))), words, strict=True)]


def word_weight(features: list[str]) -> float:
    """What each word of a line counts."""
    return min(1.0, WORDS / max(1, sum(f[0] != "@" for f in features)))


class LineModel:
    """Naive Bayes log odds that a line belongs to a part around the article."""

    def __init__(self, prior: float, weights: dict[str, float]):
        self.prior, self.weights = prior, weights
        self._said: dict[str, tuple[float, int]] = {}

    def __reduce__(self):
        return LineModel, (self.prior, self.weights)

    def odds(self, features: list[str]) -> float:
        each = word_weight(features)
        return self.prior + sum(self.weights.get(f, 0.0) * (1.0 if f[0] == "@" else each) for f in features)

    def all_odds(self, lines: list[Line]) -> list[float]:
        """``odds`` of every line of a page; what the words of a text say is kept, since pages repeat their lines."""
        known, get = self._said, self.weights.get
        if len(known) > 50_000:
            known.clear()
        said = []
        for x in lines:
            found = known.get(x.text)
            if found is None:
                words = line_words(x)
                found = known[x.text] = sum([get(w, 0.0) for w in words]) * min(1.0, WORDS / max(1, len(words))), len(words)
            said.append(found)
        marks = line_marks(lines, [n for _, n in said])
        return [self.prior + words + sum([get(f, 0.0) for f in m]) for (words, _), m in zip(said, marks, strict=True)]

    @classmethod
    def fit(cls, pages: Iterable[list[Line]]) -> LineModel:
        """The model of pages of one kind."""
        table: dict[str, list[float]] = {}
        for name, more in count_lines((0, lines) for lines in pages):
            table[name] = [a + b for a, b in zip(table.get(name, [0.0] * SIDES), more, strict=True)]
        return weighed(table)


#: Kinds of pages: with neither, with stated parts only, with stated bodies. What is counted is kept for each kind, of its
#: lines in articles and of those around them.
KINDS = 3
SIDES = 2 * KINDS


def learned(lines: list[Line]) -> list[bool | None]:
    """For each line of a page whether it is learned from as one around the article (True) or in it; None for neither."""
    stated = [stated_part(x) for x in lines]
    bodied, parted = any(BODY_TAGS.intersection(x.path) for x in lines), any(s for s in stated)
    return [s if s is not None else True if bodied else None if parted else False for s in stated]


def count_lines(pages: Iterable[tuple[int, list[Line]]]) -> Iterator[tuple[str, list[float]]]:
    """(feature, counts by kind and side) of the lines of pages, given with their kinds; under the name "" the lines, and
    under a line break the pages. Weights are whole 2^-20ths, so sums don't depend on the order of rows."""
    marks, texts = ([Counter() for _ in range(SIDES)] for _ in range(2))
    held = 0

    def told(side: int) -> Iterator[tuple[str, list[float]]]:
        words: Counter[str] = Counter()
        for text, n in texts[side].items():
            found = _WORD.findall(text)
            each = n * round(word_weight(found) * (1 << 20)) / (1 << 20)
            for w in found:
                words[w] += each
        for name, n in chain(marks[side].items(), words.items()):
            yield name, [float(n) if i == side else 0.0 for i in range(SIDES)]
        marks[side].clear()
        texts[side].clear()

    for kind, lines in pages:
        bodied = any(BODY_TAGS.intersection(x.path) for x in lines)
        marks[2 * kind]["\n"] += 1
        said = [x.text.lower() for x in lines]
        for x, text, label, f in zip(lines, said, learned(lines), line_marks(lines, [len(_WORD.findall(t)) for t in said]), strict=True):
            if label is None or (bodied and "@size5." in f and stated_part(x) is None):
                continue
            marks[2 * kind + label].update(f)
            marks[2 * kind + label][""] += 1
            texts[2 * kind + label][text] += 1
            held += len(text)
        if held > HELD_CHARS or sum(map(len, texts)) > HELD_LINES:
            yield from chain.from_iterable(map(told, range(SIDES)))
            held = 0
    yield from chain.from_iterable(map(told, range(SIDES)))


def weighed(table: dict[str, list[float]]) -> LineModel:
    """The model from what ``count_lines`` counts in all pages. A kind of more than KIND_PAGES pages weighs as so many, so
    that neither the rarer kinds nor the common shares are outweighed in larger tables."""
    table = dict(table)
    pages, lines = (table.pop(name, [0.0] * SIDES) for name in ("\n", ""))
    scale = [min(1.0, KIND_PAGES / max(1.0, pages[2 * k])) for k in range(KINDS)]
    sides = lambda row: tuple(sum(row[2 * k + side] * scale[k] for k in range(KINDS)) for side in (1, 0))
    counts = {f: sides(row) for f, row in sorted(table.items())}
    sizes = tuple(sum(c[side] for c in counts.values()) for side in (0, 1))
    every = sum(sizes)
    weights = {}
    for f, both in counts.items():
        background = PULL * (sum(both) + 0.5) / (every + 1)
        a, b = ((n + background) / (size + PULL) for n, size in zip(both, sizes, strict=True))
        weights[f] = math.log(a / b)
    around, inside = sides(lines)
    return LineModel(math.log((around + 1) / (inside + 1)), weights)


def max_flow_side(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes stay with the source after a minimum cut (Dinic's algorithm); edges go both ways."""
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, x: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        cap.append(x)
        at[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])
        if source[i] > both:
            link(s, i, source[i] - both, 0.0)
        if sink[i] > both:
            link(i, t, sink[i] - both, 0.0)
    for a, b, x in edges:
        link(a, b, x, x)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque((s,))
        while queue:
            u = queue.popleft()
            for e in at[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                path, u = [], s
                continue
            while nxt[u] < len(at[u]):
                e = at[u][nxt[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def label_lines(lines: list[Line], model: LineModel) -> list[bool]:
    """True for each line that belongs to a part around the article; everything that decides is a capacity."""
    if not lines:
        return []
    odds = [max(-MOST_COST, min(MOST_COST, o - BIAS)) for o in model.all_odds(lines)]
    for i, x in enumerate(lines):
        part = stated_part(x)
        if part is not None:
            odds[i] += STATED if part else -STATED
    if max(odds) <= 0:
        return [False] * len(lines)  # no line has a capacity on the other side: the cut is empty
    edges = []
    last: dict[tuple[int, ...], int] = {}
    for i, x in enumerate(lines):
        if i:
            y = lines[i - 1]
            w = NEXT
            if x.nodes and y.nodes and x.nodes[0] == y.nodes[0]:
                w += SAME_TOP
                if x.nodes[-1] == y.nodes[-1] or (len(x.nodes) > 1 and x.nodes[:-1] == y.nodes[:-1]):
                    w += SAME_PARENT
            if re.fullmatch("h[1-6]", y.tag) and "li" in x.path:
                w += HEADED
            edges.append((i - 1, i, w))
        if len(x.nodes) > 1 and "li" in x.path:
            cut = len(x.nodes) - 1
            key = x.nodes[:cut]
            if key in last and last[key] != i - 1:
                edges.append((last[key], i, SAME_LIST))
            last[key] = i
    return max_flow_side(len(lines), [max(0.0, o) for o in odds], [max(0.0, -o) for o in odds], edges)


def split_page(html: str | None, model: LineModel) -> tuple[list[str], list[str]]:
    """(article lines, lines around it), as read. Null and empty html has neither."""
    lines = parse_page(html).lines
    if not lines:
        return [], []
    around = label_lines(lines, model)
    return [x.text for x, a in zip(lines, around, strict=True) if not a], [x.text for x, a in zip(lines, around, strict=True) if a]


def fit_model(posts: DataFrame) -> LineModel:
    """Fit on all pages: with stated bodies, with stated parts only, and with neither. Their lines are counted where they
    are stored; the driver holds a row a feature."""
    html = F.lower("html")
    kind = F.when(html.rlike(r"<(article|main)\b"), 2).when(html.rlike(r"<(nav|aside|footer)\b|(class|id)=.?[\w -]*(menu|cookie|side|foot|bottom|widget)"), 1).otherwise(0)
    rows = spread(posts.where("html is not null").select("seq", "html"), "seq").select(kind.alias("kind"), "html")
    with arrow_batches(posts.sparkSession, BATCH):
        found = added_up(rows, lambda pages: count_lines((k, parse_page(h).lines) for k, h in pages), SIDES).collect()
    return weighed({r.name: list(r.counts) for r in found})


_SPLIT = T.StructType([T.StructField("text", T.StringType()), T.StructField("around", T.ArrayType(T.StringType()))])


def split_pages(posts: DataFrame) -> DataFrame:
    """(seq, text, around): the article's lines as text, and the distinct folded lines around it that it doesn't hold."""
    shared = posts.sparkSession.sparkContext.broadcast(fit_model(posts))

    @F.pandas_udf(_SPLIT)
    def split(values: pd.Series) -> pd.DataFrame:
        model, rows = shared.value, []
        for v in values:
            body, around = split_page(v, model)
            held = {fold_line(x) for x in body}
            rows.append(("\n".join(body), [x for x in dict.fromkeys(map(fold_line, around)) if x not in held]))
        return pd.DataFrame(rows, columns=["text", "around"])

    rows = spread(posts.select("seq", "html"), "seq")
    return rows.withColumn("_s", split("html")).select("seq", "_s.text", "_s.around")


def boilerplate_lines(posts: DataFrame) -> DataFrame:
    """(seq, line): the lines around each article. Rows without html have none."""
    return split_pages(posts).select("seq", F.explode("around").alias("line")).distinct()
