"""Long strings of tokens that several pages of one host share, from a sparse suffix array of the host.

All strings of LEAST tokens of a host's pages are compared, in two steps. Of every WINDOW suffixes in a row the one whose
first DEPTH tokens have the least hash is kept: two pages that share LEAST = DEPTH + WINDOW - 1 tokens keep the same
suffix in them, whatever stands around, so a string whose kept suffix no other page has is shared with none. Then the
strings themselves, at every position whose kept suffix is shared, are compared the same way. Neighbours in the array
are found by grouping hashes instead of by sorting, which combines before the shuffle and has no order to agree on;
strings never cross a page, so no separators are needed. Exactly the tokens of shared strings are covered.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions.htmlblocks import Page
from loomwell.session import materialise

#: Parameters: tokens that a kept suffix is told by, and suffixes in a row of which one is kept: shared strings of
#: LEAST = 24 tokens or more are found, wherever they stand.
DEPTH, WINDOW = 12, 13
LEAST = DEPTH + WINDOW - 1
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}


def page_tokens(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a page's tokens outside code, and the line that each stands in."""
    if len(_known) > 500_000:
        _known.clear()
    hashes, lines = [], []
    for i, line in enumerate(page.lines):
        if line.pre:
            continue
        for w in _TOKEN.findall(line.prose):
            h = _known.get(w)
            if h is None:
                h = _known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
            lines.append(i)
    return np.array(hashes, np.uint64), np.array(lines, np.int64)


def _hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens at each position; shorter pages have none."""
    n = max(0, len(tokens) - size + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ (h >> np.uint64(29))) * _BASE + tokens[k : k + n]
    return h


def _anchors(h: np.ndarray) -> np.ndarray:
    """Position of the suffix that is kept for the string of LEAST tokens at each position, from the suffixes' hashes."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.arange(len(rows)) + rows.argmin(axis=1)


def suffixes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the first DEPTH tokens, position) of the suffixes that are kept; pages of fewer than LEAST tokens have none."""
    h = _hashes(tokens, DEPTH)
    kept = np.unique(_anchors(h))
    return h[kept].view(np.int64), kept


def strings(tokens: np.ndarray, shared: set[int]) -> np.ndarray:
    """Hashes of the strings of LEAST tokens whose kept suffix is ``shared``: no other string can be."""
    h = _hashes(tokens, DEPTH)
    met = np.isin(h.view(np.int64)[_anchors(h)], np.fromiter(shared, np.int64, len(shared)))
    return np.unique(_hashes(tokens, LEAST).view(np.int64)[met])


def covered_lines(page: Page, shared: set[int]) -> set[int]:
    """Numbers of the lines all of whose tokens lie in strings that other pages have (``shared`` holds their hashes); none
    where all lines would, since such a page is a copy rather than boilerplate."""
    tokens, lines = page_tokens(page)
    at = np.flatnonzero(np.isin(_hashes(tokens, LEAST).view(np.int64), np.fromiter(shared, np.int64, len(shared))))
    mark = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + LEAST, -1)
    inside = np.cumsum(mark[:-1]) > 0
    every = set(lines.tolist())
    whole = every - set(lines[~inside].tolist())
    return set() if whole == every else whole


def shared_suffixes(pages: DataFrame) -> DataFrame:
    """(host, suffix) of the suffixes, or other strings, that two or more keys of a blog have in common, from pages (seq,
    blog_id, key, suffixes). A row without key is a page of its own.

    The least and the greatest name tell whether there are two; they are combined before the shuffle, so a suffix that
    all pages of a large host have is one row a task.
    """
    name = F.coalesce("key", F.concat(F.lit("#"), F.col("seq").cast("string")))
    each = pages.select(F.col("blog_id").alias("host"), F.xxhash64(name).alias("name"), F.explode("suffixes").alias("suffix"))
    per = each.groupBy("host", "suffix").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    return materialise(per.where("a <> b").select("host", "suffix"), "shared-suffixes")
