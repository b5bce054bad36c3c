"""Problem 9: passages of evaluation items inside a corpus.

Windows of every item, and of every document, get a 64-bit SimHash of their words. The item fingerprints are indexed by
RADIUS + 1 blocks of bits, so that looking up each block finds all fingerprints within RADIUS bits. Windows are as wide
as what stays equal between two changed words, not as an item: a stretch of a fifth of an item already counts, and with
every fourth word of it changed only windows of three words are left, which are then equal (see the README for what
wider windows and more bits find). Pairs of a document and an item with enough windows near one diagonal are
verified word by word on all diagonals that they share. Nothing of the corpus is shuffled.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.session import spread

#: Parameters. Items beyond ITEMS_A_PASS are taken in several passes over the corpus, so what is broadcast stays bounded.
WINDOW, RADIUS, LEAST_SHARE, ITEMS_A_PASS = 3, 0, 0.40, 20_000
#: Words that may be skipped on either side inside one stretch (changed, added or left out).
GAP = 3
#: Least distance of two changed words that must not matter; diagonals that are counted together.
SPACING, BAND = 4, 8
_WORD = re.compile(r"\w+")
_BITS = np.arange(64, dtype=np.uint64)
_CHUNK = 30_000
_SEEN = 22


def words(text: str | None) -> list[str]:
    """Lower-case words; punctuation, layout and compatibility forms don't matter."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


class WordHashes:
    def __init__(self, most: int = 500_000):
        self.table: dict[str, int] = {}
        self.most = most

    def __call__(self, tokens: list[str]) -> np.ndarray:
        table = self.table
        if len(table) > self.most:
            table.clear()
        out = np.empty(len(tokens), np.uint64)
        for i, w in enumerate(tokens):
            h = table.get(w)
            if h is None:
                h = table[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def simhashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of the window beginning at each word: each bit as most of its words have it, 0 on a tie. Shorter
    input has none."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    if width == 3:  # the majority of three without counting
        a, b, c = hashes[:-2], hashes[1:-1], hashes[2:]
        return (a & b) | (b & c) | (a & c)
    votes = ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int32)
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(votes, axis=0, out=total[1:])
    ones = (total[width:] - total[:-width]) * 2 > width
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


class HammingIndex:
    """All stored fingerprints within ``radius`` bits of each query, through ``radius`` + 1 blocks of bits: fingerprints
    that differ in so few bits agree in one block at least."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.blocks = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.order, self.keys, self.seen = [], [], []
        for block in self.blocks:
            key = self._key(prints, block)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _SEEN, bool)
            seen[self._slot(key)] = True
            self.order.append(order)
            self.keys.append(key[order])
            self.seen.append(seen)

    @staticmethod
    def _key(prints: np.ndarray, block: tuple[int, int]) -> np.ndarray:
        lo, size = block
        return (prints >> np.uint64(lo)) & np.uint64((1 << size) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key ^ (key >> np.uint64(32))) & np.uint64((1 << _SEEN) - 1)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query positions, stored positions); a pair may come more than once."""
        qs, ps = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, block in enumerate(self.blocks):
            key = self._key(queries, block)
            some = np.flatnonzero(self.seen[k][self._slot(key)])
            lo = np.searchsorted(self.keys[k], key[some], side="left")
            n = np.searchsorted(self.keys[k], key[some], side="right") - lo
            q = np.repeat(some, n)
            within = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            p = self.order[k][np.repeat(lo, n) + within]
            near = np.bitwise_count(queries[q] ^ self.prints[p]) <= self.radius
            qs.append(q[near])
            ps.append(p[near])
        return np.concatenate(qs), np.concatenate(ps)


def stretches(item: np.ndarray, doc: np.ndarray, diagonals: set[int]) -> list[tuple[int, int, int, int, int]]:
    """Stretches (item from, to, document from, to, words held) in which the item's words stand in the document in order.

    Runs of equal words on the given diagonals (document minus item position, and near ones) are joined over gaps of up
    to GAP words on either side. Held are the equal words, and single words that another one stands for.
    """
    near = np.array(sorted({x + k for x in diagonals for k in range(-GAP, GAP + 1)}))
    at = near[:, None] + np.arange(len(item))
    same = np.zeros((len(near), len(item) + 2), bool)
    same[:, 1:-1] = (at >= 0) & (at < len(doc)) & (item == doc[np.clip(at, 0, len(doc) - 1)])
    edges = np.diff(same.astype(np.int8), axis=1)
    (row, begin), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    long = end - begin >= min(2, len(item))
    done: list[list[int]] = []
    for a, b, d in sorted(zip(begin[long].tolist(), end[long].tolist(), near[row[long]].tolist(), strict=True)):
        best = None
        for s in done:
            gap_i, gap_d = a - s[1], a + d - s[3]
            if -2 <= gap_i <= GAP and -2 <= gap_d <= GAP and b > s[1] and (best is None or s[1] > best[1]):
                best = s
        if best:
            best[4] += b - max(a, best[1]) + (a - best[1] == 1 == a + d - best[3])
            best[1], best[3] = b, b + d
        else:
            done.append([a, b, a + d, b + d, b - a])
    return [tuple(s) for s in done]


def held_share(item: np.ndarray, doc: np.ndarray, diagonals: set[int]) -> float:
    """Largest share of the item's words that one stretch, or two in their order, hold."""
    found = stretches(item, doc, diagonals)
    best = 0
    for s in found:
        best = max(best, s[4])
        for t in found:
            if t[0] >= s[1] - 1 and t[2] >= s[3] - 1:
                best = max(best, s[4] + min(t[4], t[1] - max(t[0], s[1])))
    return best / max(1, len(item))


def windows_needed(words: int) -> int:
    """The fewest windows that the longer of two stretches of LEAST_SHARE of an item can share with it, every SPACING-th
    word of it being changed, less one for where the first change falls."""
    stretch = -(-words * LEAST_SHARE // 2)
    return max(1, int(stretch // SPACING * max(0, SPACING - WINDOW)) - 1)


class ItemIndex:
    """Items by the fingerprints of their windows; items of fewer words than a window are one window each, in an index
    of their own width."""

    def __init__(self, items: list[tuple[int, str]]):
        self.hash, self.ids, self.items = WordHashes(), [], []
        widths: dict[int, list[int]] = {}
        for item_id, text in items:
            h = self.hash(words(text))
            if len(h):
                widths.setdefault(min(WINDOW, len(h)), []).append(len(self.ids))
                self.ids.append(item_id)
                self.items.append(h)
        size = np.array([len(h) for h in self.items], np.int64)
        self.longest = int(size.max(initial=1)) + WINDOW
        self.needed = np.array([windows_needed(n) for n in size.tolist()], np.int64)
        # two stretches of LEAST_SHARE, every SPACING-th word changed and up to two words lost at each end
        self.covering = size * LEAST_SHARE * (SPACING - 1) / SPACING - 8
        self.parts = []
        for width, mine in sorted(widths.items()):
            prints = [simhashes(self.items[k], width) for k in mine]
            owner = np.concatenate([np.full(len(p), k, np.int64) for k, p in zip(mine, prints, strict=True)])
            at = np.concatenate([np.arange(len(p)) for p in prints])
            self.parts.append((width, HammingIndex(np.concatenate(prints), RADIUS), owner, at))

    def leaks(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        chunk: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, t in enumerate(texts):
            h = self.hash(words(t))
            if len(h):
                chunk.append((i, h))
                held += len(h)
            if held > _CHUNK:
                self._match(chunk, out)
                chunk, held = [], 0
        if chunk:
            self._match(chunk, out)
        return [sorted(set(x)) for x in out]

    def _match(self, chunk: list[tuple[int, np.ndarray]], out: list[list[int]]) -> None:
        sizes = np.array([len(h) for _, h in chunk])
        ends = np.cumsum(sizes)
        every = np.concatenate([h for _, h in chunk])
        n = len(self.items)
        for width, index, owner, at in self.parts:
            q, p = index.search(simhashes(every, width))
            doc = np.searchsorted(ends, q, side="right")
            inside = q + width <= ends[doc]
            q, p, doc = q[inside], p[inside], doc[inside]
            pair, at_item = doc * n + owner[p], at[p]
            diagonal = q - (ends[doc] - sizes[doc]) - at_item
            # pairs whose windows cover enough of the item's words, and enough of them lie in two bands of diagonals
            word = np.unique(np.concatenate([pair * self.longest + at_item + k for k in range(width)]))
            covered, count = np.unique(word // self.longest, return_counts=True)
            covered = covered[count >= self.covering[covered % n]]
            span = int(sizes.max()) + self.longest
            bands = 2 * span // BAND + 2
            window = np.unique((pair * bands + (diagonal + span) // BAND) * self.longest + at_item)
            band, count = np.unique(window // self.longest, return_counts=True)
            next_to = np.append(band[1:] == band[:-1] + 1, False) if len(band) else np.empty(0, bool)
            count = count + np.where(next_to, np.append(count[1:], 0), 0)
            banded = band[count >= self.needed[band // bands % n]] // bands
            wanted = np.intersect1d(covered, banded)
            mine = np.isin(pair, wanted)
            diagonals: dict[int, set[int]] = {}
            for k, d in zip(pair[mine].tolist(), diagonal[mine].tolist(), strict=True):
                diagonals.setdefault(k, set()).add(d)
            for k, found in diagonals.items():
                i, h = chunk[k // n]
                if held_share(self.items[k % n], h, found) >= LEAST_SHARE:
                    out[i].append(self.ids[k % n])


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds the item's passage or at least 40 percent of the item's words in order.

    Null and empty texts hold nothing; repeated documents are each reported; an item without words leaks nowhere.
    """
    spark = documents.sparkSession
    total = items.count()
    passes = max(1, -(-total // ITEMS_A_PASS))
    corpus = spread(documents.where("text is not null").select("doc_id", "text"), "doc_id")
    found = None
    for k in range(passes):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).select("item_id", "text")
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in mine.orderBy("item_id").collect()])
        one = corpus.select("doc_id", F.explode(_matcher(shared)("text")).alias("item_id"))
        found = one if found is None else found.unionByName(one)
    return found.distinct()


_built: dict[str, ItemIndex] = {}


def _index(shared) -> ItemIndex:
    key = str(getattr(shared, "_path", id(shared)))
    if key not in _built:
        _built.clear()
        _built[key] = ItemIndex(shared.value)
    return _built[key]


def _matcher(shared):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def match(texts: pd.Series) -> pd.Series:
        return pd.Series(_index(shared).leaks(texts.tolist()))

    return match


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents, sources): how far each leaked item has spread."""
    hits = leaked_items(documents, items).join(documents.select("doc_id", "source"), "doc_id")
    per = hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("source").alias("sources"))
    return per.join(items.select("item_id", "suite"), "item_id").select("item_id", "suite", "documents", "sources")
