"""Problem 10: text decoded with the wrong character set, found and restored by minimum description length.

Every candidate chain of decodings is applied to the damaged stretches of a line, each result is compressed with
zstandard dictionaries trained per language, and the shortest description (compressed bytes of the best language plus
the cost of the chain) wins. The text stays as it is unless a chain is shorter.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.session import materialise, spread

#: Parameters: size of a language's dictionary; characters of its texts that are trained on together, and bytes of a piece
#: where the dictionaries of several such parts are trained on for one.
DICT_BYTES, PART_CHARS, PIECE = 48_000, 32_000_000, 1_000
#: Cost in bytes of one step of a chain; the share of the description that a chain of letters has to save beyond that;
#: characters on either side of the changed stretch that are described with it; cost of a character that no language uses.
STEP_COST, LETTER_MARGIN, CONTEXT, STRANGE_COST = 1, 0.2, 40, 4
#: Log probability of two characters side by side that no language has.
UNKNOWN_PAIR = -14.0
#: A text with a character that a smaller share of its language has is not learned from.
RARE_SHARE = 0.04

# Character sets that UTF-8 bytes are commonly read with, and (read with, meant) pairs of one-byte sets.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_15")
ONE_BYTE_PAIRS = (
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "koi8_r"), ("cp866", "cp1251"),
    ("cp1251", "cp866"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1250", "cp1252"), ("iso8859_2", "cp1250"), ("cp1250", "iso8859_2"),
    ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"),
)

#: A short run that stands alone between quotation marks or backquotes is quoted as an example.
_QUOTED = re.compile("(?<=[“„«‹\"'‘`])[^\x00-\x7f\\s“”„«»‹›‘]{1,9}(?=[”“»›\"'’`])")
#: Character references in plain text: damage of text that was written out as html after it was misread.
_REFERENCES = re.compile(r"&(?:#(?:\d{3,7}|[xX][0-9a-fA-F]{2,6})|[A-Za-z][A-Za-z0-9]{1,30});")
_QUOTED_REFERENCES = re.compile("(?<=[“„«‹\"'‘`])(?:" + _REFERENCES.pattern + "){1,9}(?=[”“»›\"'’`])")
#: Words as they are told apart here: damaged letters can be signs or hard spaces.
_WORDS = re.compile(r"[^ \t\r\n\f\v]+")


@lru_cache(64)
def _to_byte(charset: str) -> dict[int, str]:
    """Code point to the byte it was read from, as a character; bytes without a meaning stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            c = chr(b)
        table[ord(c)] = chr(b)
    return table


@lru_cache(64)
def _letters(read: str, meant: str) -> dict[int, str]:
    table = {}
    for c, b in _to_byte(read).items():
        try:
            m = b.encode("latin-1").decode(meant)
        except UnicodeDecodeError:
            continue
        if ord(m) != c and m.isprintable():
            table[c] = m
    return table


@lru_cache(64)
def _sequences(charset: str) -> re.Pattern[str]:
    """The multi-byte UTF-8 sequences as they look when read with ``charset``."""
    def among(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(chr(c)) for c, b in _to_byte(charset).items() if lo <= ord(b) <= hi) + "]"

    tail = among(0x80, 0xBF)
    return re.compile(f"{among(0xC2, 0xDF)}{tail}|{among(0xE0, 0xEF)}{tail}{{2}}|{among(0xF0, 0xF4)}{tail}{{3}}")


@lru_cache(64)
def _ends(charset: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters that such a sequence begins with, and those that it goes on with."""
    table = _to_byte(charset).items()
    return frozenset(chr(c) for c, b in table if 0xC2 <= ord(b) <= 0xF4), frozenset(chr(c) for c, b in table if 0x80 <= ord(b) <= 0xBF)


def _reread(line: str, charset: str, quoted: list[tuple[int, int]]) -> str:
    """Read again as UTF-8 every sequence that ``charset`` could have made of one character."""
    table = _to_byte(charset)

    def one(m: re.Match[str]) -> str:
        if any(m.start() < b and a < m.end() for a, b in quoted):
            return m[0]
        try:
            return m[0].translate(table).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]

    return _sequences(charset).sub(one, line)


def candidates(line: str) -> list[tuple[str, str, float]]:
    """(chain, text, margin) of the ways to read a line anew; quoted examples are left alone."""
    quoted = [x.span() for x in _QUOTED.finditer(line)]
    found: dict[str, tuple[str, float]] = {}
    layer = {line: ""}
    while layer:  # text can be damaged more than once; each reading is shorter than what it reads
        nxt: dict[str, str] = {}
        for text, chain in layer.items():
            spans = quoted if not chain else [x.span() for x in _QUOTED.finditer(text)]
            held = set(text)
            for cs in UTF8_READ_AS:
                if any(map(held.isdisjoint, _ends(cs))):
                    continue
                new = _reread(text, cs, spans)
                if new != text and new not in found and new not in nxt:
                    nxt[new] = f"{chain} {cs}>utf-8".strip()
        found |= {t: (c, 0) for t, c in nxt.items()}
        layer = nxt
    return [(c, t, m) for t, (c, m) in found.items()]


def letter_candidates(line: str, pairs: LetterPairs) -> list[tuple[str, int, int, str]]:
    """(chain, start, end, text) of the stretches of words whose letters another one-byte set reads better, judged by the
    letter pairs of the languages; none may turn a letter into something else."""
    words = [(m.start(), m.end(), pairs.gains(m[0])) for m in _WORDS.finditer(line) if not m[0].isascii()]
    quoted = [x.span() for x in _QUOTED.finditer(line)]
    words = [w for w in words if not any(w[0] < b and a < w[1] for a, b in quoted)]
    found: dict[tuple[int, int, str], str] = {}
    for i in sorted({i for _, _, g in words for i, x in enumerate(g) if x > 0}):
        read, meant = ONE_BYTE_PAIRS[i]
        table = _letters(read, meant)
        for start, end in _stretches([(a, b, g[i]) for a, b, g in words]):
            old = line[start:end]
            wide = [c for c in old if ord(c) > 127]
            new = old.translate(table)
            if all(a == b or unicodedata.category(a) in ("Pi", "Pf", "Pd") for a, b in zip(old, new, strict=True)):
                continue  # quotation marks and dashes alone tell nothing
            if not any(c.isalpha() and ord(c) in table and not table[ord(c)].isalpha() for c in wide):
                found.setdefault((start, end, new), f"{read}>{meant}")
    return [(chain, start, end, new) for (start, end, new), chain in found.items()]


def _stretches(words: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Stretches of words (start, end, gain) with the greatest total gain; a stretch is over once its total is used up."""
    out, first, total, most, last = [], 0, 0.0, 0.0, 0
    k = 0
    while k < len(words):
        if not total:
            first, most = k, 0.0
        total += words[k][2]
        if total > most:
            most, last = total, k
        k += 1
        if total <= 0 or k == len(words):
            if most > 0:
                out.append((words[first][0], words[last][1]))
                k = last + 1
            total = most = 0.0
    return out


class LetterPairs:
    """How likely two characters stand side by side, in the language that has them most; words are asked once."""

    def __init__(self, counts: dict[str, Counter[str]]):
        self.log: dict[str, float] = {}
        for found in counts.values():
            every = sum(found.values()) + 1
            for p, n in found.items():
                self.log[p] = max(self.log.get(p, UNKNOWN_PAIR), math.log(n / every))
        self.gains = lru_cache(50_000)(self._gains)

    @staticmethod
    def count(text: str) -> Counter[str]:
        padded = f" {' '.join(text.split())} "
        return Counter(p for p in map("".join, zip(padded, padded[1:], strict=False)) if not p.isascii())

    def _score(self, word: str) -> float:
        padded = f" {word} "
        return sum(self.log.get(a + b, UNKNOWN_PAIR) for a, b in zip(padded, padded[1:], strict=False) if a > "\x7f" or b > "\x7f")

    def _gains(self, word: str) -> list[float]:
        """By how much each of ONE_BYTE_PAIRS makes the word more likely."""
        now = self._score(word)
        news = [word.translate(_letters(*p)) for p in ONE_BYTE_PAIRS]
        return [0.0 if new == word else self._score(new) - now for new in news]


class Describer:
    """Length of a text in bytes under the language that describes it best."""

    def __init__(self, dictionaries: dict[str, bytes], alphabet: str = "", pairs: dict[str, Counter[str]] | None = None):
        self.pairs = LetterPairs(pairs or {k: LetterPairs.count(d.decode("utf-8", "ignore")) for k, d in dictionaries.items()})
        self.strange = re.compile("[^\x00-\x7f" + re.escape(alphabet) + "]")
        made = [zstandard.ZstdCompressionDict(d) for d in dictionaries.values()] or [None]
        params = dict(level=12, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.lines: dict[str, tuple[str, str | None]] = {}
        self.packers = [zstandard.ZstdCompressor(dict_data=d, **params) if d else zstandard.ZstdCompressor(**params) for d in made]

    def cost(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        best = min(len(p.compress(raw)) for p in self.packers)
        return best + STRANGE_COST * len(self.strange.findall(text))


def _window(old: str, new: str) -> tuple[str, str]:
    """Both texts from CONTEXT characters before their first difference to as many after the last."""
    lo = next((i for i, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
    most = min(len(old), len(new)) - lo
    hi = next((i for i in range(most) if old[-1 - i] != new[-1 - i]), most)
    start, end = max(0, lo - CONTEXT), max(0, hi - CONTEXT)
    return old[start : len(old) - end], new[start : len(new) - end]


def _repair_letters(line: str, describer: Describer, cost) -> tuple[float, str, list[str]]:
    """(bytes saved, text, chains): the stretches whose description gets shorter by another one-byte set, best first."""
    options = []
    for name, start, end, new in letter_candidates(line, describer.pairs):
        before, after = line[max(0, start - CONTEXT) : start], line[end : end + CONTEXT]
        now = cost(before + line[start:end] + after)
        saved = now - cost(before + new + after) - STEP_COST * name.count(">") - LETTER_MARGIN * now
        if saved > 0:
            options.append((-saved, start, end, new, name))
    taken: list[tuple[int, int, str, str]] = []
    total = 0.0
    for less, start, end, new, name in sorted(options):
        if all(end <= a or b <= start for a, b, _, _ in taken):
            taken.append((start, end, new, name))
            total -= less
    for start, end, new, _ in sorted(taken, reverse=True):
        line = line[:start] + new + line[end:]
    return total, line, list(dict.fromkeys(name for *_, name in sorted(taken)))


def without_references(line: str) -> str:
    """References to characters beyond ASCII as these characters; others stay, and so do quoted examples."""
    if "&" not in line or ";" not in line:
        return line

    def one(m: re.Match[str]) -> str:
        c = html.unescape(m[0])
        return c if c != m[0] and all(ord(x) > 127 for x in c) else m[0]

    plain = _REFERENCES.sub(one, line)
    if plain == line:
        return line
    quoted = [x.span() for x in _QUOTED_REFERENCES.finditer(line)]
    return _REFERENCES.sub(lambda m: m[0] if any(a <= m.start() < b for a, b in quoted) else one(m), line) if quoted else plain


def repair_line(line: str, describer: Describer) -> tuple[str, str | None]:
    """(text, chain): the shortest description; chain is None where the line stays. Character references are read first,
    but where no decoding follows they are no damage and stay."""
    read = without_references(line)
    if read.isascii():
        return line, None
    text, chain = _shortest(read, describer)
    if chain is None:
        return line, None
    return text, chain if read == line else f"references, {chain}"


def _shortest(line: str, describer: Describer) -> tuple[str, str | None]:
    best, most, chain = line, 0.0, None
    costs: dict[str, int] = {}

    def cost(text: str) -> int:
        if text not in costs:
            costs[text] = describer.cost(text)
        return costs[text]

    for name, text, margin in candidates(line):
        old, new = _window(line, text)
        now = cost(old)
        saved = now - cost(new) - STEP_COST * name.count(">") - margin * now
        if saved > most:
            best, most, chain = text, saved, name
    options = [(most, best, chain)]
    for saved, text, so_far in dict.fromkeys(((0.0, line, None), (most, best, chain))):  # as it was, and what is left
        more, new, names = _repair_letters(text, describer, cost)
        if names:
            options.append((saved + more, new, ", ".join([*([so_far] if so_far else []), *names])))
    return max(options, key=lambda o: o[0])[1:]


def lost_characters(text: str) -> bool:
    """Replacement characters outside quoted examples: damage that nothing can undo."""
    return "�" in _QUOTED.sub("", text)


def repair_text(text: str | None, describer: Describer) -> tuple[str | None, str | None, bool]:
    """(restored text, chains used, characters lost). Nulls and empty texts come back as they are."""
    if not text:
        return text, None, False
    lines, chains = [], []
    known = describer.lines  # texts repeat their lines
    if len(known) > 20_000:
        known.clear()
    for line in text.split("\n"):
        if line.isascii() and "&" not in line:
            lines.append(line)
            continue
        if line not in known:
            known[line] = repair_line(line, describer)
        new, chain = known[line]
        lines.append(new)
        if chain and chain not in chains:
            chains.append(chain)
    return "\n".join(lines), ", ".join(chains) or None, lost_characters(text)


def _usable(text: str) -> str | None:
    """The characters beyond ASCII of a text that can be learned from; None where it is damaged beyond doubt."""
    if text.isascii():
        return ""
    held = set(text)
    if "�" in held or any(not any(map(held.isdisjoint, _ends(cs))) and _reread(text, cs, []) != text for cs in UTF8_READ_AS[:4]):
        return None
    return "".join(sorted(c for c in held if ord(c) > 127))


@F.pandas_udf(T.StringType())
def _characters(texts: pd.Series) -> pd.Series:
    return pd.Series([_usable(t) for t in texts], dtype=object)


def _trained(samples: list[bytes]) -> bytes | None:
    if len(samples) < 3:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves as the dictionary
        return b"\n".join(sorted(samples))[-DICT_BYTES:]


def train_dictionaries(documents: DataFrame) -> tuple[dict[str, bytes], str, dict[str, Counter[str]]]:
    """A zstandard dictionary a language, the characters in use beyond ASCII and the letter pairs a language, from all documents.

    Left out are damaged texts, and those that are not typical of their language: with a character that few of its texts
    have, or capitals after small letters in a word, since damage of a few kinds repeats itself and would end up in the
    dictionary. A language of more than PART_CHARS is trained on in parts of that size, then on their dictionaries.
    """
    spark = documents.sparkSession
    told = documents.where("text is not null and lang is not null").select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("lang"), "text")
    texts = materialise(spread(told, "doc_id").withColumn("chars", _characters("text")).where("chars is not null"), "learned-texts")
    sizes = {x.lang: x for x in texts.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}
    seen = texts.where("chars <> ''").select("lang", F.explode(F.split("chars", "")).alias("c")).where("c <> ''").groupBy("lang", "c").count().collect()
    rare: dict[str, set[str]] = {}
    for x in seen:
        if x["count"] < RARE_SHARE * sizes[x.lang].n:
            rare.setdefault(x.lang, set()).add(x.c)
    parts = {k: max(1, -(-(x.size or 0) // PART_CHARS)) for k, x in sizes.items()}
    schema = "lang string, dictionary binary, chars string, pairs map<string,long>"

    def part(group: pd.DataFrame) -> pd.DataFrame:
        lang = group["lang"].iloc[0]
        none = rare.get(lang, set())
        rows = sorted(zip(group["doc_id"], group["text"], group["chars"], strict=True), key=lambda x: (str(x[0]), x[1]))
        typical = [(t, c) for _, t, c in rows if none.isdisjoint(c) and not re.search("[а-яё][А-ЯЁ]", t)]
        pairs: Counter[str] = Counter()
        for t, _ in typical:
            pairs.update(LetterPairs.count(t))
        chars = "".join(sorted({c for _, cs in typical for c in cs}))
        return pd.DataFrame([(lang, _trained([t.encode() for t, _ in typical]), chars, dict(pairs))], columns=["lang", "dictionary", "chars", "pairs"])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        found = sorted(d for d in group["dictionary"] if d is not None)
        one = found[0] if len(found) == 1 else _trained([d[i : i + PIECE] for d in found for i in range(0, len(d), PIECE)])
        return pd.DataFrame([(group["lang"].iloc[0], one)], columns=["lang", "dictionary"])

    number = F.lit(1)
    for lang, n in parts.items():
        if n > 1:
            number = F.when(F.col("lang") == lang, F.lit(n)).otherwise(number)
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), number))
    made = materialise(dealt.groupBy("lang", "part").applyInPandas(part, schema), "dictionary-parts")
    out = {x.lang: bytes(x.dictionary) for x in made.groupBy("lang").applyInPandas(whole, "lang string, dictionary binary").orderBy("lang").collect() if x.dictionary is not None}
    alphabet = {c for x in made.select("chars").distinct().collect() for c in x.chars}
    pairs: dict[str, Counter[str]] = {k: Counter() for k in sorted(parts)}
    for x in made.select("lang", F.explode("pairs").alias("pair", "n")).groupBy("lang", "pair").agg(F.sum("n").alias("n")).collect():
        pairs[x.lang][x.pair] = x.n
    return out, "".join(sorted(alphabet)), pairs


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("chain", T.StringType()), T.StructField("lost", T.BooleanType())])


def repair_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, chain, restorable, text) of the documents with a wrongly decoded stretch.

    ``chain`` names the decodings that were undone (null when characters are lost and nothing else is wrong),
    ``restorable`` says that no character is lost. Pure ASCII texts without character references are dropped in the scan. Null texts are no cases;
    repeated rows come out once each.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train_dictionaries(documents))

    @F.pandas_udf(_RESULT)
    def repaired(texts: pd.Series) -> pd.DataFrame:
        describer = _describer(shared)
        return pd.DataFrame([repair_text(t, describer) for t in texts], columns=["text", "chain", "lost"])

    wide = spread(documents.where(F.col("text").rlike(r"[^\x00-\x7F]|&[#A-Za-z][0-9A-Za-z]*;")).select("doc_id", "text"), "doc_id")
    done = wide.select("doc_id", repaired("text").alias("r"))
    return done.where("r.chain is not null or r.lost").select("doc_id", "r.chain", (~F.col("r.lost")).alias("restorable"), "r.text")


_made: dict[str, Describer] = {}


def _describer(shared) -> Describer:
    """One set of compressors a worker process and broadcast."""
    key = str(getattr(shared, "_path", id(shared)))
    if key not in _made:
        _made.clear()
        _made[key] = Describer(*shared.value)
    return _made[key]


def damaged_documents(documents: DataFrame) -> DataFrame:
    return repair_documents(documents).select("doc_id").distinct()
