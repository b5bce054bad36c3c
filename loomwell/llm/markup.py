"""Problem 4: markup that readers would see as characters, and its conversion to clean text with structure.

A sparse suffix array of each host (``suffixes``) tells the strings that its pages share; lines covered by them are
boilerplate and left out, and what is unique to a page is read for the four syntaxes. What stands in code samples,
however marked, is set aside first.
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions.htmlblocks import Page, parse_page
from loomwell.llm.suffixes import covered_lines, page_tokens, shared_suffixes, strings, suffixes
from loomwell.session import arrow_batches, broadcast_if_small, materialise, small, spread

#: Parameter: pages that are read together.
BATCH = 2_000
# Element names of HTML that count when they are shown as text.
TAGS = (
    "a abbr article aside b big blockquote br button center cite code dd del details div dl dt em embed figcaption figure font footer "
    "form h1 h2 h3 h4 h5 h6 header hr i iframe img input ins kbd label li link main mark meta nav object ol option p picture pre q s samp "
    "script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time tr tt u ul var video"
).split()
_TAG = re.compile(r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?:\s+[a-z-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});", re.I)

#: Code samples in any notation: shown html, wiki and LaTeX environments, fences, inline backquotes.
_SAMPLES = [
    re.compile(r"<(pre|code|samp|kbd|tt|xmp|textarea|syntaxhighlight|source|nowiki)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I),
    re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|alltt|Verbatim)\}.*?(?:\\end\{\1\}|\Z)", re.S),
    re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n]*\n.*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M),
    re.compile(r"\\(?:verb|lstinline)\*?([^A-Za-z\s*]).*?\1"),
    re.compile(r"\[code\b[^\]]*\].*?(?:\[/code\]|\Z)", re.S | re.I),
]
#: Without any of these no sample begins, and without any of those no syntax shows.
_SAMPLE_SIGNS = ("<", "\\", "```", "~~~", "[code", "[CODE")
_SIGNS = ("**", "__", "~~", "](", "]:", "`", "#", "---", "\n>", "\n-", "\n+", "\n*", "*", "_", "==", "[[", "[http", "[//", "''", "{|", "|-", "|}", "<", "{{", "\\", "$")
_TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
_INDENTED = re.compile(r"^(?:[ ]+|\t)\S.*$", re.M)

_MD_STRONG = re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?![\w*])|(?<![\w_\\])__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![\w_])|~~(?=\S)[^~\n]+?(?<=\S)~~")
_MD_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])")
_MD_LINK = re.compile(r"!?\[[^\[\]\n]*\]\((?:https?://|/|#|\.|mailto:)[^()\s]*(?:\s+\"[^\"\n]*\")?\)|^\[[^\]\n]+\]:\s+https?://\S+", re.M)
_MD_HEAD = re.compile(r"^#{1,6}[ \t]+\S[^\n]*$", re.M)
_MD_RULED = re.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M)
_MD_QUOTE = re.compile(r"^>[ \t]+\S", re.M)
_MD_FENCE = re.compile(r"^[ \t]{0,3}(?:```|~~~)", re.M)
_MD_LIST = re.compile(r"^[-+][ \t]+\S[^\n]*\n+[-+][ \t]+\S", re.M)

_WIKI_HEAD = re.compile(r"(?:^|(?<=\s))(={2,6})[ \t]*[^=\n]*[^=\s][ \t]*\1(?=\s|$)", re.M)
_WIKI_LINK = re.compile(r"\[\[[^\[\]\n{}]+\]\]|\[(?:https?:)?//[^\s\]]+[ \t]+[^\]\n]+\]")
_WIKI_QUOTE = re.compile(r"(?<!')'{2,3}(?!')(?=\S)[^\n]+?(?<=[^\s'])'{2,3}(?!')")
_WIKI_TABLE = re.compile(r"^\{\|.*$|^\|-+\s*$|^\|\}\s*$", re.M)
_WIKI_TAG = re.compile(r"</?(?:syntaxhighlight|nowiki|math|gallery|references|ref)\b[^<>]*>|__(?:NO)?TOC__|^#REDIRECT\b", re.I | re.M)
_WIKI_CALL = re.compile(r"\{\{[^{}|\n.$%]+\|[^{}\n]+\}\}")

_TEX_ENV = re.compile(r"\\(?:begin|end)\{([A-Za-z]+\*?)\}")
_MATH_ENVS = frozenset("math displaymath equation equation* align align* gather gather* multline eqnarray cases matrix pmatrix bmatrix".split())
_TEX_COMMAND = re.compile(
    r"\\(?:text(?:bf|it|tt|sc|rm|sf|sl)|emph|(?:sub){0,2}section\*?|chapter\*?|paragraph\*?|cite[pt]?|ref|eqref|autoref|label|footnote|href|url|caption|includegraphics|title|author|usepackage|documentclass|underline|mbox|textsuperscript)(?:\[[^\]\n]*\])?\{|\\item\b"
)
_TEX_MATH = re.compile(r"\\\[.+?\\\]|\\\(.+?\\\)", re.S)
_TEX_INNER = re.compile(r"\$\$[^$]+\$\$|(?<![\w\\$])\$(?=\S)[^$\n]*(?:[\\^_][A-Za-z0-9{(\\])[^$\n]*(?<=\S)\$(?![\w$])")


def without_samples(text: str, inline: bool = True) -> str:
    if any(sign in text for sign in _SAMPLE_SIGNS):
        for p in _SAMPLES:
            text = p.sub(lambda m: "\n" if "\n" in m[0] else " ", text)
    return _TICKS.sub("` `", text) if inline and "`" in text else text


def page_text(page: Page, without: set[int] | frozenset[int] = frozenset()) -> str:
    """The text of a page as its reader sees it, line by line, with the content of code elements left out."""
    return "\n".join(x.prose for i, x in enumerate(page.lines) if not x.pre and i not in without)


def evidence(text: str) -> dict[str, int]:
    """Weight of evidence for each syntax in text that should be plain; 2 or more is a case."""
    if text[:1] not in (">", "-", "+") and not any(sign in text for sign in _SIGNS):
        return {"html": 0, "markdown": 0, "wiki": 0, "latex": 0}
    ticks = len(_TICKS.findall(text))
    fences = len(_MD_FENCE.findall(text)) >= 2
    shown = text
    for p in _SAMPLES[1:]:
        shown = p.sub(" ", shown)
    shown = _SAMPLES[0].sub(lambda m: f"<{m[1]}></{m[1]}>", _INDENTED.sub("", _TICKS.sub("` `", shown)))
    plain = _INDENTED.sub("", without_samples(text))
    heads = _MD_HEAD.findall(plain)
    wiki = (
        3 * len(_WIKI_HEAD.findall(plain)) + 2 * len(_WIKI_LINK.findall(plain)) + 2 * len(_WIKI_QUOTE.findall(plain))
        + 2 * len(_WIKI_TABLE.findall(plain)) + 2 * len(_WIKI_TAG.findall(shown)) + 2 * len(_WIKI_CALL.findall(plain))
    )
    strong, links = len(_MD_STRONG.findall(plain)), len(_MD_LINK.findall(plain))
    markdown = 2 * strong + 2 * links + 2 * ticks + 2 * fences + 2 * bool(_MD_RULED.search(plain)) + 2 * bool(_MD_EM.search(plain))
    if wiki < 2:  # a line that begins with # is a numbered item in wiki text
        markdown += 2 * len(heads) + 2 * bool(_MD_QUOTE.search(plain)) + 2 * bool(_MD_LIST.search(plain))
    envs = _TEX_ENV.findall(plain)
    formulas = 2 * sum(e in _MATH_ENVS for e in envs) + 2 * bool(_TEX_MATH.search(plain)) + 2 * bool(_TEX_INNER.search(plain))
    latex = 2 * sum(e not in _MATH_ENVS for e in envs) + 2 * len(_TEX_COMMAND.findall(plain))
    if latex or max(markdown, wiki) < 4:  # formulas are written this way in the other syntaxes too
        latex += formulas
    return {"html": 2 * len(_TAG.findall(shown)), "markdown": markdown, "wiki": wiki, "latex": latex}


def _settled(weights: dict[str, int]) -> list[str]:
    return [k for k, w in weights.items() if w >= 2]


def html_residue(html: str | None, shared: set[int] | None = None) -> list[str]:
    """Kinds of markup shown, in the lines that no ``shared`` strings cover."""
    if not html:
        return []
    page = parse_page(html)
    return _settled(evidence(page_text(page, covered_lines(page, shared) if shared else frozenset())))


def excerpt_residue(excerpt: str | None) -> list[str]:
    """Kinds in a field that should be plain text: working tags and character references count as html here."""
    if not excerpt:
        return []
    weights = evidence(_html.unescape(excerpt))
    if _TAG.search(excerpt) or any(_html.unescape(m[0]) != m[0] for m in _ENTITY.finditer(excerpt)):
        weights["html"] = max(2, weights["html"])
    return _settled(weights)


# ---- conversion ----

_INLINE = [
    (re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[([^\[\]\n]+)\]\((?:https?://|/|#|\.|mailto:)[^()\s]*(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|Kategoria|Категория):[^\[\]\n]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Plik|Файл):(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]", re.I), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|\n{}]*\|)?([^\[\]|\n{}]+)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?:)?//[^\s\]]+[ \t]+([^\]\n]+)\]"), r"\1"),
    (re.compile(r"(?<!')'{2,5}(?!')((?=\S)[^\n]+?(?<=[^\s']))'{2,5}(?!')"), r"\1"),
    (re.compile(r"(?<![\w*\\])\*{1,3}(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*{1,3}(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_\\])_{1,2}(?=[^\s_])([^_\n]+?)(?<=[^\s_])_{1,2}(?![\w_])"), r"\1"),
    (re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~"), r"\1"),
    (re.compile(r"\\href(?:\[[^\]\n]*\])?\{[^{}\n]*\}\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"~?\\(?:cite[pt]?|ref|eqref|autoref|label|includegraphics)(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:text(?:bf|it|tt|sc|rm|sf|sl)|emph|underline|mbox|footnote|caption|url|title|author)\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\\([%&_#${}])"), r"\1"),
]
_ANY_HEAD = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*$|(={2,6})[ \t]*([^=]+?)[ \t]*\3$|\\((?:sub){0,2}section|chapter|paragraph)\*?\{([^{}\n]*)\}$")
_ANY_ITEM = re.compile(r"(?:[-+*][ \t]+|\\item\b[ \t]*|\d{1,3}[.)][ \t]+|[#*:;]+[ \t]+)(\S.*)")
_CODE_OPEN = re.compile(r"(```+|~~~+)|\\begin\{(?:verbatim\*?|lstlisting|minted|alltt)\}|<(?:pre|syntaxhighlight|source)\b[^<>]*>(?:<code\b[^<>]*>)?", re.I)
_CODE_CLOSE = re.compile(r"(```+|~~~+)$|\\end\{(?:verbatim\*?|lstlisting|minted|alltt)\}|(?:</code>)?</(?:pre|syntaxhighlight|source)\s*>", re.I)
_FORMULA = re.compile(r"\$\$.+\$\$|\\\[.+\\\]|\\\(.+\\\)|\\begin\{(?:equation|align|gather|displaymath)\*?\}.*|<math>.*</math>")
_DROPPED = re.compile(r"^(?:\{\|.*|\|-+|\|\}|\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?|\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\{[^{}]*\})?|-{3,}|\*{3,})$")
_BLOCK = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))


def _inline(text: str) -> str:
    text = _TAG.sub("", text)
    for p, by in _INLINE:
        text = p.sub(by, text)
    return " ".join(_TICKS.sub(r"\2", text).split())


def structured(html: str | None, shared: set[int] | None = None) -> list[tuple[str, int, str]]:
    """Blocks (kind, level, clean text): heading, paragraph, item, row, quote, code or formula. Lines that ``shared``
    strings cover are left out.

    Elements of working html, shown html, Markdown, wiki and LaTeX are read alike; code keeps its characters and line
    breaks, formulas keep their source, everything else loses its markup.
    """
    out: list[tuple[str, int, str]] = []
    code: list[str] | None = None
    row_node = None

    def put(kind: str, level: int, text: str) -> None:
        if text:
            out.append((kind, level, text))

    page = parse_page(html)
    without = covered_lines(page, shared) if shared else frozenset()
    for number, line in enumerate(page.lines):
        if number in without:
            continue
        raw = line.raw.rstrip()
        if line.pre:
            if out and out[-1][0] == "code" and out[-1][1] == line.nodes[0]:
                out[-1] = ("code", line.nodes[0], out[-1][2] + "\n" + raw)
            else:
                out.append(("code", line.nodes[0], raw))
            continue
        text = line.text
        if code is not None:
            if m := _CODE_CLOSE.search(text):
                code.append(raw[: raw.find(m[0])] if m[0] in raw else "")
                put("code", 0, "\n".join(code).strip("\n"))
                code = None
            else:
                code.append(raw)
            continue
        if (m := _CODE_OPEN.search(text)) and not _CODE_CLOSE.search(text, m.end()):
            put("paragraph", 0, _inline(text[: m.start()]))
            code = [raw[raw.find(m[0]) + len(m[0]) :]] if not m[1] else []
            continue
        if _DROPPED.match(text):
            continue
        tags = line.path
        if m := _FORMULA.fullmatch(text):
            put("formula", 0, text)
        elif m := _ANY_HEAD.match(text):
            put("heading", len(m[1] or m[3] or "") or 2, _inline(m[2] or m[4] or m[6] or ""))
        elif head := next((t for t in tags if re.fullmatch(r"h[1-6]", t)), None):
            put("heading", int(head[1]), _inline(text))
        elif "td" in tags or "th" in tags or text.startswith("|"):
            node = next((n for t, n in zip(reversed(tags), reversed(line.nodes), strict=False) if t == "tr"), None)
            cell = _inline(re.sub(r"\s*\|\|?\s*", " | ", text).strip(" |"))
            if node is not None and node == row_node and out and out[-1][0] == "row":
                out[-1] = ("row", 0, out[-1][2] + " | " + cell)
            else:
                put("row", 0, cell)
            row_node = node
        elif "li" in tags or "dd" in tags or "dt" in tags:
            put("item", tags.count("ul") + tags.count("ol"), _inline(text))
        elif m := _ANY_ITEM.match(text):
            put("item", 1, _inline(m[1]))
        elif "blockquote" in tags or text.startswith("> "):
            put("quote", 0, _inline(text.removeprefix("> ")))
        else:
            put("paragraph", 0, _inline(text))
    if code:
        put("code", 0, "\n".join(code).strip("\n"))
    return [(k, 0 if k == "code" else n, t) for k, n, t in out]


def _set(values) -> set[int] | None:
    return None if values is None else set(values)


@F.pandas_udf(_BLOCK)
def _blocks(values: pd.Series, shared: pd.Series) -> pd.Series:
    return pd.Series([structured(v, _set(s)) for v, s in zip(values, shared, strict=True)])


@F.pandas_udf(T.StringType())
def _plain(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(t for _, _, t in structured(v)))


_LONGS = T.ArrayType(T.LongType())


@F.pandas_udf(_LONGS)
def _kept(htmls: pd.Series) -> pd.Series:
    return pd.Series([suffixes(page_tokens(parse_page(h))[0])[0].tolist() for h in htmls])


@F.pandas_udf(_LONGS)
def _strings_of(htmls: pd.Series, shared: pd.Series) -> pd.Series:
    return pd.Series([strings(page_tokens(parse_page(h))[0], _set(s)).tolist() for h, s in zip(htmls, shared, strict=True)])


def _met(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """(seq, _shared): the suffixes of each page that are among ``shared`` (host, suffix), for pages that have any. They are
    fewer than the page's tokens; where those of all pages are small they are broadcast."""
    each = pages.select("seq", F.col("blog_id").alias("_h"), F.explode("suffixes").alias("suffix"))
    met = each.join(broadcast_if_small(shared), F.col("_h").eqNullSafe(F.col("host")) & (each["suffix"] == shared["suffix"]), "left_semi")
    return met.groupBy("seq").agg(F.collect_set("suffix").alias("_shared"))


def _with_shared(rows: DataFrame, asked: DataFrame, kept: DataFrame, posts: DataFrame) -> DataFrame:
    """Give each row (by seq) hashes of those of its strings that other pages have, or null. ``asked`` has the kept suffixes
    of these rows, ``kept`` those of all pages; pages with one that an asked page shares are read again at every position."""
    shared = shared_suffixes(kept)
    mine = asked.select(F.col("blog_id").alias("_h"), F.explode("suffixes").alias("_x")).distinct()
    needed = materialise(shared.join(mine, F.col("host").eqNullSafe(F.col("_h")) & (F.col("suffix") == F.col("_x")), "left_semi"), "asked-suffixes")
    met = materialise(_met(kept, needed), "met-suffixes")
    htmls = spread(posts.select("seq", "blog_id", "key", "html"), "seq").join(broadcast_if_small(met), "seq")
    with arrow_batches(posts.sparkSession, BATCH):
        found = materialise(htmls.select("seq", "blog_id", "key", _strings_of("html", "_shared").alias("suffixes")), "page-strings")
    return rows.join(_met(found, shared_suffixes(found)), "seq", "left")


def clean_text(posts: DataFrame) -> DataFrame:
    """(seq, block, kind, level, text) of html and (seq, -1, 'excerpt', 0, text) of excerpts: clean text in order, without
    the lines that the host's pages share.

    Null and empty fields give no rows.
    """
    rows = spread(posts.select("seq", "blog_id", "key", "html", "excerpt"), "seq")
    kept = materialise(rows.where("html <> ''").select("seq", "blog_id", "key", _kept("html").alias("suffixes")), "page-suffixes")
    bodies = _with_shared(rows.select("seq", "html"), kept, kept, posts)
    body = bodies.select("seq", F.posexplode(_blocks(F.coalesce("html", F.lit("")), "_shared")).alias("block", "b")).select("seq", "block", "b.kind", "b.level", "b.text")
    short = rows.where("excerpt <> ''").select("seq", F.lit(-1).alias("block"), F.lit("excerpt").alias("kind"), F.lit(0).alias("level"), _plain("excerpt").alias("text"))
    return body.unionByName(short)


_STRINGS = T.ArrayType(T.StringType())
_READ = T.StructType([T.StructField("html_kinds", _STRINGS), T.StructField("excerpt_kinds", _STRINGS), T.StructField("suffixes", _LONGS)])


@F.pandas_udf(_READ)
def _read(htmls: pd.Series, excerpts: pd.Series) -> pd.DataFrame:
    out = []
    for h, e in zip(htmls, excerpts, strict=True):
        page = parse_page(h)
        out.append((_settled(evidence(page_text(page))), excerpt_residue(e), suffixes(page_tokens(page)[0])[0].tolist()))
    return pd.DataFrame(out, columns=_READ.names)


@F.pandas_udf(_STRINGS)
def _unique_kinds(htmls: pd.Series, shared: pd.Series) -> pd.Series:
    return pd.Series([html_residue(h, _set(s)) for h, s in zip(htmls, shared, strict=True)])


def residue(posts: DataFrame) -> DataFrame:
    """(seq, field, kind) of the markup that readers would see. Null and empty fields have none.

    One pass reads every page for syntax and for its suffixes. Leaving lines out can't add a case to a page without any,
    so only pages with syntax, and those that share strings with them, are read again for these strings, and pages with
    syntax and with such strings once more without these.
    """
    rows = spread(posts.select("seq", "blog_id", "key", "html", "excerpt"), "seq")
    with arrow_batches(posts.sparkSession, BATCH):
        seen = materialise(rows.select("seq", "blog_id", "key", _read("html", "excerpt").alias("r")).select("seq", "blog_id", "key", "r.*"), "markup-pages")
    marked = seen.where(F.size("html_kinds") > 0)
    again = materialise(_with_shared(marked.select("seq", "html_kinds"), marked.select("seq", "blog_id", "suffixes"), seen, posts), "markup-shared")
    doubtful = again.where("_shared is not null").select("seq", "_shared").dropDuplicates(["seq"])
    htmls = posts.select("seq", "html").join(F.broadcast(doubtful) if small(doubtful) else doubtful, "seq")
    reread = htmls.select("seq", F.explode(_unique_kinds("html", "_shared")).alias("kind"))
    plain = again.where("_shared is null").select("seq", F.explode("html_kinds").alias("kind"))
    html = plain.unionByName(reread).select("seq", F.lit("html").alias("field"), "kind")
    excerpt = seen.select("seq", F.lit("excerpt").alias("field"), F.explode("excerpt_kinds").alias("kind"))
    return html.unionByName(excerpt).distinct()
