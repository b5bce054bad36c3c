"""Problem 1: posts that were cut off.

Two kinds of evidence are added up as log odds. Lengths: per blog, source and measure, values that far more rows have
than a right-censored log-normal distribution (fitted by maximum likelihood) allows are candidate limits, and the excess
gives the posterior that a row at a limit is censored. Endings: where and how the article's last line stops, whatever
was appended after it, read with how often words end a line in all rows; how much each sign tells is fitted on the signs
of all rows by expectation-maximisation, in which rows at a limit weigh by their posterior.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions.htmlblocks import Line, Page, parse_page
from loomwell.functions.htmllines import fold_line
from loomwell.llm import boilerplate, residue
from loomwell.llm.boilerplate import LineModel, label_lines, stated_part
from loomwell.llm.repeated_lines import LineCounts, each_line, line_table
from loomwell.session import arrow_batches, broadcast_if_small, materialise, small, spread

#: Parameters: a site line is in so many keys of its blog; pages that are looked at together.
SITE_KEYS, BATCH = 4, 1_000
#: Rows of one length, and times the number expected there, that make it a candidate limit.
LIMIT_ROWS, LIMIT_EXCESS = 6, 8.0
#: Log odds that a row was cut, before any evidence and any fit; rounds of the fit; rows that the starting odds weigh as
#: beside those counted; greatest log odds of one sign.
PRIOR, ROUNDS, START_ROWS, MOST_ODDS = -3.0, 12, 8.0, 9.0

_WORD = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*")
_CLOSED = re.compile(r"[.!?;:。！？…]['\"”’»)\]]*$")
_ELLIPSIS = re.compile(r"\s*(?:\[\s*(?:…|\.\.\.)\s*\]|\(…\)|…|\.\.\.)$")
_SIGNED = re.compile(r"^[—–-]+\s*\S{2,}(?:\s+\S+){0,3}(?:\s+\S{2,})$")
_BROKEN_TAG = re.compile(r"<[a-zA-Z/][^<>]*(?=<[a-zA-Z/])")
#: Lines that end whole without a full stop in text of any syntax: formulas, environments, table rows, fences, lists, links.
_STRUCTURE = re.compile(r"^(?:\\(?:begin|end|item|section|\[|\().*|.*(?:\\\]|\\\)|\$\$|\}|\$|\|\}?|```|\]\]|\\\\|>|\*\*|==)|(?:[-*+#:>|=!]|\d+\.)\s.*|\{\|.*|```.*|~~~.*|!\[.*|\[\[.*)$")


#: Elements that sloppy html closes all the same; one that is still open at the end was cut.
OPEN = frozenset("ul ol dl table blockquote pre code em strong a b i u small span figure figcaption aside div section article main header footer nav h1 h2 h3 h4 h5 h6 td th button".split())


#: Words in the engine's regular expressions, and those that end a line.
_WORDS = r"[\p{L}\p{N}]++(?:[’'-][\p{L}\p{N}]++)*+"
_ENDING_WORDS = rf"(?<![\p{{L}}\p{{N}}]){_WORDS}(?=[^\p{{L}}\p{{N}}\n]*+(?:\n|\z))"


def whole_lines(page: Page) -> str:
    """A page's lines but for the last one and code, in lower case: where words are counted."""
    return "\n".join([x.text for x in page.lines[:-1] if not x.pre]).lower()


def line_hash(line: str) -> int:
    """The first half of a line's hash in ``LineCounts``, as the engine computes it."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def article_end(page: Page, site: frozenset[int] | set[int], model: LineModel) -> tuple[Line | None, bool]:
    """The article's last line, and whether anything was left out after it; ``site`` holds hashes of the blog's site lines."""
    lines = page.lines
    if page.cut_tag or OPEN.intersection(page.open_tags):
        return (lines[-1] if lines else None), False  # nothing whole can follow an element that is still open
    around = label_lines(lines, model)
    k = len(lines)
    while k:
        x = lines[k - 1]
        alone = around[k - 1] and not (k > 1 and around[k - 2]) and stated_part(x) is not True and not re.search(r"[|©]|\w{3}.*[.!]$", x.text)
        if _ELLIPSIS.search(x.text) or not ((around[k - 1] and not alone) or line_hash(fold_line(x.text)) in site):
            break
        k -= 1
    return (lines[k - 1] if k else None), k < len(lines)


#: Signs of an ending: how the html stops, how the line does, where it stands, and how its last word is used otherwise.
SIGNS = ("stop", "form", "place", "use")


def ending_signs(html: str, page: Page, line: Line, appended: bool) -> tuple[str, str, str, str | None]:
    """(stop, form, place, last word); the word only where the line ends with one."""
    text, rest = line.text, html[line.end :]
    stop = "plain"
    ellipsis = _ELLIPSIS.search(text)
    if not appended and page.cut_tag:
        stop = "in a tag"
    elif _BROKEN_TAG.match(rest.lstrip()) or (appended and re.match(r"\s*<[a-zA-Z/][^<>]*\n", rest)):
        stop = "broken tag"
    elif not appended and page.cut_reference:
        stop = "in a reference"
    elif ellipsis:
        stop = "ellipsis" if len(text) - len(ellipsis[0]) < 3 or not _CLOSED.search(text[: ellipsis.start()]) else "ellipsis after a sentence"
    elif OPEN.intersection(page.open_tags):
        stop = "open element"
    elif text.endswith("\ufffd"):
        stop = "half a character"
    elif not appended and rest == " ":
        stop = "space"
    open_now = not rest.strip() or not re.match(r"\s*</", rest)
    shut = not open_now and not {"ul", "ol", "table", "blockquote", "figure"}.intersection(page.open_tags)
    found = _WORD.findall(text)
    last = found[-1] if found else ""
    structured = bool(_STRUCTURE.match(text))
    kind = next((t for t in reversed(line.path) if t in ("li", "td", "th", "figcaption", "dt", "dd", "button", "footer") or re.fullmatch(r"h[1-6]", t)), "p")
    if kind == "p" and "blockquote" in line.path:
        place = "quote" + (", closed" if shut else "")
    elif kind == "p" and not structured and not ("td" in line.path or "table" in line.path):
        place = "long paragraph" if len(found) >= 6 else "short paragraph"
    elif kind[0] == "h" and not appended:
        place = "heading at the end"
    else:
        place = ("structure" if kind == "p" else "entry") + (", closed" if shut else "")
    word = None
    if line.pre:
        form = "code, open" if "pre" in page.open_tags else "code"
    elif line.raw[:1] in " \t" and line.tag in ("", "div", "article", "main", "section"):
        form = "indented"
    elif ellipsis:
        form = "ellipsis"
    elif _CLOSED.search(text) and not text.endswith(":"):
        form = "closed"
    elif _SIGNED.match(text) and len(text) < 60:
        form = "signature"
    elif last and text.endswith(last) and not last.isdigit():
        form, word = "word", last.lower()
    elif text and text[-1] in ",(–—-/&„“«":
        form = "open mark"
    else:
        form = "other"
    return stop, form, place, word


#: Starting log odds of the fit, by sign; what isn't named starts at 0. ("form", "place") is one sign.
START = {
    "in a tag": 8.0, "broken tag": 7.0, "in a reference": 6.0, "ellipsis": 6.0, "ellipsis after a sentence": 3.0, "open element": 6.0, "half a character": 5.0, "space": 2.0,
    "code": -5.0, "indented": -3.0, "closed": -6.0, "signature": -6.0, "open mark": 3.0,
    "long paragraph": 4.5, "short paragraph": 3.0, "heading at the end": 1.5, "structure": -1.0, "entry": -0.5, "quote": 1.0, "structure, closed": -6.5, "entry, closed": -6.0, "quote, closed": 0.0,
    "half a word": 5.0, "hardly ends": 4.0, "seldom ends": 2.0, "ends": -1.0, "often ends": -2.0,
}
_SETTLED = frozenset(("in a tag", "broken tag", "in a reference", "ellipsis", "ellipsis after a sentence"))
_WHOLE = frozenset(("code", "indented", "closed", "signature", "ellipsis", "code, open"))
#: By the statement of the problem a row that stops after a whole sentence, sample, signature, list or table is no case,
#: however many rows stop at its length: this is stated, not fitted, unless something else was left open or the last word
#: is one that doesn't end lines.
_STATED = {"entry, closed": -30.0, "structure, closed": -30.0, "code": -30.0, "indented": -30.0, "closed": -30.0, "signature": -30.0}


def features(signs: tuple[str, str, str, str]) -> list[str]:
    """What is weighed of an ending: a stop that settles the matter alone; else the stop, and the form together with the
    place and the use of the last word where these tell something, since they depend on each other."""
    stop, form, place, use = signs
    if stop in _SETTLED:
        return [stop]
    if form in _WHOLE:
        return [stop, form if stop == "open element" or form not in _STATED else f"{form}, nothing open"]
    if stop != "open element" and place in ("entry, closed", "structure, closed") and use not in ("half a word", "hardly ends"):
        return [stop, f"{place}, nothing open"]
    return [stop, f"{form} in {place}, {use}"]


def starting_odds(signs: tuple[str, str, str, str]) -> dict[str, float]:
    stop, form, place, use = signs
    names = features(signs)
    if len(names) == 1:
        return {stop: START[stop]}
    if names[1].endswith(", nothing open"):
        return {stop: START.get(stop, 0.0), names[1]: _STATED[names[1].removesuffix(", nothing open")]}
    if form in _WHOLE:
        return {stop: START.get(stop, 0.0), form: START.get(form, 0.0)}
    each = START.get(use, 0.0)
    if place.endswith("closed") and each >= 4.0:
        each += 5.5  # a closed element that ends with half a word was closed by whoever cut it
    return {stop: START.get(stop, 0.0), names[1]: START.get(form, 0.0) + START.get(place, 0.0) + each}


def fit_endings(counted: dict[tuple[tuple[str, str, str, str], float], int]) -> dict[str, float]:
    """Log odds of each feature, and of a cut as such (""), from rows counted by signs and by the log odds that their
    lengths give: expectation-maximisation over the classes cut and whole.

    Each round weighs every kind of row by its posterior and counts features a class; START_ROWS rows that follow the
    starting odds are counted along, so that a sign that few rows have keeps its start.
    """
    start: dict[str, float] = {}
    for signs, _ in counted:
        start |= starting_odds(signs)
    weights = start | {"": PRIOR}
    for _ in range(ROUNDS):
        cut: dict[str, float] = defaultdict(float)
        every: dict[str, float] = defaultdict(float)
        for (signs, length), n in counted.items():
            names = features(signs)
            odds = weights[""] + length + sum(weights[f] for f in names)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            for f in ("", *names):
                cut[f] += n * p
                every[f] += n
        total, whole = cut[""] + 1, every[""] - cut[""] + 1
        new = {"": max(-6.0, min(0.0, math.log(total / whole)))}
        for f, first in start.items():
            if first == _STATED.get(f.removesuffix(", nothing open")):
                new[f] = first
                continue
            # the rows that the start adds: as many as START_ROWS, split as its odds and the prior say
            share = 1 / (1 + math.exp(-(first + new[""])))
            a, b = cut[f] + START_ROWS * share, every[f] - cut[f] + START_ROWS * (1 - share)
            new[f] = max(-MOST_ODDS, min(MOST_ODDS, math.log(a / b) - new[""]))
        if max(abs(new[f] - weights[f]) for f in new) < 1e-3:
            return new
        weights = new
    return weights


def word_use() -> Column:
    """How the last word is used in the whole lines of all rows, from how often it occurs (n), ends lines (ends), and
    begins other words (begins)."""
    n, share = F.coalesce("n", F.lit(0)), F.col("ends") / F.col("n")
    use = F.when(share < 0.01, "hardly ends").when(share < 0.04, "seldom ends").when(share < 0.15, "ends").otherwise("often ends")
    return F.when(F.col("word").isNull(), "").when((n == 0) & F.coalesce("begins", F.lit(False)), "half a word").when(n >= 4, use).otherwise("unknown")


def censored_fit(logs: list[tuple[float, int]], limits: dict[float, int]) -> tuple[float, float]:
    """Mean and spread of a log-normal from (log length, rows) and rows censored at log limits, by maximum likelihood
    (expectation-maximisation with the moments of the normal tail)."""
    n = sum(k for _, k in logs) + sum(limits.values())
    s1, s2 = sum(x * k for x, k in logs), sum(x * x * k for x, k in logs)
    free = max(1, sum(k for _, k in logs))
    mu = s1 / free
    sigma = max(0.05, math.sqrt(max(0.0, s2 / free - mu * mu)))
    for _ in range(40):
        e1, e2 = s1, s2
        for limit, k in limits.items():
            z = (limit - mu) / sigma
            tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
            h = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            e1 += k * (mu + sigma * h)
            e2 += k * (mu * mu + 2 * mu * sigma * h + sigma * sigma * (1 + z * h))
        mu, old = e1 / n, mu
        sigma = max(0.05, math.sqrt(max(1e-9, e2 / n - mu * mu)))
        if abs(mu - old) < 1e-7:
            break
    return mu, sigma


def censoring_posteriors(counts: dict[int, int]) -> dict[int, float]:
    """Posterior that a row of such a length was cut there, for the candidate limits among a source's lengths.

    A length is a candidate by what the fit expects there, whatever its share of the rows; the fit is made anew with the
    candidates censored until they stay the same.
    """
    n = sum(k for v, k in counts.items() if v > 0)
    candidates: dict[int, float] = {}
    for _ in range(6):
        logs = [(math.log(v), k) for v, k in counts.items() if v > 0 and v not in candidates]
        if not logs:
            return {v: 0.5 for v in candidates}
        mu, sigma = censored_fit(logs, {math.log(v): counts[v] for v in candidates})
        found = {}
        for v, k in counts.items():
            if v > 0 and k >= LIMIT_ROWS:
                z = (math.log(v) - mu) / sigma
                expected = n * math.exp(-z * z / 2) / (v * sigma * math.sqrt(2 * math.pi))
                if k >= LIMIT_EXCESS * expected:
                    found[v] = 1 - (expected + 0.5) / (k + 1)
        if found.keys() == candidates.keys():
            return found
        candidates = found
    return candidates


_MEASURES = ("chars", "bytes", "words")
_ENDING = ("stop", "form", "place", "word")
_LOOK = T.StructType(
    [*(T.StructField(m, T.LongType()) for m in _MEASURES), *(T.StructField(m, T.StringType()) for m in _ENDING)]
    + [T.StructField("text", T.StringType()), T.StructField("residue", residue.LOOK)]
)
_NOTHING = ("plain", "closed", "long paragraph", None)


def _look(html: str | None, site: frozenset[int] | set[int], model: LineModel, passages: residue.PassageModel) -> tuple:
    """One parse of a page for everything that is asked of it here."""
    if not html:
        return 0, 0, 0, *_NOTHING, "", residue.look(parse_page(None), passages)
    page = parse_page(html)
    rest = whole_lines(page), residue.look(page, passages)
    line, appended = article_end(page, site, model)
    if line is None:
        return len(html), len(html.encode("utf-8", "replace")), 0, *_NOTHING, *rest
    body = html[: line.end if appended else len(html)]
    words = sum(len(x.text.split()) for x in page.lines if x.end <= line.end)
    return len(body), len(body.encode("utf-8", "replace")), words, *ending_signs(html, page, line, appended), *rest


def last_words(seen: DataFrame) -> DataFrame:
    """(word, n, ends, begins) of the words that articles stop with: how often each occurs and ends a line in the whole
    lines of all rows, and whether it begins a longer word that occurs twice at least."""
    asked = materialise(seen.select("word").where("word is not null").distinct(), "cut-asked")
    word = lambda p: F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("word")
    each = seen.select(word(_WORDS), F.lit(0).alias("e")).unionByName(seen.select(word(_ENDING_WORDS), F.lit(1).alias("e")))
    counts = each.groupBy("word").agg(F.count_if(F.col("e") == 0).alias("n"), F.sum("e").alias("ends"))
    counts = materialise(counts, "cut-lexicon")
    sizes = [r[0] for r in asked.select(F.length("word")).distinct().collect()]
    longer = F.filter(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"), lambda k: k < F.length("word"))
    starts = counts.where("n >= 2").select("word", F.explode(longer).alias("k")).select(F.expr("substring(word, 1, k)").alias("word")).distinct()
    begins = asked.join(starts, "word", "left_semi").withColumn("begins", F.lit(True))
    return materialise(asked.join(counts, "word", "left").join(begins, "word", "left"), "cut-words")


def _looks(posts: DataFrame) -> DataFrame:
    """seq, blog_id, source, key and what ``_look`` says of every row, written once."""
    spark = posts.sparkSession
    state = LineCounts(spark)
    # single words are no site lines: where many rows are cut, many end with the same first word of a line
    state.apply(line_table(posts, 1).withColumn("lines", F.filter("lines", lambda x: F.contains(x, F.lit(" ")))))
    site = materialise(state.over(SITE_KEYS, 0.0), "site-lines").select("blog_id", "a")
    models = spark.sparkContext.broadcast((boilerplate.fit_model(posts), residue.fit_model(residue.passage_table(posts))))
    rows = spread(posts.select("seq", "blog_id", "source", "key", "html"), "seq")
    if small(site):  # then every worker holds all blogs' lines; else each row brings its own
        known: dict[str, set[int]] = {}
        for r in site.collect():
            known.setdefault(r.blog_id, set()).add(r.a)
        lines = spark.sparkContext.broadcast({k: frozenset(v) for k, v in known.items()})

        @F.pandas_udf(_LOOK)
        def look(htmls: pd.Series, blogs: pd.Series) -> pd.DataFrame:
            of = lines.value
            return pd.DataFrame([_look(h, of.get(b, frozenset()), *models.value) for h, b in zip(htmls, blogs, strict=True)], columns=_LOOK.names)

        looked = look("html", "blog_id")
    else:
        own = each_line(state.rows()).join(site, ["blog_id", "a"], "left_semi").groupBy("seq").agg(F.collect_set("a").alias("_site"))
        rows = rows.join(own, "seq", "left")

        @F.pandas_udf(_LOOK)
        def look(htmls: pd.Series, sites: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_look(h, set(s) if s is not None else set(), *models.value) for h, s in zip(htmls, sites, strict=True)], columns=_LOOK.names)

        looked = look("html", "_site")
    with arrow_batches(spark, BATCH):
        return materialise(rows.select("seq", "blog_id", "source", "key", looked.alias("l")).select("seq", "blog_id", "source", "key", "l.*"), "cut-looks")


def _limits(seen: DataFrame) -> DataFrame:
    """(blog_id, source, measure, value, p): the candidate limits with the posterior that a row there was cut."""
    long = seen.select("blog_id", "source", F.explode(F.create_map(*(x for m in _MEASURES for x in (F.lit(m), F.col(m))))).alias("measure", "value"))
    counts = long.groupBy("blog_id", "source", "measure", "value").agg(F.count("*").alias("n"))

    def limits(group: pd.DataFrame) -> pd.DataFrame:
        counted = {int(v): int(n) for v, n in zip(group["value"], group["n"], strict=True)}
        out = pd.DataFrame(sorted(censoring_posteriors(counted).items()), columns=["value", "p"])
        for c in ("blog_id", "source", "measure"):
            out[c] = group[c].iloc[0]
        return out[["blog_id", "source", "measure", "value", "p"]]

    schema = "blog_id string, source string, measure string, value long, p double"
    return materialise(counts.groupBy("blog_id", "source", "measure").applyInPandas(limits, schema), "cut-limits")


def scored(posts: DataFrame) -> DataFrame:
    """(seq, blog_id, source, key, chars, bytes, words, residue, ending, censoring, odds, cut) of every posts row.

    ``ending`` and ``censoring`` are log odds. Null and empty html, and html without a visible line, is not cut; a null
    blog or source counts as one of its own.
    """
    spark = posts.sparkSession
    seen = _looks(posts)
    found = _limits(seen)
    best = seen.drop("text").join(broadcast_if_small(last_words(seen)), "word", "left").withColumn("use", word_use())
    for m in _MEASURES:
        side = found.where(F.col("measure") == m).select(F.col("blog_id").alias("_b"), F.col("source").alias("_s"), F.col("value").alias("_v"), F.col("p").alias(f"_{m}"))
        on = F.col("blog_id").eqNullSafe(F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col(m) == F.col("_v"))
        best = best.join(broadcast_if_small(side), on, "left").drop("_b", "_s", "_v")
    p = F.greatest(*(F.coalesce(F.col(f"_{m}"), F.lit(0.0)) for m in _MEASURES))
    best = best.withColumn("censoring", F.when(p > 0, F.log(p / (1 - p)) - PRIOR).otherwise(F.lit(0.0)))
    best = materialise(best, "cut-evidence")
    # the signs are few, so their combinations are, whatever the number of rows
    kinds = best.groupBy(*SIGNS, F.round("censoring", 1).alias("length")).agg(F.count("*").alias("n")).collect()
    weights = fit_endings({(tuple(r[s] for s in SIGNS), r.length): r.n for r in kinds})
    table = {tuple(r[s] for s in SIGNS): sum(weights[f] for f in features(tuple(r[s] for s in SIGNS))) for r in kinds}
    known = spark.createDataFrame([(*signs, float(w)) for signs, w in table.items()], ", ".join(f"{s} string" for s in SIGNS) + ", ending double")
    odds = F.lit(weights.get("", PRIOR)) + F.col("censoring") + F.col("ending")
    out = best.join(F.broadcast(known), list(SIGNS)).withColumn("odds", odds).withColumn("cut", odds > 0)
    return out.select("seq", "blog_id", "source", "key", *_MEASURES, "residue", "ending", "censoring", "odds", "cut")


def truncated(posts: DataFrame) -> DataFrame:
    """(seq) of the posts that were cut off; records that are residue (problem 6) as a whole are none."""
    rows = materialise(scored(posts), "cut-scored")
    kinds = residue.judged(rows.select("seq", "blog_id", "key", F.col("residue").alias("l")))
    return rows.where("cut").select("seq").distinct().join(kinds.select("seq").distinct(), "seq", "left_anti")


def truncation_report(posts: DataFrame) -> DataFrame:
    """(blog_id, source, rows, cut, share): how often each blog and source truncates."""
    cut = truncated(posts).withColumn("cut", F.lit(True))
    per = posts.select("seq", "blog_id", "source").join(cut, "seq", "left").groupBy("blog_id", "source").agg(F.count("*").alias("rows"), F.count("cut").alias("cut"))
    return per.withColumn("share", F.round(F.col("cut") / F.col("rows"), 6))
