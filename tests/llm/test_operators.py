"""Small cases of every text operator: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from loomwell.llm import boilerplate, encoding_repair, leakage, markup, packing, repeated_lines, residue, truncation

NAMES = ("_g", "_h", "_n", "_r", "_row", "line", "lines", "repeated", "kind", "field", "text", "tokens", "bin", "bucket", "value", "measure", "chars", "words", "r", "l", "h", "e", "_s", "w")

SENTENCES = [f"The {a} gateway {v} the {b} report before the {c} release." for a in ("narrow", "quiet", "sparse") for v in ("drains", "hides", "splits") for b in ("usage", "quota") for c in ("first", "second")]


def page(i, end=""):
    body = "".join(f"<p>{SENTENCES[(i * 5 + k) % len(SENTENCES)]}</p>\n" for k in range(4))
    nav = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Pricing</a></li></ul></nav>\n' if i % 2 else ""
    foot = "<footer><p>© 2024 Demo. All rights reserved.</p></footer>" if i % 3 == 0 else ""
    return f"{nav}<article>{body}<p>Share this post with your colleagues</p>{end}</article>{foot}"


@pytest.fixture(scope="module")
def posts(make_posts):
    rows = [{"key": f"k{i}", "html": page(i), "excerpt": "plain"} for i in range(40)]
    rows += [{"html": None}, {"html": "", "excerpt": ""}, {"blog_id": None, "key": None, "html": page(1)}, {"html": "<p>" + " ".join(SENTENCES * 80) + "</p>"}, {"html": page(2)}, {"html": page(2)}]
    rows += [{"html": "<p>Page not found</p>"}, {"html": page(3) + "<p>Hello {{ user.name }}, welcome.</p>"}, {"html": "<p>" + "lorem ipsum dolor sit amet " * 6 + "</p>"}]
    return make_posts(rows)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, " ".join(SENTENCES[(i + k) % len(SENTENCES)] for k in range(6)), "en", "demo") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "EN", "demo"), (102, "word " * 40_000, "en", "demo"), (103, rows[0][1], "en", "demo"), (103, rows[0][1], "en", "demo")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def clash(df):
    return df.select("*", *(F.lit("clash").alias(n) for n in NAMES if n not in df.columns))


POST_OPERATORS = {
    "p1": truncation.truncated, "p1_report": truncation.truncation_report, "p2": boilerplate.boilerplate_lines, "p2_text": boilerplate.split_pages,
    "p4": markup.residue, "p4_text": markup.clean_text, "p6": residue.residue_records, "p7": repeated_lines.repeated_lines, "p7_text": repeated_lines.without_repeated_lines,
}


@pytest.mark.parametrize("name", POST_OPERATORS)
def test_posts_operators_take_everything(name, posts):
    run = POST_OPERATORS[name]
    assert run(posts.limit(0)).count() == 0
    plain, more = run(posts), run(clash(posts))
    assert sorted(map(str, plain.collect())) == sorted(map(str, more.collect()))


def test_documents_operators_take_everything(documents, spark):
    items = spark.createDataFrame([(1, " ".join(SENTENCES[:5])), (2, None), (3, "")], "item_id long, text string")
    targets = spark.createDataFrame([(1, 64), (2, 0), (3, None)], "target_id long, capacity_tokens long")
    for run in (encoding_repair.damaged_documents, lambda d: leakage.leaked_items(d, items), lambda d: packing.pack_documents(packing.token_counts(d), targets)):
        assert run(documents.limit(0)).count() == 0
        assert run(documents).count() == run(clash(documents)).count()
    assert leakage.leaked_items(documents, items.limit(0)).count() == 0


def test_truncated(make_posts):
    limit = [{"key": f"c{i}", "html": (page(i) + page(i + 1) + page(i + 2))[:700]} for i in range(12)]
    ends = {
        "cut word": page(1)[:-20] + "<p>The narrow gateway dra", "cut tag": "<p>The quiet gateway hides the report.</p><p>Se <a hre", "ellipsis": "<p>The sparse gateway splits the quota […]</p>",
        "open list": "<p>The quiet gateway hides the report.</p><ul><li>One more</li><li>The next", "no end": "<p>The quiet gateway hides the quota report before the</p>",
    }
    whole = {
        "list": "<p>The quiet gateway hides the report.</p><ul><li>Quiet gateway</li><li>Quota report</li></ul>", "code": "<p>The quiet gateway hides the report:</p><pre>x = 1</pre>",
        "signature": "<p>The quiet gateway hides the report.</p><p>— Ada Byron</p>", "open p": "<P>The quiet gateway hides the report.<P>The sparse gateway splits the usage report.",
        "table": "<p>The quiet gateway hides the report.</p><table><tr><td>12 %</td></tr></table>", "error page": "<p>Page not found</p>",
    }
    rows = [{"key": f"k{i}", "html": page(i)} for i in range(40)] + limit
    n = len(rows)
    rows += [{"html": h} for h in (*ends.values(), *whole.values())]
    got = {r.seq - n for r in truncation.truncated(make_posts(rows)).collect() if r.seq >= n}
    names = [*ends, *whole]
    assert {names[i] for i in got} ^ set(ends) == set()


def test_censored_lengths():
    counts = {k: 1 for k in range(300, 900, 5)} | {640: 60}
    assert set(truncation.censoring_posteriors(counts)) == {640}
    assert truncation.censoring_posteriors(counts)[640] > 0.9
    assert truncation.censoring_posteriors({k: 1 for k in range(300, 900)}) == {} and truncation.censoring_posteriors({}) == {}


def test_minimum_cut_equals_brute_force():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 6)
        a, b = ([rng.randint(0, 5) for _ in range(n)] for _ in "ab")
        edges = [(i, j, rng.randint(0, 4)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda s: sum(b[i] if s[i] else a[i] for i in range(n)) + sum(w for i, j, w in edges if s[i] != s[j])  # noqa: B023, E731
        side = boilerplate.max_flow_side(n, list(map(float, a)), list(map(float, b)), edges)
        assert cost(side) == min(cost(s) for s in itertools.product((True, False), repeat=n))


def test_page_parts(posts):
    got = {}
    for r in boilerplate.boilerplate_lines(posts).collect():
        got.setdefault(r.seq, set()).add(r.line)
    assert {"home", "pricing"} <= got[1] and "© 0 demo. all rights reserved." in got[0]
    assert not any("share this post" in x or "gateway" in x for lines in got.values() for x in lines)


@pytest.mark.parametrize(
    ("html", "kinds"),
    [
        ("<p>plain 5 * 6 text, 7 * 8, costs $5 or $6, A_1 and B_2 like C#</p>", []), ("<p>a **bold** word</p>", ["markdown"]), ("<p>see [x](https://e.example)</p>", ["markdown"]), ("## Head\n\ntext", ["markdown"]),
        ("<p>a '''bold''' [[link|word]]</p>", ["wiki"]), ("== Head ==\n\n# one\n# two", ["wiki"]), ("<p>\\emph{x} \\cite{y}</p>", ["latex"]), ("<p>so $\\alpha_{3}$ is</p>", ["latex"]),
        ("&lt;p&gt;shown&lt;/p&gt;", ["html"]), ("<pre># x\n**y** \\emph{z}</pre><p>t <code>[a](/b)</code></p>", []), ("\\begin{verbatim}\n**x**\n\\end{verbatim}", []),
        ("<p>Hello {{ user.name }} ${x} &lt;DATE&gt;</p>", []), (None, []), ("", []),
    ],
)
def test_markup(html, kinds):
    assert markup.html_residue(html) == kinds


def test_excerpts_and_structure():
    assert markup.excerpt_residue("a &nbsp; b") == ["html"] and markup.excerpt_residue("a <em>b</em>") == ["html"] and markup.excerpt_residue("a & b […]") == [] and markup.excerpt_residue("> q") == ["markdown"]
    got = markup.structured("## Head\n\nsome **bold** [text](https://e.example)\n- one\n- two\n\n```\nx = [1](2)\n```\n\n$$a^2$$\n<h3>H</h3><ul><li>i</li></ul><pre>c\n  d</pre>")
    assert got == [("heading", 2, "Head"), ("paragraph", 0, "some bold text"), ("item", 1, "one"), ("item", 1, "two"), ("code", 0, "x = [1](2)"), ("formula", 0, "$$a^2$$"), ("heading", 3, "H"), ("item", 1, "i"), ("code", 0, "c\n  d")]


def test_residue(posts):
    found = {r.seq: r.kind for r in residue.residue_records(posts).collect()}
    assert found == {46: "error", 47: "placeholder", 48: "filler"}


def test_repeated_lines_equal_brute_force(posts):
    from loomwell.functions.htmllines import html_lines

    rows = posts.select("seq", "blog_id", "key", "html").collect()
    keys, of = {}, {}
    for r in rows:
        if r.blog_id and r.key:
            keys.setdefault(r.blog_id, set()).add(r.key)
            for x in set(html_lines(r.html)):
                if len(x) >= 12:
                    of.setdefault((r.blog_id, x), set()).add(r.key)
    hot = {k for k, v in of.items() if len(v) >= 3 and len(v) > 0.1 * len(keys[k[0]])}
    want = {(r.seq, x) for r in rows if r.blog_id and r.key for x in html_lines(r.html) if (r.blog_id, x) in hot}
    assert {tuple(r) for r in repeated_lines.repeated_lines(posts).collect()} == want


def test_line_counts_by_deltas(spark, make_posts, tmp_path):
    rows = [{"key": f"k{i % 12}", "html": f"<p>a line said by many {'again' if i % 2 else ''}</p><p>only number {'x' * i} here</p>"} for i in range(24)]
    table = repeated_lines.line_table(make_posts(rows))
    whole = repeated_lines.LineCounts(spark, str(tmp_path / "whole"))
    whole.apply(table)
    crossings = []
    for a, b in ((0, 1), (2, 5), (6, 23), (0, 23)):
        parts = repeated_lines.LineCounts(spark, str(tmp_path / "parts"))  # each delta reopens the state
        table.limit(3).write.parquet(f"{parts.log.stage()}/rows")  # and finds a delta that died before its commit
        crossings.append(parts.apply(table.where(F.col("seq").between(a, b))))
    assert sorted(map(tuple, parts.counts().collect())) == sorted(map(tuple, whole.counts().collect()))
    assert [up.count() for up, _ in crossings] == [0, 2, 0, 0]  # each wording is in three keys from the sixth row on
    assert repeated_lines.to_rebuild(table, crossings[1][0]).count() == 24


def test_only_touched_posts_are_rebuilt(spark, make_posts):
    old = [{"key": f"k{i}", "html": f"<p>said on every page here</p><p>own words {'y' * i}</p>" + ("<p>soon to be a habit</p>" if i < 2 else "")} for i in range(9)]
    new = [{"key": f"n{i}", "html": "<p>soon to be a habit</p><p>said on every page here</p>", "fetched_at": "2026-02-02T00:00:00Z"} for i in range(2)]
    got = {r.seq: (r.text, r.removed) for r in repeated_lines.without_repeated_lines(make_posts(old + new)).collect()}
    assert got == {i: (f"own words {'y' * i}".strip(), 2 if i < 2 else 1) for i in range(9)} | {9: ("", 2), 10: ("", 2)}


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 120)
    sizes = [(i, (i * 37) % 90 + 1) for i in range(300)] + [(900, 250), (901, None), (902, 100), (1, 38)]
    docs = spark.createDataFrame(sizes, "doc_id long, tokens long")
    targets = spark.createDataFrame([(1, 100), (2, 1000)], "target_id long, capacity_tokens long")
    got = packing.pack_documents(docs, targets).toPandas()
    for t, cap in ((1, 100), (2, 1000)):
        mine = got[got.target_id == t]
        assert mine.groupby("container_id").tokens.sum().max() <= cap
        assert mine.tokens.sum() == sum(s or 0 for _, s in sizes)
        pieces = [min(cap, (s or 0) - k * cap) for _, s in sizes for k in range(max(1, -(-(s or 0) // cap)))]
        assert mine.container_id.nunique() <= 1.05 * len(set(packing.best_fit(pieces, cap))) + 1
    assert sorted(got[(got.target_id == 1) & (got.doc_id == 900)].tokens) == [50, 100, 100]
    assert got[got.target_id == 2].doc_id.value_counts().max() == 2 and (got.doc_id == 901).sum() == 2


def test_packing_what_nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 50)
    monkeypatch.setattr(packing, "TARGETS_AT_ONCE", 1)
    seen = []
    plain = packing._pack
    docs = spark.createDataFrame([(i, 55) for i in range(2000)] + [(3000, 1), (3001, 44)], "doc_id long, tokens long")
    targets = spark.createDataFrame([(1, 100), (2, 120), (3, 50)], "target_id long, capacity_tokens long")

    def watched(number):
        seen.append(number)
        return plain(number)

    monkeypatch.setattr(packing, "_pack", watched)
    got = packing.pack_documents(docs, targets).toPandas()
    per = got.groupby(["target_id", "container_id"]).tokens.sum().reset_index()
    assert (per.tokens <= per.target_id.map({1: 100, 2: 120, 3: 50})).all()
    assert got.groupby("target_id").tokens.sum().tolist() == [2000 * 55 + 45] * 3
    assert per.groupby("target_id").container_id.nunique().tolist()[:2] == [2000, 1001]
    assert len(seen) <= 3 * 8


def test_tokens_and_best_fit():
    assert packing.count_tokens(None) == packing.count_tokens("") == 0 and packing.count_tokens("a text of words") == 4
    bins = packing.best_fit([5, 5, 4, 3, 3], 10)
    assert len(set(bins)) == 2


def test_leaks_against_brute_force(spark):
    passage = " ".join(f"name{i} counted {i * 7} of the {i * 3} files" for i in range(12))
    item = f"Read the passage and answer. {passage} Which one?"
    words = item.split()
    n = len(words)
    docs = {
        1: passage.upper().replace(" ", "\n"), 2: "before " + " ".join(words[10 : 10 + int(n * 0.45)]) + " after", 3: " ".join(words[5 : 5 + n // 4]) + " other words between here " + " ".join(words[40 : 40 + n // 4]),
        4: "Read the passage and answer. Which one?", 5: " ".join(words[10:30]), 6: " ".join(w if i % 12 else "changed" for i, w in enumerate(words)), 7: "nothing of it at all in here, only other words", 8: "",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    i = spark.createDataFrame([(1, item), (2, "Read the passage and answer. Some other text that stands nowhere. Which one?")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_items(d, i).collect()} == {(1, 1), (2, 1), (3, 1), (6, 1)}


def test_hamming_index_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    stored = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    queries = stored[:80].copy()
    for k in range(80):
        for b in rng.choice(64, k % 6, replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(b)
    q, p = leakage.HammingIndex(stored, 3).search(queries)
    want = {(i, j) for i in range(80) for j in range(300) if bin(int(queries[i] ^ stored[j])).count("1") <= 3}
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == want


TEXTS = ["Die gültigen Prüfberichte überschreiben die nächtlichen Zähler hinter dem Proxy.", "Müssen die Freigaben wirklich für jeden Mandanten die größten Hürden löschen?", "Nach drei Wochen zählen die Prüferinnen alle übersichtlichen Größenangaben – das überrascht."]
RUSSIAN = ["Частичные службы задерживают запросы без перезапуска.", "Зачем очереди объединяют устаревшие пути во время паузы?", "Через два дня операторы скрывают все строгие отчёты."]


@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "cp437", "mac_roman"])
def test_encodings_round_trip(charset):
    d = encoding_repair.Describer({"de": "\n".join(TEXTS * 3).encode(), "ru": "\n".join(RUSSIAN * 3).encode()}, "".join({c for t in TEXTS + RUSSIAN for c in t if ord(c) > 127}))
    for t in TEXTS:
        try:
            bad = t.encode().decode(charset)
        except UnicodeDecodeError:
            continue
        assert encoding_repair.repair_text(bad, d)[0] == t
        assert encoding_repair.repair_text(t, d) == (t, None, False)
        twice = bad.encode().decode("latin-1")
        assert encoding_repair.repair_text(twice, d)[0] == t
    for t in RUSSIAN:
        assert encoding_repair.repair_text(t.encode("cp1251").decode("latin-1"), d)[0] == t
    quoted = "Read wrongly, an “é” turns into “Ã©” and “�” is shown."
    assert encoding_repair.repair_text(quoted, d) == (quoted, None, False)
    assert encoding_repair.repair_text("Pr�fberichte", d)[2] is True
    assert encoding_repair.repair_text(None, d) == (None, None, False)


def test_damaged_words_in_long_lines():
    """Lines that compress well, or are clean but for a few words, are read anew all the same."""
    d = encoding_repair.Describer({"de": "\n".join(TEXTS * 3).encode(), "ru": "\n".join(RUSSIAN * 3).encode()}, "".join({c for t in TEXTS + RUSSIAN for c in t if ord(c) > 127}))
    line = " ".join(RUSSIAN * 3)
    part = RUSSIAN[1]
    for meant, read in (("cp1251", "latin-1"), ("koi8_r", "cp1251")):
        bad = part.encode(meant).decode(read)
        assert encoding_repair.repair_text(" ".join(x.encode(meant).decode(read) for x in RUSSIAN * 3), d)[0] == line
        assert encoding_repair.repair_text(line.replace(part, bad, 1), d)[0] == line
    assert encoding_repair.repair_text(line, d) == (line, None, False)


def test_words_are_counted_in_all_rows(make_posts):
    words = ["stem" + "".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(320)]
    rows = [{"key": f"k{i}", "html": f"<p>The {w} gateway, a {w} report and a {w} quota.</p><p>Some {w} notes on it.</p><h3>Notes about {w}</h3>"} for i, w in enumerate(words)]
    assert len({r.ending for r in truncation.scored(make_posts(rows)).collect()}) == 1


def test_limits_of_every_measure(make_posts):
    import random

    rng = random.Random(1)
    text = lambda n: " ".join("x" * rng.randint(2, 12) for _ in range(n))
    free = [text(rng.randint(40, 400)) for _ in range(200)]
    chars = [text(400)[:690].rstrip().ljust(690, "y") for _ in range(30)]
    words = [text(150) for _ in range(20)]
    got = {r.seq: r.censoring for r in truncation.scored(make_posts([{"html": f"<p>{t}</p>"} for t in free + chars + words])).collect()}
    assert all(got[i] > 0 for i in range(200, 250))


def test_residue_that_every_post_repeats(make_posts):
    """A missing value in all posts of a blog is a case in each, however often the passage is found."""
    body = lambda i: "".join(f"<p>{SENTENCES[(i * 5 + k) % len(SENTENCES)]}</p>" for k in range(12))
    rows = [{"key": f"t{i}", "blog_id": "other", "html": body(i) + "<p>Posted by undefined, undefined</p>"} for i in range(30)]
    rows += [{"key": f"r{i}", "html": body(i) + "<p>Posted by undefined</p>"} for i in range(20)] + [{"key": f"c{i}", "html": body(i)} for i in range(60)]
    got = {r.seq: r.kind for r in residue.residue_records(make_posts(rows)).collect()}
    assert got == {i: "placeholder" for i in range(50)}


def test_words_at_the_end_of_a_long_line_tell_its_place():
    from loomwell.functions.htmlblocks import parse_page

    notice = "cookies privacy consent unsubscribe"
    pages = [parse_page(f"<article><p>{SENTENCES[i % 36]} {SENTENCES[(i + 7) % 36]}</p></article><footer><p>{SENTENCES[i % 36]} {SENTENCES[(i + 7) % 36][:-1]} {notice}.</p></footer>").lines for i in range(40)]
    model = boilerplate.LineModel.fit(pages)
    plain, told = (parse_page(f"<p>{SENTENCES[3]} {SENTENCES[11][:-1]}{end}.</p>").lines for end in ("", f" {notice}"))
    assert model.odds(boilerplate.line_features(told)[0]) > model.odds(boilerplate.line_features(plain)[0]) + 1


@pytest.mark.parametrize("spacing", range(4, 10))
def test_leaks_with_changed_words(spacing):
    items = [(k, " ".join(f"w{k}x{j}" if j % 3 else "the" for j in range(70))) for k in range(5)] + [(90, "Yes"), (91, "no answer"), (92, "")]
    index = leakage.ItemIndex(items)
    for off in range(spacing):
        said = [f"other{j}" if j % spacing == off else w for j, w in enumerate(items[2][1].split())]
        text = " ".join(SENTENCES[:3]) + " " + " ".join(said[10:30]) + " " + SENTENCES[4] + " " + " ".join(said[45:65]) + " end"
        assert index.leaks([text, SENTENCES[0], "yes", None, ""]) == [[2], [], [90], [], []]


def test_windows_find_all_fingerprints_within_a_radius():
    import numpy as np

    made = np.random.default_rng(1)
    stored, queries = made.integers(0, 1 << 63, 400, dtype=np.uint64), made.integers(0, 1 << 63, 300, dtype=np.uint64)
    queries[:200] = stored[:200]
    for k in range(200):
        queries[k] ^= np.uint64(sum(1 << int(b) for b in made.choice(64, k % 5, replace=False)))
    for radius in (0, 3):
        q, p = leakage.HammingIndex(stored, radius).search(queries)
        assert set(zip(q.tolist(), p.tolist(), strict=True)) == {(i, j) for i in range(300) for j in range(400) if int(queries[i] ^ stored[j]).bit_count() <= radius}
    h = leakage.WordHashes()("a b c d e f g h".split())
    wide = (((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int))
    assert leakage.simhashes(h, 3).tolist() == [sum(1 << b for b in range(64) if wide[i : i + 3, b].sum() >= 2) for i in range(6)]


def test_damage_of_a_few_letters_and_of_references(spark):
    russian = "Наши редакторы проверили отчёт перед выпуском и сохранили старую версию правил для партнёров на случай отката"
    german = "Die Übersichten für größere Änderungen bündeln stille Prüfberichte, und Partner ändern müde Verträge häufiger"
    d = encoding_repair.Describer({"ru": (russian * 20).encode(), "de": (german * 20).encode()}, "".join(sorted({c for c in russian + german if ord(c) > 127})))
    hurt = "Für die Partner bleibt der Bericht vor der Umstellung offen, und häufiger"
    assert encoding_repair.repair_text(hurt.replace("ü", "Ã¼").replace("ä", "Ã¤"), d)[0] == hurt
    written = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in hurt.encode().decode("cp1252"))
    assert encoding_repair.repair_text(written, d)[:2] == (hurt, "references, cp1252>utf-8")
    right = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in hurt)
    assert encoding_repair.repair_text(right, d) == (right, None, False)
    told = "The page shows \u201c&#195;&#169;\u201d instead of the letter"
    assert encoding_repair.repair_text(told, d)[1] is None
    deep = hurt
    for _ in range(5):
        deep = deep.encode().decode("latin-1")
    assert encoding_repair.repair_text(deep, d)[0] == hurt


def test_sparse_suffix_array_finds_every_shared_string():
    import random

    from loomwell.functions.htmlblocks import parse_page
    from loomwell.llm import suffixes

    made = random.Random(4)
    least = suffixes.DEPTH + suffixes.WINDOW - 1
    text = lambda n: [f"w{made.randrange(10**6)}" for _ in range(n)]
    for _ in range(40):
        common = text(least)
        a, b = text(made.randrange(60)) + common + text(made.randrange(60)), text(made.randrange(60)) + common + text(made.randrange(60))
        pa, pb = (parse_page(f"<p>{' '.join(x)}</p>") for x in (a, b))
        assert set(suffixes.suffixes(suffixes.page_tokens(pa)[0])[0].tolist()) & set(suffixes.suffixes(suffixes.page_tokens(pb)[0])[0].tolist())
    line = " ".join(text(40))
    page = parse_page(f"<p>{line}</p><p>own words here</p><pre>{line}</pre>")
    shared = set(suffixes.suffixes(suffixes.page_tokens(parse_page(f"<p>{line}</p>"))[0])[0].tolist())
    tokens, lines = suffixes.page_tokens(page)
    assert len(tokens) == 43 and suffixes.covered_lines(page, set()) == set()
    assert suffixes.covered_lines(parse_page(f"<p>{line}</p>"), shared) == set()  # a copy as a whole is no boilerplate


def test_shared_markup_is_left_out(make_posts):
    filler = " ".join(f"narrow{k}" for k in range(30))
    note = f"See **this** {filler} and [that](https://e.example/x) {filler}"
    rows = [{"key": f"k{i}", "html": f"<p>own text {' '.join(f'x{i}y{j}' for j in range(30))}</p><p>{filler}</p><p>{note}</p><p>{filler} {filler}</p>" + ("<p>really **bold** here</p>" if i == 2 else "")} for i in range(4)]
    rows += [{"key": "lone", "html": "<p>lone **bold** text</p>"}, {"key": "**" * 400, "html": "<p>**" + "very " * 200 + "long**</p>"}]
    got = {tuple(r) for r in markup.residue(make_posts(rows)).collect()}
    assert got == {(s, "html", "markdown") for s in (2, 4, 5)}
    text = markup.clean_text(make_posts(rows)).where("seq < 4").collect()
    assert text and not any("See" in r.text for r in text)


def test_site_lines_reach_the_pages_either_way(posts, monkeypatch):
    """Known to every worker, or brought by each row where they are too many: the same rows come out."""
    told = lambda: sorted((r.seq, r.chars, r.ending, r.cut) for r in truncation.scored(posts).collect())
    first = told()
    monkeypatch.setattr(truncation, "small", lambda df: False)
    assert told() == first
    kinds = lambda: sorted(map(tuple, markup.residue(posts).collect()))
    before = kinds()
    monkeypatch.setattr(markup, "small", lambda df: False)
    assert kinds() == before


@pytest.mark.parametrize("times", [1, 40])
def test_error_pages_of_larger_tables(spark, times):
    """Posts that hold an error message speak against it by how many pages say nothing else, not by their number alone."""
    look = lambda name, content: (content, 30.0, [name], ["error"], [12.0], [8], [False])
    rows = [("own", 9, look("notice", 0)), ("own", 3, look("notice", 500)), ("site", 2, look("line", 5)), ("site", 20, look("line", 500))]
    rows = [(b, v) for b, n, v in rows for _ in range(n * times)]
    seen = spark.createDataFrame([(i, b, f"k{i}", v) for i, (b, v) in enumerate(rows)], f"seq long, blog_id string, key string, l {residue.LOOK.simpleString()}")
    assert residue.judged(seen).select("seq").distinct().count() == 9 * times


def test_passages_of_all_records_are_learned_from(make_posts):
    """More short records than any sample held: each brings a word of its own, and each is counted."""
    words = ["stem" + "".join("abcdefghij"[int(c)] for c in f"{i:04d}") for i in range(2100)]
    posts = make_posts([{"html": f"<p>The {w} gateway</p>"} for w in words] + [{"html": None}, {"html": ""}])
    assert set(words) <= residue.fit_model(residue.passage_table(posts)).weights.keys()


def test_counts_are_handed_on_when_a_task_holds_many(spark, monkeypatch):
    from loomwell.llm import common

    monkeypatch.setattr(common, "HELD", 3)
    got = common.added_up(spark.range(40), lambda rows: ((f"n{i % 7}", [1.0, float(i)]) for (i,) in rows), 2).collect()
    assert {r.name: list(r.counts) for r in got} == {f"n{k}": [len(range(k, 40, 7)), sum(range(k, 40, 7))] for k in range(7)}


def test_code_beside_content_is_no_error_message():
    from loomwell.functions.htmlblocks import parse_page

    model = residue.PassageModel([-0.1, -3.0, -6.0, -6.0], {"trace": [-9.0, -1.0, -9.0, -9.0], "gateway": [-1.0, -9.0, -9.0, -9.0], "access": [-9.0, -1.0, -9.0, -9.0], "denied": [-9.0, -1.0, -9.0, -9.0]})
    kinds = lambda html: residue.look(parse_page(html), model)[3]
    plain = "<p>gateway gateway the gateway of a gateway</p>"
    assert kinds(f"{plain}<pre>trace trace trace</pre>") == [] and kinds("<pre>trace trace trace</pre>") == ["error"]
    assert kinds(f"{plain}<pre>Access denied</pre>") == ["error"] and kinds(f"{plain}<p>trace trace trace</p>") == ["error"]


def test_lines_of_all_pages_are_learned_from(make_posts):
    """More pages of a kind than any sample held: each brings a word of its own, and each is counted."""
    words = ["stem" + "".join("abcdefghij"[int(c)] for c in f"{i:04d}") for i in range(2100)]
    posts = make_posts([{"html": f"<p>The {w} gateway</p>"} for w in words] + [{"html": None}, {"html": ""}])
    assert set(words) <= boilerplate.fit_model(posts).weights.keys()


def test_line_model_of_larger_tables(make_posts, monkeypatch):
    """The same pages many times over make the same model, in whatever batches their lines are counted."""
    monkeypatch.setattr(boilerplate, "KIND_PAGES", 10)
    rows = [{"html": page(i)} for i in range(12)] + [{"html": f"<p>{SENTENCES[i]}</p>"} for i in range(30)] + [{"html": f"<nav><p>Menu {i}</p></nav><p>{SENTENCES[i]}</p>"} for i in range(15)]
    once = boilerplate.fit_model(make_posts(rows))
    monkeypatch.setattr(boilerplate, "HELD_LINES", 5)
    more = boilerplate.fit_model(make_posts(rows * 7))
    assert more.prior == pytest.approx(once.prior) and more.weights.keys() == once.weights.keys()
    assert all(more.weights[f] == pytest.approx(w) for f, w in once.weights.items())


def test_shared_strings_are_covered_at_every_position(make_posts):
    """Exactly the tokens of strings that pages share are covered, to their ends, as brute force has it."""
    import random

    from loomwell.functions.htmlblocks import parse_page
    from loomwell.llm import suffixes

    made = random.Random(7)
    text = lambda n: " ".join(f"w{made.randrange(10**6)}" for _ in range(n))
    for _ in range(40):
        common = [text(made.randrange(3, 40)) for _ in range(made.randrange(1, 4))]
        a, b = (parse_page("".join(f"<p>{x}</p>" for x in [text(made.randrange(1, 40)), *common, text(9)])) for _ in "ab")
        shared = set.intersection(*(set(suffixes.suffixes(suffixes.page_tokens(p)[0])[0].tolist()) for p in (a, b)))
        both = set.intersection(*(set(suffixes.strings(suffixes.page_tokens(p)[0], shared).tolist()) for p in (a, b)))
        whole = len(" ".join(common).split()) >= suffixes.LEAST
        assert suffixes.covered_lines(a, both) == (set(range(1, 1 + len(common))) if whole else set())
    rows = [{"key": f"k{i}{j}", "html": f"<p>{text(30)}</p><p>{line}</p><p>{text(5)}</p>"} for i, line in enumerate(f"**{text(2)}** {text(24)} **{text(2)}**" for _ in range(10)) for j in range(2)]
    assert markup.residue(make_posts([*rows, {"key": "own", "html": "<p>really **bold** here</p>"}])).select("seq").collect() == [(20,)]


@pytest.mark.parametrize("size", [32_000_000, 20_000])
def test_dictionaries_of_all_documents(spark, monkeypatch, size):
    """More documents than any sample held: the letter pairs are those of all, and so are the dictionaries, in parts or not."""
    monkeypatch.setattr(encoding_repair, "PART_CHARS", size)
    texts = [f"{TEXTS[i % 3]} Bericht{i} für {TEXTS[(i + 1) % 3]}" for i in range(900)]
    rows = [(i, t, "de") for i, t in enumerate(texts)] + [(900, "Ein müder Čert schläft.", "de"), (901, "müde".encode().decode("cp1252") + " Wörter", "de"), (902, None, "de"), (903, TEXTS[0], None), (904, "Prüfung", "fr")]
    found, alphabet, pairs = encoding_repair.train_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert pairs["de"] == encoding_repair.LetterPairs.count(" ".join(texts))
    assert set(found) == {"de"} and "nächtlichen".encode() in found["de"] and set(alphabet) == {c for t in texts for c in t if ord(c) > 127}
    assert encoding_repair.train_dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == ({}, "", {})
