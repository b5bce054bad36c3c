from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomwell.functions import dates, text
from loomwell.operators import covers, links, selection, sync


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Example.com/a/b/?utm_source=x&q=1#f", "//example.com/a/b?q=1"),
        (" http://example.com ", "//example.com/"),
        ("https://example.com/a b:z/", "//example.com/a b:z"),
        ("/only/path?REF=1", "///only/path"),
    ],
)
def test_normalize_url(spark, url, want):
    got = one(spark, text.normalize_url(F.lit(url)))
    assert got == want
    assert one(spark, text.normalize_url(F.lit(got))) == got


@pytest.mark.parametrize(
    ("title", "headline", "want"),
    [
        ("A story | Example", None, "A story"),
        ("Pipes | and filters", None, "Pipes | and filters"),
        ("A longer headline - Some Brand", "A longer headline", "A longer headline"),
        ("Short - Brand", "Short", "Short - Brand"),
        ("Example", None, "Example"),
    ],
)
def test_title_suffix(spark, title, headline, want):
    url = F.lit("https://blog.example.com/x")
    assert one(spark, text.strip_site_suffix(F.lit(title), url, F.lit(headline).cast("string"))) == want


def test_small_expressions(spark):
    assert one(spark, text.slug(F.lit("Für Ärger & Co!"))) == "für-ärger---co"
    assert one(spark, text.slug(F.lit("!!"))) == "x"
    assert one(spark, text.excerpt_of(F.lit("Kept […]"), F.lit("body"))) == "Kept"
    assert len(one(spark, text.excerpt_of(F.lit(None).cast("string"), F.lit("word " * 100)))) <= 221
    assert one(spark, text.quote_attribute(F.lit('a"b'))) == "'a\"b'"
    assert [one(spark, text.parse_size(F.lit(x))) for x in ("250", "2.5m", "1 GB", "0", "-1", "big")] == [250, 2_500_000, 10**9, None, None, None]
    assert one(spark, text.kicker(F.lit("An OAuth story"), F.array(F.lit("Uncategorized")))) == "SECURITY"
    assert one(spark, links.same_image(F.lit("x/a-300x200.png?v=1"), F.lit("x/a.png"))) is True
    assert one(spark, text.media_type(F.lit(b"<!DOCTYPE html><p>"), F.lit("image/png"), F.lit("u/a.png"))) is None
    assert one(spark, dates.month_label(F.lit("2024-03-05T00:00:00+05:00"))) == "March 2024"
    assert one(spark, dates.local_year(F.lit("2024-01-01T00:30:00+05:00"))) == "2024"
    assert one(spark, dates.gmt(F.lit("2024-01-01T00:00:00"))) == "2024-01-01T00:00:00+00:00"


def test_resolve_date():
    now = datetime(2026, 9, 5, 12, tzinfo=UTC)
    assert [(now - dates.resolve_date(v, now)).days for v in ("7d", "2w", "3m", "1y", " 10D ")] == [7, 14, 90, 365, 10]
    assert dates.resolve_date("2024-01-02", now) == datetime(2024, 1, 2, tzinfo=UTC)
    assert [dates.resolve_date(v, now) for v in (None, "", "soon")] == [None, None, None]


def test_undated_rows_and_ties(spark):
    rows = spark.createDataFrame([("b", 1, None, "x"), ("b", 2, "2024-01-01", "x"), ("b", 3, "2024-01-01", "x"), ("b", 4, "2023-01-01", None)], "blog string, key int, d string, title string").withColumn("ts", F.col("d").cast("timestamp"))
    order = lambda **k: [r.key for r in selection.select_posts(rows, "blog", "ts", "title", "key", **k).orderBy("idx").collect()]
    assert order() == [2, 3, 4, 1]
    assert order(newest_first=False) == [1, 4, 2, 3]
    assert order(most=1) == [2]
    assert rows.where(dates.within("ts", F.lit("2023-06-01").cast("timestamp"), None)).count() == 3


@pytest.mark.parametrize(("weights", "budget", "want"), [((300, 300, 300, 300), 731, [1, 1, 2, 2]), ((50, 900, 50), 731, [1, 2, 3]), ((10, 10), 731, [1, 1]), ((None, 5), 731, [1, 1])])
def test_packing(spark, weights, budget, want):
    rows = spark.createDataFrame([("b", i, w) for i, w in enumerate(weights, 1)], "blog string, idx int, w int")
    got = selection.pack_in_order(rows, ["blog"], "idx", "w", budget).orderBy("idx").collect()
    assert [r.bin for r in got] == want
    assert selection.pack_in_order(rows.limit(0), ["blog"], "idx", "w", budget).count() == 0


def test_shared_assets_weigh_once_a_bin(spark):
    rows = spark.createDataFrame([("b", 1, 100), ("b", 2, 100), ("b", 3, 300)], "blog string, idx int, w int")
    assets = spark.createDataFrame([("b", 1, "s", 400), ("b", 2, "s", 400), ("b", 2, "s", 400), ("b", 3, "s", 400)], "blog string, idx int, a string, size int")
    got = selection.pack_with_shared(rows, ["blog"], "idx", "w", assets, "a", "size", 731).orderBy("idx").collect()
    assert [r.bin for r in got] == [1, 1, 2]


def test_change_sequence(spark):
    listing = lambda rows: spark.createDataFrame(rows, "key int, modified string")
    cache = listing([(1, "a"), (2, "a")])
    status = sync.needs_fetch(listing([(1, "a"), (2, "b"), (3, "a"), (4, None)]), cache, ["key"])
    assert {r.key: r.status for r in status.collect()} == {1: "same", 2: "changed", 3: "new", 4: "new"}
    assert [r.key for r in sync.vanished(listing([(2, "b")]), cache, ["key"]).collect()] == [1]
    merged = sync.upsert(cache, listing([(2, "b")]), ["key"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a"), (2, "b")}
    counted = sync.counters(status.withColumn("s", F.lit("x")), cache.withColumn("s", F.lit("x")), "s", prune=True).first()
    assert (counted.new, counted.changed, counted.same, counted.removed, counted.stale) == (2, 1, 1, 2, 0)


def test_latest_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, "2024", None), (1, "2023", "x"), (2, None, "y")], "k int, at string, v string")
    assert {tuple(r) for r in sync.latest(rows, ["k"], "at").collect()} == {(1, "2024", None), (2, None, "y")}


def test_bleeding_titles_equals_containment(spark):
    titles = [(1, "How the narrow gateway works for teams"), (2, "abcdefghijklmnopqrstuvwxyz-abcdefghij"), (3, "short"), (4, None), (5, "abcdefghijklmnopqrstuvwxyz one-more")]
    bodies = [(9, "x How the narrow gateway works for teams y"), (8, "zzabcdefghijklmnopqrstuvwxyz-abcdefghijzz"), (7, None), (6, "How the narrow gateway works"), (1, "How the narrow gateway works for teams"), (5, "q abcdefghijklmnopqrstuvwxyz one-more")]
    t = spark.createDataFrame([("b", *x) for x in titles], "by string, id int, title string")
    b = spark.createDataFrame([("b", *x) for x in bodies], "by string, id int, text string")
    want = {(i, j) for i, x in bodies for j, y in titles if x and y and len(y) > 25 and i != j and y in x}
    assert {(r.id, r.other) for r in links.bleeding_titles(b, t, "by").collect()} == want


def test_fragments_and_cover_lines(spark):
    hrefs = spark.createDataFrame([("a", "b", "x"), ("a", "b", "nope")], "file string, target string, fragment string")
    ids = spark.createDataFrame([("b", "x")], "file string, id string")
    assert sorted((r.fragment or "") for r in links.fix_fragments(hrefs, ids).collect()) == ["", "x"]
    rows = spark.createDataFrame([("b", 1, "2024-01-01", "K", "one"), ("b", 2, "2024-02-01", "K", "two"), ("b", 3, None, "L", "t" * 90)], "by string, id int, d string, k string, title string").withColumn("ts", F.col("d").cast("timestamp"))
    got = covers.cover_lines(rows, "by", "ts", "title", "k", "id", 4).orderBy("line").collect()
    assert [(r.kicker, r.title[:3]) for r in got] == [("K", "two"), ("FEATURE", "one"), ("", ""), ("", "")]


def test_reports(spark):
    from loomwell.operators import reports

    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    css = "a: light-dark(rgb(1, 2, 3), #000); b: var(--y, #fff)"
    assert x(reports.plain_colours(F.lit(css))) == "a: rgb(1, 2, 3); b: #fff"
    assert [x(reports.svg_policy(F.lit("image/svg+xml"), F.lit("a.svg"), p)) for p in ("keep", "raster", "drop")] == ["a.svg", "a.png", None]
    with pytest.raises(ValueError):
        reports.svg_policy(F.lit(""), F.lit(""), "melt")
    assert [x(text.fixed(F.lit(v), 1)) for v in (9.45, 0.25, 2.0)] == ["9.4", "0.2", "2.0"]
    assert "A &amp; B" in reports.drawn_cover("A & B", "sub", "me") and reports.fill_template("$a $b", {"a": "1"}) == "1 $b"
    assert reports.suggested_include("https://e.example/blog", {2: 5, 1: 1}) == r"^https://e\.example/blog/[^/]+" and reports.suggested_id("https://www.e.example/") == "e"
    files = spark.createDataFrame([("a", "A", "a.epub", "2024", 2, "2024", 2_000_000), ("b", None, "b.epub", None, None, None, 2_000_000_000)], "book string, title string, name string, label string, posts int, span string, bytes long")
    notes = reports.release_notes(reports.release_sections(files, "book"), "book", ["a", "c"], "20260101")
    assert "### A — `a`\n\n`a.epub`: 2 posts, 2024, 2.0 MB.\n" in notes and "2 books, 2 files, 2.00 GB." in notes and "Kept from an earlier run" in notes and "- `c`" in notes and "2.00 GB" in notes
    pages = spark.createDataFrame([("s", '<main><div class="body__x1">' + "w " * 50 + '</div><div class="share-box">s</div></main>'), ("s", None)], "site string, html string")
    assert reports.clutter_candidates(pages, "site", "html").first().selector == ".share-box"
    assert x(reports.deflated_size(F.lit(None).cast("string"))) == 8
