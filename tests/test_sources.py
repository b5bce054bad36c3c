import json

import pytest
from pyspark.sql import functions as F

from loomwell.sources import listing
from loomwell.sources.config import SettingsError, load_settings, size_of, with_collector_edition
from loomwell.sources.datasource import PagedListing, fetch_all
from loomwell.sources.store import POSTS, Store
from loomwell.streaming import sync_stream


def test_rest(spark, tmp_path):
    item = {"id": 7, "link": "https://e.example/7/", "date_gmt": "2024-01-01T00:00:00", "modified_gmt": "2024-01-02T00:00:00", "title": {"rendered": "A &amp; <b>B</b>"}, "content": {"rendered": "<p>x</p>"}, "excerpt": {"rendered": "<p>e</p>"},
            "_embedded": {"author": [{"name": ""}, {"name": "Al"}], "wp:term": [[{"taxonomy": "category", "name": "Uncategorized"}, {"taxonomy": "category", "name": "News"}], [{"taxonomy": "post_tag", "name": "t"}]],
                          "wp:featuredmedia": [{"source_url": "s.png", "media_details": {"sizes": {"full": {"source_url": "f.png"}}}}]}}
    (tmp_path / "r.json").write_text(json.dumps([item, {"id": 8}]))
    got = {r.key: r for r in listing.read_rest(spark, str(tmp_path / "r.json"), "b").collect()}
    r = got["wp-7"]
    assert (r.title, r.author, r.categories, r.tags, r.featured_image, r.date) == ("A & B", "Al", ["News"], ["t"], "f.png", "2024-01-01T00:00:00+00:00")
    assert got["wp-8"].categories == []


def test_feed_and_sitemap(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>/p/1</link><guid>g</guid><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;d&lt;/p&gt;</description><category>c</category></item></channel></rss>")
    r = listing.read_feed(spark, str(tmp_path / "f.xml"), "b", "https://e.example/feed").first()
    assert (r.url, r.tags, r.html, r.excerpt) == ("https://e.example/p/1", ["c"], "<p>d</p>", "d") and r.key.startswith("feed-")
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://e.example/blog/</loc></url><url><loc>https://e.example/blog/a</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://e.example/x</loc></url></urlset>")
    assert [r.url for r in listing.read_sitemap(spark, str(tmp_path / "s.xml"), "b", "https://e.example/blog").collect()] == ["https://e.example/blog/a"]
    assert listing.walk_sitemaps({"https://e/i": ["a", "b", "c"]}, "https://e/i", ["a|c"], 2) == ["https://e/i", "https://e/a"]
    assert listing.robots_sitemaps("Sitemap: /s.xml\nDisallow: x", "https://e/") == ["https://e/s.xml"]


def test_fallbacks(spark):
    refs = spark.createDataFrame([("https://e/a/",), ("https://e/b",)], "url string")
    pages = spark.createDataFrame([("https://e/a", "A"), ("https://e/b", "B")], "url string, html string")
    assert {r.html for r in listing.tolerant_pages(refs, pages).collect()} == {"A", "B"}
    answers = spark.createDataFrame([("x", "feed", None, None, True), ("x", "sitemap", None, "sitemap", True), ("y", "wordpress", None, None, False), ("y", "feed", None, None, True)], "blog_id string, source string, configured string, hint string, ok boolean")
    assert {tuple(r) for r in listing.resolve_source(answers).collect()} == {("x", "sitemap"), ("y", "feed")}
    feed = spark.createDataFrame([("u", "<p>s</p>", None)], "url string, html string, author string")
    page = spark.createDataFrame([("u", "<p>longer</p>", 6, "Al")], "url string, page_html string, page_chars int, page_author string")
    got = listing.longer_body(feed, page).first()
    assert (got.html, got.author) == ("<p>longer</p>", "Al")


def test_paged_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"page-{n}.json").write_text(json.dumps([{"id": n * 10 + i, "link": "l", "modified": f"2024-0{n}-01"} for i in range(2)]))
    spark.dataSource.register(PagedListing)
    df = spark.read.format("paged_listing").option("path", str(tmp_path)).load()
    assert df.count() == 4 and [r.id for r in df.where("id = 21").collect()] == [21]

    def fetch(ids):
        if 7 in ids:
            raise OSError
        return [{"id": i} for i in ids]

    rows, skipped = fetch_all(list(range(10)), 5, fetch)
    assert sorted(r["id"] for r in rows) == [0, 1, 2, 3, 4, 5, 6, 8, 9] and skipped == [7]


def test_store(spark, tmp_path, make_posts):
    s = Store(spark, str(tmp_path / "store"))
    assert s.posts().count() == 0
    s.put(make_posts([{"key": "a", "title": "1"}, {"key": "b"}]))
    s.put(make_posts([{"key": "a", "title": "2"}]))
    assert {(r.key, r.title) for r in s.posts().collect()} == {("a", "2"), ("b", None)}
    s.remove(s.posts().where("key = 'b'"))
    assert s.posts().count() == 1
    s.put_assets(spark.createDataFrame([("demo", "u", None, False), ("demo", "v", "404", True)], "blog_id string, url string, error string, permanent boolean").withColumn("file", F.lit(None).cast("string")))
    assert {(r.url, r.file is not None) for r in s.assets().collect()} == {("u", True), ("v", False)}


def test_store_loses_no_update_to_a_second_writer(spark, tmp_path, make_posts):
    a, b = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    a.put(make_posts([{"key": "a"}]))

    def slow(cached):
        if not cached.where("key = 'c'").count():
            b.put(make_posts([{"key": "c"}]))  # the other writer commits between this one's reading and its publishing
        return cached.unionByName(make_posts([{"key": "b"}]).select(*cached.columns))

    a.change("posts", POSTS, slow)
    make_posts([{"key": "dead"}]).write.parquet(a._log("posts").stage())  # died before its marker
    assert {r.key for r in Store(spark, str(tmp_path / "store")).posts().collect()} == {"a", "b", "c"}
    assert [r.url for r in b.available_assets().collect()] == []


def test_settings():
    raw = {"defaults": {"min_chars": 10}, "blogs": [{"id": "a", "url": "https://a.example", "include": "x"}, {"id": "b", "url": "https://b.example"}], "books": [{"id": "both", "blogs": ["a", "b"], "max_bytes": "1 MB"}]}
    s = load_settings(raw, ["a.min_chars=0"])
    assert (s.blogs["a"].min_chars, s.blogs["b"].min_chars, s.books["both"].max_bytes) == (0, 10, 1_000_000)
    assert [b.id for b in s.all_books()] == ["a", "b", "both"] and [b.id for b in s.select(["both", "a"])] == ["a", "b"]
    assert with_collector_edition(s.books["both"]).split == "none"
    for bad in ({"id": "a b"}, {"order": "up"}, {"since": "soon"}, {"include": ["("]}, {"keep": ["p:x"]}, {"colour": 1}):
        with pytest.raises(SettingsError):
            load_settings({"blogs": [{"id": "z", "url": "u"} | bad]} if "order" not in bad else {"blogs": [], "books": [{"id": "z", "blogs": []} | bad]})
    for value in (0, -1, "words", True):
        with pytest.raises(SettingsError):
            size_of(value, "x")


def test_streams(spark, tmp_path):
    schema = "k string, at timestamp, v long"
    rows = lambda *x: spark.createDataFrame(list(x), "k string, t string, v long").selectExpr("k", "cast(t as timestamp) as at", "v")
    at = str(tmp_path)
    for part in (rows(("a", "2024-01-01", 1), ("b", "2024-01-01", 1)), rows(("a", "2024-01-02", 2), ("a", "2023-01-01", 9)), rows()):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
        sync_stream.sync_available(spark, f"{at}/in", schema, f"{at}/out", f"{at}/c", ["k"], ["at", "v"])
    assert {(r.k, r.v) for r in sync_stream.current(spark, f"{at}/out", schema).collect()} == {("a", 2), ("b", 1)}
    stream = spark.readStream.schema(schema).parquet(f"{at}/in")
    timers = sync_stream.retry_timers(stream.withColumn("permanent", F.col("k") == "b"), "k", "at")
    q = timers.writeStream.format("memory").queryName("timers").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.k: (r.failures, r.retry_at) for r in spark.table("timers").collect()}
    assert got["b"][1] is None and got["a"][0] == 3 and str(got["a"][1]).startswith("2024-01-05")


def test_candidates_and_assets(spark, tmp_path):
    html = '<link rel="https://api.w.org/" href="/api/"><link rel="alternate" type="application/rss+xml" href="/f.xml">'
    assert listing.api_candidates(html, "https://e.example/blog")[0] == "https://e.example/api/"
    assert listing.feed_candidates(html, "https://e.example/blog")[:2] == ["https://e.example/f.xml", "https://e.example/blog/feed"]
    assert listing.sitemap_candidates("sitemap: /s.xml", "https://e.example/")[0] == "https://e.example/s.xml"
    assert listing.is_sitemap('<?xml version="1.0"?><urlset xmlns="x">') and not listing.is_sitemap("<html>")
    assert listing.decoded("é".encode(), "iso-8859-1") == "é" and listing.decoded(b"\xe9", None) == "é" and listing.decoded("я".encode("cp1251"), "windows-1251") == "я"
    lines = spark.createDataFrame([('{"key": "a", "more": 1}',), ("broken",)], "value string")
    assert [r.key for r in listing.from_json(lines, "key string").collect()] == ["a", None]
    assert listing.to_json(spark.createDataFrame([("a",)], "key string")).first().value == '{"key":"a"}'
    (tmp_path / "a.json").write_text('{"name": "api-20240101.2024.epub", "size": 3}\n{"name": "x.txt", "size": 1}\n')
    assert [(r.book, r.issue) for r in listing.read_assets(spark, str(tmp_path / "a.json")).collect()] == [("api", "20240101")]


def test_atom_and_feed_dates(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed><entry><title>A &amp; B</title><id>urn:1</id><link rel="self" href="/x"/><link href="/a"/><published>2024-07-01T12:00:00+02:00</published><updated>2024-07-02T00:00:00Z</updated>'
        '<content type="html">&lt;p&gt;body&lt;/p&gt;</content><author><name>Ada</name></author><category term="t"/></entry><entry><title>no link</title></entry></feed>'
    )
    (tmp_path / "r.xml").write_text("<rss><item><title>R</title><link>https://e.example/r</link><pubDate>Mon, 01 Jul 2024 08:00:00 -0400</pubDate><description>d</description></item></rss>")
    (r,) = listing.read_atom(spark, str(tmp_path / "a.xml"), "b", "https://e.example/feed").collect()
    assert (r.url, r.title, r.html, r.date, r.modified, r.author, r.tags) == ("https://e.example/a", "A & B", "<p>body</p>", "2024-07-01T10:00:00+00:00", "2024-07-02T00:00:00+00:00", "Ada", ["t"])
    (r,) = listing.read_feed(spark, str(tmp_path / "r.xml"), "b", "https://e.example/feed").collect()
    assert r.date == r.modified == "2024-07-01T12:00:00+00:00"


def test_retry_timers_fire(spark, tmp_path):
    at = str(tmp_path)
    for day, k in (("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-09", "c"), ("2024-01-10", "d")):
        spark.createDataFrame([(k, day, False)], "k string, t string, permanent boolean").selectExpr("k", "cast(t as timestamp) as at", "permanent").coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("k string, at timestamp, permanent boolean").parquet(f"{at}/in")
        out = sync_stream.retry_timers(stream, "k", "at").writeStream.outputMode("update").option("checkpointLocation", f"{at}/c")
        out.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{at}/out")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{at}/out").collect()
    assert sorted(r.k for r in got if r.due) == ["a", "b"] and sorted(r.k for r in got if not r.due) == ["a", "b", "c", "d"]
