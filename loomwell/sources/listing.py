"""Listings from files: REST dumps, feeds and sitemaps, each to refs rows (blog_id, key, url, title, date, modified)."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.operators.timestamps import clock_udf
from loomwell.functions.dates import gmt
from loomwell.functions.dom import parse, text_of
from loomwell.functions.text import accepts

#: Order in which a blog's sources are asked when none is configured.
SOURCE_ORDER = ("wordpress", "feed", "sitemap")
IMAGE_SIZES = ("large", "medium_large", "full")
MOST_SITEMAPS = 200

_TERM = "struct<taxonomy:string,name:string>"
_SIZES = ",".join(f"{s}:struct<source_url:string>" for s in IMAGE_SIZES)
REST_SCHEMA = (
    "id long, link string, slug string, date_gmt string, modified_gmt string, title struct<rendered:string>, content struct<rendered:string>, excerpt struct<rendered:string>, "
    f"_embedded struct<author:array<struct<name:string>>, `wp:term`:array<array<{_TERM}>>, `wp:featuredmedia`:array<struct<source_url:string,media_details:struct<sizes:struct<{_SIZES}>>>>>"
)


@F.pandas_udf(T.StringType())
def _text(values: pd.Series) -> pd.Series:
    return values.map(text_of)


@F.pandas_udf(T.StringType())
def _joined(bases: pd.Series, links: pd.Series) -> pd.Series:
    def one(base: str | None, link: str | None) -> str | None:
        try:
            return urljoin(base or "", link.strip()) if link else link
        except ValueError:
            return link

    return pd.Series([one(b, x) for b, x in zip(bases, links, strict=True)])


def read_rest(spark: SparkSession, path: str, blog_id: str) -> DataFrame:
    """Posts of a REST dump (JSON lines or arrays): ids as wp-<id>, terms split by taxonomy, "uncategorized" left out."""
    raw = spark.read.schema(REST_SCHEMA).option("multiLine", True).json(path).where("id is not null")
    terms = F.coalesce(F.flatten("_embedded.`wp:term`"), F.array().cast(f"array<{_TERM}>"))
    named = lambda tax: F.transform(F.filter(terms, lambda t: (t["taxonomy"] == tax) & (F.lower(t["name"]) != "uncategorized")), lambda t: t["name"])
    media = F.get(F.col("_embedded.`wp:featuredmedia`"), F.lit(0))
    picture = F.coalesce(*(media["media_details"]["sizes"][s]["source_url"] for s in IMAGE_SIZES), media["source_url"])
    author = F.get(F.filter(F.transform("_embedded.author", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), F.lit(0))
    return raw.select(
        F.lit(blog_id).alias("blog_id"), F.concat(F.lit("wp-"), F.col("id").cast("string")).alias("key"), F.col("link").alias("url"), _text("title.rendered").alias("title"),
        F.col("content.rendered").alias("html"), gmt("date_gmt").alias("date"), gmt("modified_gmt").alias("modified"), author.alias("author"), named("category").alias("categories"),
        named("post_tag").alias("tags"), _text("excerpt.rendered").alias("excerpt"), picture.alias("featured_image"), F.lit("wordpress").alias("source"),
    )


def iso_utc(text: str) -> Column:
    """A feed's date in any notation as ISO in UTC; null where it can't be read."""
    at = clock_udf(F.col(text), F.lit("UTC"), F.lit("en-US"))["utc_us"]
    return F.date_format(F.timestamp_micros(at), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def read_atom(spark: SparkSession, path: str, blog_id: str, feed_url: str) -> DataFrame:
    """Posts of an Atom file: the link without a relation or with ``alternate``, content before summary, key from the id."""
    text = "struct<_VALUE: string, _type: string>"
    schema = f"title {text}, id string, published string, updated string, summary {text}, content {text}, link array<struct<_href: string, _rel: string>>, author array<struct<name: string>>, category array<struct<_term: string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    links = F.filter(F.coalesce("link", F.array().cast("array<struct<_href: string, _rel: string>>")), lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    raw = raw.withColumn("_link", F.get(links, F.lit(0))["_href"]).where("_link is not null")
    some = lambda c: F.when(F.trim(c) != "", c)
    body = F.coalesce(some(F.col("content._VALUE")), F.col("summary._VALUE"))
    flat = raw.withColumn("_title", F.col("title._VALUE")).withColumn("_summary", F.col("summary._VALUE")).withColumn("_first", F.coalesce("published", "updated"))
    key = F.concat(F.lit("feed-"), F.substring(F.sha1(F.coalesce(some(F.trim("id")), F.col("_link"))), 1, 16))
    return flat.select(
        F.lit(blog_id).alias("blog_id"), key.alias("key"), _joined(F.lit(feed_url), F.col("_link")).alias("url"), _text("_title").alias("title"), body.alias("html"), iso_utc("_first").alias("date"), iso_utc("updated").alias("modified"),
        F.get(F.col("author"), F.lit(0))["name"].alias("author"), F.array().cast("array<string>").alias("categories"), F.coalesce(F.transform("category", lambda c: c["_term"]), F.array().cast("array<string>")).alias("tags"),
        _text("_summary").alias("excerpt"), F.lit(None).cast("string").alias("featured_image"), F.lit("feed").alias("source"),
    )


def read_feed(spark: SparkSession, path: str, blog_id: str, feed_url: str, item: str = "item") -> DataFrame:
    """Posts of an RSS file: relative links against the feed, key from the guid or else the url, terms as tags."""
    schema = "title string, link string, guid string, pubDate string, description string, `content:encoded` string, category array<string>, author string, `dc:creator` string"
    raw = spark.read.format("xml").option("rowTag", item).schema(schema).load(path)
    url = _joined(F.lit(feed_url), F.col("link"))
    body = F.coalesce(F.when(F.trim("`content:encoded`") != "", F.col("`content:encoded`")), F.col("description"))
    key = F.concat(F.lit("feed-"), F.substring(F.sha1(F.coalesce(F.when(F.trim("guid") != "", F.trim("guid")), "link")), 1, 16))
    return raw.where("link is not null").select(
        F.lit(blog_id).alias("blog_id"), key.alias("key"), url.alias("url"), _text("title").alias("title"), body.alias("html"), iso_utc("pubDate").alias("date"), iso_utc("pubDate").alias("modified"),
        F.coalesce("`dc:creator`", "author").alias("author"), F.array().cast("array<string>").alias("categories"), F.coalesce("category", F.array().cast("array<string>")).alias("tags"),
        _text("description").alias("excerpt"), F.lit(None).cast("string").alias("featured_image"), F.lit("feed").alias("source"),
    )


def longer_body(feed: DataFrame, pages: DataFrame, least: int = 1500) -> DataFrame:
    """Feed posts with short bodies take the page's body (url, page_html) where that is longer, other fields if missing."""
    both = feed.join(pages.select("url", "page_html", "page_chars", "page_author"), "url", "left")
    chars = F.length(_text("html"))
    take = (chars < least) & (F.coalesce("page_chars", F.lit(0)) > chars)
    return both.withColumn("html", F.when(take, F.col("page_html")).otherwise(F.col("html"))).withColumn("author", F.coalesce("author", "page_author")).drop("page_html", "page_chars", "page_author")


def read_sitemap(spark: SparkSession, path: str, blog_id: str, blog_url: str, include: list[str] = ()) -> DataFrame:
    """Refs of a urlset file: below the blog's root unless patterns say otherwise, the root itself left out."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    root = blog_url.rstrip("/")
    refs = raw.select(F.trim("loc").alias("url"), F.trim("lastmod").alias("modified")).where(F.regexp_replace("url", "/+$", "") != root)
    kept = refs.where(accepts("url", list(include))) if include else refs.where(F.startswith("url", F.lit(root + "/")))
    key = F.concat(F.lit("sm-"), F.substring(F.sha1("url"), 1, 16))
    return kept.select(F.lit(blog_id).alias("blog_id"), key.alias("key"), "url", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("date"), "modified")


def walk_sitemaps(children: dict[str, list[str]], root: str, include: list[str] = (), most: int = MOST_SITEMAPS) -> list[str]:
    """Sitemap files in depth-first order from the index, each once, at most ``most`` of them with the index.

    ``children`` maps an index to what it lists; entries are resolved against their index and filtered before they count.
    """
    seen: list[str] = []
    waiting = [root]
    while waiting and len(seen) < most:
        at = waiting.pop()
        if at in seen:
            continue
        seen.append(at)
        below = [urljoin(at, c) for c in children.get(at, [])]
        waiting += [c for c in reversed(below) if not include or any(re.search(p, c) for p in include)]
    return seen


def resolve_source(answers: DataFrame) -> DataFrame:
    """answers (blog_id, source, configured, hint, ok): the source to use, the configured one, the cached hint, then the
    fixed order; only sources that answered."""
    rank = F.coalesce(*(F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(SOURCE_ORDER)), F.lit(99))
    order = F.struct((F.col("source") != F.coalesce("configured", F.lit(""))).cast("int").alias("a"), (F.col("source") != F.coalesce("hint", F.lit(""))).cast("int").alias("b"), rank.alias("c"))
    return answers.where("ok").groupBy("blog_id").agg(F.min_by("source", order).alias("source"))


def robots_sitemaps(text: str, base: str) -> list[str]:
    return [urljoin(base, line.split(":", 1)[1].strip()) for line in text.splitlines() if line.lower().strip().startswith("sitemap:")]


def tolerant_pages(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Join refs (url) with pages (url, html), else with the page of the other trailing-slash form."""
    toggled = F.when(F.endswith("url", F.lit("/")), F.regexp_replace("url", "/$", "")).otherwise(F.concat("url", F.lit("/")))
    other = pages.select(F.col("url").alias("_t"), F.col("html").alias("_h"))
    both = refs.withColumn("_t", toggled).join(pages.select("url", "html"), "url", "left").join(other, "_t", "left")
    return both.withColumn("html", F.coalesce("html", "_h")).drop("_t", "_h")


# ---- finding a blog's sources in its pages ----

# Where sources are looked for when a page does not name them.
API_PATHS = ("/wp-json/wp/v2", "/?rest_route=/wp/v2")
FEED_PATHS = ("/feed", "/feed/", "/rss.xml", "/atom.xml", "/index.xml", "/feed.xml", "/rss", "/feed/atom")
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml")


def _linked(html: str, rel: str) -> list[dict[str, str]]:
    return [n.attrs for n in parse(html).walk() if n.tag == "link" and rel in n.attrs.get("rel", "").lower().split()]


def api_candidates(html: str, url: str) -> list[str]:
    """REST roots: the one a page links to, then the usual places."""
    named = [urljoin(url, a["href"]) for a in _linked(html, "https://api.w.org/") if a.get("href")]
    return list(dict.fromkeys([*named, *(urljoin(url, p) for p in API_PATHS)]))


def feed_candidates(html: str, url: str) -> list[str]:
    """Feeds: those a page links to, then the usual places below the blog and at its origin."""
    kinds = ("application/rss+xml", "application/atom+xml")
    named = [urljoin(url, a["href"]) for a in _linked(html, "alternate") if a.get("type", "").lower() in kinds and a.get("href")]
    usual = [url.rstrip("/") + p for p in FEED_PATHS] + [urljoin(url, p) for p in FEED_PATHS]
    return list(dict.fromkeys([*named, *usual]))


def sitemap_candidates(robots: str, url: str) -> list[str]:
    return list(dict.fromkeys([*robots_sitemaps(robots, url), *(urljoin(url, p) for p in SITEMAP_PATHS)]))


def is_sitemap(xml: str) -> bool:
    m = re.search(r"<(?:\w+:)?(urlset|sitemapindex)\b", xml[:2000])
    return m is not None


def decoded(body: bytes, declared: str | None) -> str:
    """Text of a response: a missing or Latin-1 declaration is not believed where the bytes are UTF-8."""
    believed = (declared or "").lower()
    if believed not in ("", "iso-8859-1", "latin-1"):
        try:
            return body.decode(believed)
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def to_json(posts: DataFrame) -> DataFrame:
    return posts.select(F.to_json(F.struct("*")).alias("value"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    """Posts from JSON lines (value); unknown fields are ignored, broken lines give nulls."""
    return lines.select(F.from_json("value", schema).alias("p")).select("p.*")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Release assets (name, size) from JSON lines, with the book and issue that their names carry."""
    raw = spark.read.schema("name string, size long").json(path)
    pattern = r"^(.+?)-(\d{8})((?:\..+)?)\.epub$"
    return raw.where(F.col("name").rlike(pattern)).select("name", "size", F.regexp_extract("name", pattern, 1).alias("book"), F.regexp_extract("name", pattern, 2).alias("issue"))
