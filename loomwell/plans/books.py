"""From the cache to chapters and volumes; queries that no SQL states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.functions import dates, text
from loomwell.operators import cleaning, extraction, intervals, rendering, selection, timestamps
from loomwell.session import broadcast_if_small, materialise, read_table, scratch
from loomwell.streaming import sync_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def current_posts(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "posts")
    keep = ["seq", "url", "title", "html", "date", "author", "categories", "excerpt", "featured_image"]
    best = p.groupBy("blog_id", "key").agg(F.max_by(F.struct(*keep), F.struct("fetched_at", "seq")).alias("_p"))
    return best.select("blog_id", "key", "_p.*")


def stored_images(posts: DataFrame) -> DataFrame:
    """(url, file) of the images that the cache keeps: those that posts name as theirs."""
    urls = posts.where("featured_image is not null and featured_image <> ''").select(F.col("featured_image").alias("url")).distinct()
    return urls.withColumn("file", F.concat(F.lit("images/"), F.sha1("url")))


def chapter_rows(spark: SparkSession, folder: str, blogs: list[str] | None = None, assets: DataFrame | None = None) -> DataFrame:
    """(blog_id, idx, file, name, part, xhtml, links, images): current posts in reading order with finished bodies, of all
    blogs or those named. Images that aren't among ``assets`` (url, file; else ``stored_images``) give way to their text."""
    current = current_posts(spark, folder)
    current = current if blogs is None else current.where(F.col("blog_id").isin(blogs))
    posts = materialise(timestamps.post_clocks(current, read_table(spark, folder, "blogs"), "date"), "current-posts")
    order = Window.partitionBy("blog_id").orderBy(F.desc_nulls_last("utc_us"), F.lower("title").desc(), "key")
    slim = posts.select("blog_id", "key", "utc_us", "title").withColumn("idx", F.row_number().over(order).cast("long")).select("blog_id", "key", "idx")
    placed = posts.join(slim, (posts["blog_id"].eqNullSafe(slim["blog_id"])) & (posts["key"].eqNullSafe(slim["key"]))).drop(slim["blog_id"]).drop(slim["key"])
    placed = materialise(placed.withColumn("file", F.format_string("Text/ch-%04d.xhtml", "idx")), "chapters")
    bodies = cleaning.rewrite_bodies(placed.select("blog_id", "idx", "url", "html"), "html", "url").withColumn("cid", F.concat_ws("/", "blog_id", F.col("idx").cast("string")))
    bodies = materialise(bodies.drop("html"), "bodies")
    by_norm = placed.groupBy("blog_id", text.normalize_url("url").alias("norm")).agg(F.max_by("file", "idx").alias("target"))
    hrefs = bodies.select("cid", "blog_id", F.explode(F.array_distinct("links")).alias("url")).withColumn("norm", text.normalize_url("url"))
    targets = hrefs.join(by_norm, ["blog_id", "norm"]).select("cid", "url", "target")
    files = assets.select("url", "file").dropDuplicates(["url"]) if assets is not None else stored_images(placed)
    filled = cleaning.fill_bodies(bodies, "cid", targets, files)
    out = bodies.select("cid", "blog_id", "idx", "links", "images").join(filled, "cid")
    names = placed.select("blog_id", "idx", "file", F.coalesce("title", F.lit("Untitled")).alias("name"), dates.wall_year("wall_us").alias("part"))
    return out.join(names, ["blog_id", "idx"]).select("blog_id", "idx", "file", "name", "part", "xhtml", "links", "images")


@query()
def q_clean_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return chapter_rows(spark, folder).select("blog_id", "idx", "file", "xhtml", F.size("links").alias("links"), F.size("images").alias("images"))


@query()
def q_extract_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "posts").select("seq", "url", "title", "html", "date")
    head = F.concat(F.lit("<html><head><title>"), text.escape_xml(F.coalesce("title", F.lit(""))), F.lit('</title><meta property="article:published_time" content='), text.quote_attribute(F.coalesce("date", F.lit(""))), F.lit("></head><body>"))
    pages = p.withColumn("page", F.concat(head, F.coalesce("html", F.lit("")), F.lit("</body></html>")))
    return extraction.extract_pages(pages, "page", "url").select("seq", "post.title", "post.date", F.length("post.html").alias("chars"))


@query()
def q_containers(spark: SparkSession, folder: str) -> DataFrame:
    rows = chapter_rows(spark, folder).withColumn("book", F.col("blog_id"))
    bins = selection.pack_in_order(rows.withColumn("w", F.length("xhtml")), ["blog_id"], "idx", "w", 200_000)
    return rendering.package_volumes(rows.join(bins, ["blog_id", "idx"]), ["blog_id", "bin"], "book").select("blog_id", "bin", "title", "posts", "bytes")


@query(
    """with d as (select source, doc_id, coalesce(title, 'Untitled') as t, url, n_chars from documents)
    select doc_id, '<li><a href="' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</a> <span class="date">' || source || '</span></li>' as line from d"""
)
def q_part_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents")
    items = rendering.part_items(d, ["doc_id"], "doc_id", F.col("url"), F.coalesce("title", F.lit("Untitled")), [F.col("source")], F.lit(""))
    inner = F.regexp_replace(F.regexp_replace("items", '^<ol class="part-list">\n', ""), "\n</ol>$", "")
    return items.select("doc_id", inner.alias("line"))


@query(
    """with d as (select source, doc_id, coalesce(strftime(published at time zone 'UTC', '%Y'), 'Undated') as y, coalesce(strftime(published at time zone 'UTC', '%Y-%m'), 'Undated') as m from documents),
    p as (select source, y, m, doc_id as idx from d union all select distinct source, y, m, null from d union all select distinct source, y, null, null from d)
    select source, y, coalesce(m, '') as m, coalesce(idx, -1) as idx, row_number() over (partition by source order by y, coalesce(m, '~'), coalesce(idx, 99999999999)) as play_order from p"""
)
def q_play_order(spark: SparkSession, folder: str) -> DataFrame:
    dated = lambda form: F.coalesce(F.date_format("published", form), F.lit("Undated"))
    d = read_table(spark, folder, "documents").select("source", dated("yyyy").alias("y"), dated("yyyy-MM").alias("m"), F.col("doc_id").alias("idx"))
    none_m, none_i = F.lit(None).cast("string").alias("m"), F.lit(None).cast("long").alias("idx")
    points = d.unionByName(d.select("source", "y", "m").distinct().select("source", "y", "m", none_i)).unionByName(d.select("source", "y").distinct().select("source", "y", none_m, none_i))
    months = points.withColumn("mm", F.when(F.col("m") == "Undated", 999_999).otherwise(F.regexp_replace("m", "-", "").try_cast("long")).cast("long"))
    return rendering.play_order(months, ["source"], "y", "mm", "idx").select("source", "y", F.coalesce("m", F.lit("")).alias("m"), F.coalesce("idx", F.lit(-1).cast("long")).alias("idx"), F.col("play_order").cast("long"))


_KEPT = "select distinct blog_id as source, seq from refs"


@query(f"select source, min(seq) as lo, max(seq) as hi from (select source, seq, seq - row_number() over (partition by source order by seq) as g from ({_KEPT})) group by source, g")
def q_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.to_intervals(read_table(spark, folder, "refs").select(F.col("blog_id").alias("source"), "seq"))


@query("select blog_id, seq from refs where run_id % 3 = 0")
def q_gaps(spark: SparkSession, folder: str) -> DataFrame:
    refs = read_table(spark, folder, "refs")
    done = intervals.to_intervals(refs.where("run_id % 3 <> 0").select(F.col("blog_id").alias("source"), "seq"))
    return intervals.subtract(refs.select("blog_id", "seq"), done, "blog_id", "seq")


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def q_stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch(spark, "stream")
    e = read_table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    for part in (e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)):  # two deliveries, two runs of the same stream
        part.write.mode("append").parquet(f"{at}/in")
        sync_stream.sync_available(spark, f"{at}/in", "event_id long, ts timestamp, user_id long, event_type string", f"{at}/out", f"{at}/check", ["user_id"], ["ts", "event_id"])
    return sync_stream.current(spark, f"{at}/out", "event_id long, ts timestamp, user_id long, event_type string").select("user_id", "event_id", "event_type")


@query("select b.title, p.title as post, p.blog_id from (select blog_id, key, arg_max(title, (fetched_at, seq)) as title from posts group by 1, 2) p join blogs b using (blog_id)")
def q_book_posts(spark: SparkSession, folder: str) -> DataFrame:
    blogs = read_table(spark, folder, "blogs").select("blog_id", F.col("title").alias("blog_title"))
    p = current_posts(spark, folder).select("blog_id", F.col("title").alias("post")).join(broadcast_if_small(blogs), "blog_id")
    return p.select(F.col("blog_title").alias("title"), "post", "blog_id")
