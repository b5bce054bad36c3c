"""Queries of reports, front pages and figures on pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import text
from loomwell.operators import covers, reports
from loomwell.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_HEAD = """'<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="en" xml:lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8"/>' || chr(10) || '<title>' || source || '</title>' || chr(10) || '<link rel="stylesheet" type="text/css" href="../Styles/styles.css"/>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)"""


_LI = "'<li>' || t || ' &#8212; <a href=\"' || u || '\">' || u || '</a></li>'"


@query(
    f"""with d as (select source, lang, count(*) as n, min(published at time zone 'UTC') as lo, max(published at time zone 'UTC') as hi from (select source, upper(coalesce(lang, 'none')) as lang, published from documents) group by 1, 2),
    b as (select lang as source, sum(n) as n, strftime(min(lo), '%B %Y') as a, strftime(max(hi), '%B %Y') as z, count(*) as k, min('https://' || d.source || '.example') as u1,
      string_agg({_LI.replace("t ||", "d.source ||").replace("u ||", "'https://' || d.source || '.example' ||")}, chr(10) order by d.source) as entries from d group by 1)
    select source, {_HEAD} || '<section epub:type="titlepage" class="titlepage">' || chr(10) || '<h1>' || source || '</h1>' || chr(10) || case when n > 100 then '<p class="subtitle">Many &amp; more</p>' || chr(10) else '' end || '<p class="subtitle">The editors</p>' || chr(10)
    || '<div class="meta">' || chr(10) || '<p>' || n || ' posts' || coalesce(', ' || case when a = z then a else a || ' &#8211; ' || z end, '') || '</p>' || chr(10) || '<p>In ' || source || '</p>' || chr(10)
    || case when k = 1 then '<p>Collected from <a href="' || u1 || '">' || u1 || '</a></p>' else '<p>Collected from:</p>' || chr(10) || '<ul>' || chr(10) || entries || chr(10) || '</ul>' end || chr(10)
    || '<p class="issue">Issue 20260601.1' || case when n > 100 then ' &#183; Vol. 1 of 2' else '' end || '</p>' || chr(10) || '<p>Generated 01 June 2026. All content remains the property of its original authors.</p>' || chr(10) || '</div>' || chr(10) || '</section>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) as page from b"""
)
def q_title_pages(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents").select(F.col("source").alias("blog"), F.upper(F.coalesce("lang", F.lit("none"))).alias("source"), "published")
    per_blog = d.groupBy("source", "blog").agg(F.count("*").alias("n"), F.min("published").alias("a"), F.max("published").alias("z"))
    blog = F.struct(F.col("blog").alias("title"), F.concat(F.lit("https://"), "blog", F.lit(".example")).alias("url"))
    per = per_blog.groupBy("source").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"), F.array_sort(F.collect_list(blog)).alias("s"))
    many = lambda text: F.when(F.col("n") > 100, text)
    at = F.lit("2026-06-01").cast("date")
    page = reports.title_page(F.lit("en"), F.col("source"), F.col("n"), F.col("a"), F.col("z"), F.col("s"), F.lit("20260601.1"), at, many("Many & more"), F.lit("The editors"), F.concat(F.lit("In "), "source"), many("Vol. 1 of 2"))
    return per.select("source", page.alias("page"))


@query("select blog_id, '{\"blog_id\":\"' || blog_id || '\",\"listed\":' || n || ',\"undated\":' || u || '}' as report from (select blog_id, count(*) as n, count(*) filter (date is null) as u from refs group by 1)")
def q_run_report(spark: SparkSession, folder: str) -> DataFrame:
    per = read_table(spark, folder, "refs").groupBy("blog_id").agg(F.count("*").alias("listed"), F.count_if(F.col("date").isNull()).alias("undated"))
    return reports.run_report(per, "blog_id")


@query(
    """select o_orderkey, printf('built %s - %s: %d posts, %d images, %.1f MB', o_orderpriority || '.epub', case when o_orderstatus = 'O' then o_orderpriority || ' (open)' else o_orderpriority end, o_custkey, o_orderkey % 50, o_orderkey * 1000 / 1e6)
    || case when o_orderkey * 300 > 100000 then case when o_orderkey * 1000 > 1000000 then printf(' (images optimised: %.1f -> %.1f MB, -%.0f%%)', o_orderkey * 1000 / 1e6, o_orderkey * 700 / 1e6, 30.0) else printf(' (images optimised: %.1f -> %.1f kB, -%.0f%%)', o_orderkey * 1000 / 1e3, o_orderkey * 700 / 1e3, 30.0) end else '' end
    || case when o_orderkey % 3 > 0 then printf(' (%d image references had no cached file)', o_orderkey % 3) else '' end as line from orders"""
)
def q_build_lines(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "O", "open").otherwise("")
    line = reports.build_line(F.concat("o_orderpriority", F.lit(".epub")), F.col("o_orderpriority"), label, F.col("o_custkey"), k % 50, k * 1000, k * 1000, k * 700, k % 3)
    return read_table(spark, folder, "orders").select("o_orderkey", line.alias("line"))


_BOOKS = "case when o_orderkey % 5 = 0 then 'o' || o_orderkey else 'c' || o_custkey end"


@query(
    f"""with f as (select {_BOOKS} as book, o_orderkey as k, case when o_custkey % 4 = 0 then null else o_orderkey % 90 end as posts, o_orderkey * 1000000 as bytes, case when o_custkey % 3 = 0 then 'Of ' || o_custkey end as title, case when o_orderkey % 2 = 0 then o_orderstatus end as label, case when o_orderkey % 7 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as span from orders),
    r as (select *, '`' || lpad(cast(k as varchar), 9, '0') || '.epub`' as name, case when bytes >= 1e9 then printf('%.2f GB', bytes / 1e9) else printf('%.1f MB', bytes / 1e6) end as size from f),
    l as (select *, '| ' || name || ' | ' || coalesce(label, title, '') || ' | ' || coalesce(cast(posts as varchar), '') || ' | ' || coalesce(span, '') || ' | ' || size || ' |' as built, '| ' || name || ' | ' || size || ' |' as kept,
      name || ': ' || posts || ' posts' || coalesce(', ' || span, '') || ', ' || size || '.' || chr(10) as one_built, name || ': ' || size || '.' || chr(10) as one_kept from r),
    g as (select book, count(*) as n, sum(posts) as p, max(title) as t, sum(bytes) as bytes, string_agg(case when posts is null then kept else built end, chr(10) order by name) as rows, min(case when posts is null then one_kept else one_built end) as one from l group by book)
    select book, n as files, cast(bytes as bigint) as bytes, case when p is null then '### `' || book || '`' || chr(10) || chr(10) || 'Kept from an earlier run of this issue.' || chr(10) || chr(10) || case when n > 1 then '| File | Size |' || chr(10) || '| --- | --- |' || chr(10) || rows || chr(10) else one end
    else '### ' || coalesce(t, book) || ' — `' || book || '`' || chr(10) || chr(10) || case when n > 1 then cast(p as bigint) || ' posts in ' || n || ' volumes, each under the size Send to Kindle accepts.' || chr(10) || chr(10) || '| File | Volume | Posts | Covering | Size |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || rows || chr(10) else one end end as section from g"""
)
def q_release_sections(spark: SparkSession, folder: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    files = read_table(spark, folder, "orders").select(
        F.when(k % 5 == 0, F.concat(F.lit("o"), k.cast("string"))).otherwise(F.concat(F.lit("c"), c.cast("string"))).alias("book"), F.when(c % 3 == 0, F.concat(F.lit("Of "), c.cast("string"))).alias("title"),
        F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit(".epub")).alias("name"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("label"), F.when(c % 4 != 0, k % 90).alias("posts"),
        F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("span"), (k * 1_000_000).alias("bytes"),
    )
    return reports.release_sections(files, "book")


@query(
    """with c as (select source, '#' || substr(md5(cast(doc_id % 40 as varchar)), 1, 6) as colour from documents) select source, colour, n from (select source, colour, count(*) as n, row_number() over (partition by source order by count(*) desc, colour) as r from c group by 1, 2) where r <= 10"""
)
def q_colours(spark: SparkSession, folder: str) -> DataFrame:
    styled = F.concat(F.lit("a { color: "), F.upper(F.concat(F.lit("#"), F.substring(F.md5((F.col("doc_id") % 40).cast("string")), 1, 6))), F.lit("; }"))
    return reports.colours(read_table(spark, folder, "documents").select("source", styled.alias("css")), "source", "css")


@query(
    """with d as (select upper(coalesce(lang, 'none')) as book, source, doc_id, published from documents),
    b as (select book, source, min(doc_id) as o from d group by 1, 2), l as (select book, count(*) as k, string_agg(source, ' · ' order by o) as names, min('blogs.example/' || source) as u from b group by 1),
    p as (select book, count(*) as n, strftime(min(published at time zone 'UTC'), '%Y') as a, strftime(max(published at time zone 'UTC'), '%Y') as z from d group by 1)
    select book, cast(n as varchar) as count, coalesce(a, '') as first_year, coalesce(z, '') as last_year, coalesce(case when a = z then a else a || ' – ' || z end, '') as years, coalesce(case when a = z then a else a || ' to ' || z end, '') as years_prose, 'June 2026' as issue, '20260601.2' as issue_number, '2' as volume,
    case when n > 100 then '3' else '1' end as volumes, case when n > 100 then 'Vol. 2 of 3' else '' end as volume_label, 'June' as month, '2026' as year, case when k = 1 then u else '' end as url, book as title, cast(k as varchar) as blog_count, names as blog_list from p join l using (book)"""
)
def q_cover_values(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents").select(F.upper(F.coalesce("lang", F.lit("none"))).alias("book"), F.col("source").alias("blog"), "doc_id", F.coalesce("title", F.lit("Untitled")).alias("title"), "published")
    d = d.withColumn("kicker", text.kicker("title", F.lit(None).cast("array<string>"))).withColumn("url", F.concat(F.lit("https://blogs.example/"), "blog"))
    lines = covers.cover_lines(d, "book", "published", "title", "kicker", "doc_id", 3)
    v = reports.cover_values(d, "book", "published", lines, datetime(2026, 6, 1), order="doc_id", volume=F.lit(2), volumes=F.when(F.col("n") > 100, 3).otherwise(1))
    names = "count first_year last_year years years_prose issue issue_number volume volumes volume_label month year url title blog_count blog_list".split()
    return v.select("book", *(F.col("values")[k].alias(k) for k in names))


@query("select doc_id, case doc_id % 3 when 0 then 'images/' || doc_id || '.png' else 'images/' || doc_id || '.gif' end as raster, case doc_id % 3 when 0 then null else 'images/' || doc_id || '.gif' end as dropped, 'fill: #fff; stroke: #123' as css from documents")
def q_svg_policy(spark: SparkSession, folder: str) -> DataFrame:
    svg = F.col("doc_id") % 3 == 0
    kind = F.when(svg, "image/svg+xml").otherwise("image/gif")
    file = F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.when(svg, ".svg").otherwise(".gif"))
    css = reports.plain_colours(F.lit("fill: light-dark(#fff, var(--ge-dark-color, #121212)); stroke: var(--x, #123)"))
    return read_table(spark, folder, "documents").select("doc_id", reports.svg_policy(kind, file, "raster").alias("raster"), reports.svg_policy(kind, file, "drop").alias("dropped"), css.alias("css"))


@query()
def q_clutter_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return reports.clutter_candidates(read_table(spark, folder, "posts"), "blog_id", "html")


@query()
def q_keep_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return reports.keep_candidates(read_table(spark, folder, "posts"), "seq", "html")


@query()
def q_deflated_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", reports.deflated_size("text").alias("bytes"))
