"""Queries of the collection operators over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.functions import dates, text
from loomwell.operators import covers, links, selection, sync, timestamps
from loomwell.session import broadcast_if_small, read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Fixed point in time of the queries that need one.
NOW = datetime(2026, 6, 1, tzinfo=UTC)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_HOST = r"lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?', 1))"
_NORM = rf"""'//' || regexp_replace({_HOST}, '^www\.', '') || coalesce(nullif(regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', ''), ''), '/')
|| coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' and not regexp_matches(lower(q), '^(utm_|fbclid|gclid|ref=)')), '&'), ''), '')"""


# ---- projections, filters, functions ----


@query(f"select seq, {_NORM} as norm from (select seq, url || '?utm_source=feed&b=2&REF=x&a=1#top' as url from refs)")
def q_normalize_url(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.concat("url", F.lit("?utm_source=feed&b=2&REF=x&a=1#top"))
    return read_table(spark, folder, "refs").select("seq", text.normalize_url(noisy).alias("norm"))


@query(f"select norm, count(distinct key) as keys from (select key, {_NORM} as norm from posts) group by norm having count(distinct key) > 1")
def q_duplicate_urls(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "posts").select("key", text.normalize_url("url").alias("norm"))
    return rows.groupBy("norm").agg(F.countDistinct("key").alias("keys")).where("keys > 1")


@query(f"select blog_id, coalesce(list_filter(string_split({_HOST}, '.'), lambda p: p not in ('www', 'blog', 'www2'))[1], '') as label, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)', 1) || '://' || {_HOST} as origin from blogs")
def q_site_label(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "blogs").select("blog_id", text.site_label("url").alias("label"), text.origin("url").alias("origin"))


@query(
    """with b as (select blog_id, title as site, list_filter(string_split(lower(regexp_extract(url, '://([^/]*)', 1)), '.'), lambda p: p not in ('www','blog','www2'))[1] as label from blogs),
    t as (select p.seq, p.title as clean, p.title || ' | ' || b.site as full_title, regexp_replace(lower(b.site), '[^a-z0-9]', '', 'g') as word, b.label from posts p join b using (blog_id))
    select seq, case when length(word) >= 4 and length(label) >= 4 and (starts_with(word, label) or starts_with(label, word)) and length(full_title) - length(clean) - 1 <= 40 and trim(clean) <> '' then trim(clean) else full_title end as title from t"""
)
def q_title_suffix(spark: SparkSession, folder: str) -> DataFrame:
    blogs = read_table(spark, folder, "blogs").select("blog_id", F.col("title").alias("site"), F.col("url").alias("site_url"))
    posts = read_table(spark, folder, "posts").select("seq", "blog_id", "title").join(broadcast_if_small(blogs), "blog_id")
    return posts.select("seq", text.strip_site_suffix(F.concat("title", F.lit(" | "), "site"), "site_url").alias("title"))


@query(r"select seq, url from refs where regexp_matches(url, '/(posts|journal)/') and not regexp_matches(url, 'moving|notes-on')")
def q_accept_urls(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "refs").where(text.accepts("url", ["/(posts|journal)/"], ["moving", "notes-on"])).select("seq", "url")


@query(r"select doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^\pL\pN]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') as slug from documents where title is not null")
def q_slug(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").where("title is not null").select("doc_id", text.slug("title").alias("slug"))


@query(
    r"""with e as (select seq, trim(regexp_replace(coalesce(excerpt, ''), '\s*(\[…\]|\[\.\.\.\]|…|\.\.\.)\s*$', '')) as given, title from posts), t as (select seq, case when given <> '' then given else coalesce(title, '') end as t from e)
    select seq, case when length(t) > 220 then regexp_replace(substr(t, 1, 220), ' [^ ]*$', '') || '…' else t end as excerpt from t"""
)
def q_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "posts").select("seq", text.excerpt_of("excerpt", "title").alias("excerpt"))


@query(
    """select seq, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as text, concat_ws(' · ', nullif('By ' || coalesce(author, ''), 'By '), nullif(blog_id, ''), nullif(array_to_string(categories, ', '), '')) as byline from posts"""
)
def q_byline(spark: SparkSession, folder: str) -> DataFrame:
    author = F.when(F.col("author") != "", F.concat(F.lit("By "), "author"))
    parts = text.joined(" · ", author, F.col("blog_id"), F.array_join("categories", ", "))
    return read_table(spark, folder, "posts").select("seq", text.escape_xml("title").alias("text"), parts.alias("byline"))


_KICKER = (
    "coalesce(upper(list_filter(coalesce({c}, []), lambda c: lower(c) <> 'uncategorized' and c <> '')[1]), case "
    + " ".join(f"when regexp_matches(lower({{t}}), '{p}') then '{k}'" for p, k in text.KICKERS)
    + " else 'OPINION' end)"
)


@query(f"select seq, {_KICKER.format(c='categories', t='title')} as kicker from posts")
def q_kicker(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "posts").select("seq", text.kicker("title", "categories").alias("kicker"))


@query("select doc_id, sha1(url) as asset, 'sm-' || substr(sha1(url), 1, 16) as key, regexp_replace(coalesce(title, ''), '[^\\pL\\pN._-]', '_', 'g') as file from documents")
def q_keys(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents")
    return d.select("doc_id", F.sha1("url").alias("asset"), F.concat(F.lit("sm-"), F.substring(F.sha1("url"), 1, 16)).alias("key"), text.file_key(F.coalesce("title", F.lit(""))).alias("file"))


@query(
    """select o_orderkey, case when regexp_matches(s, '^\\d+(\\.\\d+)?\\s*[kmg]?b?$') then cast(floor(cast(regexp_extract(s, '^(\\d+(\\.\\d+)?)', 1) as decimal(20,6)) * case regexp_extract(s, '([kmg]?)b?$', 1) when 'k' then 1000 when 'm' then 1000000 when 'g' then 1000000000 else 1 end) as bigint) end as bytes
    from (select o_orderkey, lower(cast(o_orderkey % 97 + 1 as varchar) || case o_orderkey % 5 when 0 then ' MB' when 1 then 'k' when 2 then '.5 g' when 3 then '' else ' apples' end) as s from orders)"""
)
def q_parse_size(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    unit = F.when(k % 5 == 0, " MB").when(k % 5 == 1, "k").when(k % 5 == 2, ".5 g").when(k % 5 == 3, "").otherwise(" apples")
    return read_table(spark, folder, "orders").select("o_orderkey", text.parse_size(F.concat((k % 97 + 1).cast("string"), unit)).alias("bytes"))


@query(
    """select doc_id, strftime(published, '%Y') as year, strftime(published, '%Y-%m') as month, strftime(published, '%B %Y') as month_label, strftime(published, '%-d %B %Y') as day, strftime(published, '%Y%m%d') as issue, strftime(published, '%Y-%m-%dT%H:%M:%S') || '+00:00' as gmt, strftime(published, '%Y-%m-%d') || 'T23:59:59' as until
    from (select doc_id, published at time zone 'UTC' as published from documents where published is not null)"""
)
def q_date_labels(spark: SparkSession, folder: str) -> DataFrame:
    iso = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss")
    cols = [dates.local_year(iso).alias("year"), dates.local_month(iso).alias("month"), dates.month_label(iso).alias("month_label"), dates.long_date("published").alias("day"), dates.issue_of("published").alias("issue"), dates.gmt(iso).alias("gmt"), dates.api_day(iso, True).alias("until")]
    return read_table(spark, folder, "documents").where("published is not null").select("doc_id", *cols)


@query()
def q_local_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Year and month of each post on the clock its date was written with, in whatever notation."""
    p = timestamps.post_clocks(read_table(spark, folder, "posts").select("seq", "blog_id", "date"), read_table(spark, folder, "blogs"), "date")
    return p.select("seq", dates.wall_year("wall_us").alias("year"), dates.wall_month("wall_us").alias("month"), F.timestamp_micros("utc_us").alias("at"), dates.plausible("date").alias("plausible"))


@query("select seq, list_filter(categories, lambda c: not regexp_matches(lower(c), '^(news|general|blog)$')) as categories, trim(regexp_replace(trim(regexp_replace(title, '^(Notes on|Moving)', '')), '[0-9.]+$', '')) as title from posts")
def q_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.filter("categories", lambda c: ~F.lower(c).rlike("^(news|general|blog)$"))
    return read_table(spark, folder, "posts").select("seq", kept.alias("categories"), text.strip_patterns("title", ["^(Notes on|Moving)", "[0-9.]+$"]).alias("title"))


_TYPES = {"FFD8FFE000104A46": "image/jpeg", "89504E470D0A1A0A0000": "image/png", "47494638396101": "image/gif", "52494646240000005745425056503820": "image/webp", "3C21444F43545950452068746D6C3E": None}


@query(
    "select doc_id, case doc_id % 6 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/gif' when 3 then 'image/webp' when 4 then null else 'image/png' end as type from documents"
)
def q_media_types(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id") % 6
    data = F.unhex(F.coalesce(*(F.when(n == i, F.lit(h)) for i, h in enumerate(_TYPES)), F.lit("00")))
    return read_table(spark, folder, "documents").select("doc_id", text.media_type(data, F.lit("application/octet-stream"), F.concat("url", F.lit("/a.png?x=1"))).alias("type"))


@query("select seq, case when featured_image is null or featured_image = '' or regexp_replace(regexp_replace(featured_image, '\\?.*$', ''), '-\\d+x\\d+(\\.[a-z]+)$', '\\1') = regexp_replace(url, '\\?.*$', '') then null else featured_image end as lead from posts")
def q_lead_image(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "posts").select("seq", links.lead_image("featured_image", F.array("url")).alias("lead"))


# ---- selection, order, groups, volumes ----

_UNDATED = "case when o_orderkey % 11 = 0 then null else o_orderdate end"


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").withColumn("ts", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))


@query(f"select o_orderkey from (select o_orderkey, {_UNDATED} as ts from orders) where ts is null or (ts >= timestamp '1996-05-15' and ts <= timestamp '1998-12-31')")
def q_window_undated(spark: SparkSession, folder: str) -> DataFrame:
    return _dated(spark, folder).where(dates.within("ts", F.lit("1996-05-15").cast("timestamp"), F.lit("1998-12-31").cast("timestamp"))).select("o_orderkey")


@query("select event_id from events where ts >= (timestamp '2024-01-20 00:00:00' - interval 7 day) and ts <= timestamp '2024-01-20 00:00:00'")
def q_rolling_window(spark: SparkSession, folder: str) -> DataFrame:
    end = F.lit("2024-01-20 00:00:00").cast("timestamp")
    since = dates.resolve_date("1w", datetime(2024, 1, 20, tzinfo=UTC))
    return read_table(spark, folder, "events").where(dates.within("ts", F.lit(since.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"), end)).select("event_id")


def _ordered(direction: str) -> str:
    order = "ts desc nulls last, lower(o_orderpriority) desc, o_orderkey" if direction == "desc" else "ts asc nulls first, lower(o_orderpriority), o_orderkey"
    return f"select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by {order}) as idx from (select *, {_UNDATED} as ts from orders)"


@query(_ordered("desc"))
def q_order_desc(spark: SparkSession, folder: str) -> DataFrame:
    return selection.select_posts(_dated(spark, folder), "o_custkey", "ts", "o_orderpriority", "o_orderkey").select("o_orderkey", "o_custkey", F.col("idx").cast("long"))


@query(_ordered("asc"))
def q_order_asc(spark: SparkSession, folder: str) -> DataFrame:
    return selection.select_posts(_dated(spark, folder), "o_custkey", "ts", "o_orderpriority", "o_orderkey", newest_first=False).select("o_orderkey", "o_custkey", F.col("idx").cast("long"))


@query(f"select o_custkey, o_orderkey, idx from ({_ordered('desc')}) where idx <= 3")
def q_newest_n(spark: SparkSession, folder: str) -> DataFrame:
    return selection.select_posts(_dated(spark, folder), "o_custkey", "ts", "o_orderpriority", "o_orderkey", most=3).select("o_custkey", "o_orderkey", F.col("idx").cast("long"))


_CHAPTERS = "select doc_id, source, title, n_chars, url, published at time zone 'UTC' as published, row_number() over (partition by source order by published desc nulls last, lower(title) desc nulls last, doc_id) as idx from documents"


def _chapters(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents").select("doc_id", "source", "title", "n_chars", "url", "published")
    return selection.select_posts(d, "source", "published", "title", "doc_id")


@query(f"select doc_id, source, 'ch-' || lpad(cast(idx as varchar), 4, '0') || '.xhtml' as file from ({_CHAPTERS})")
def q_chapter_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _chapters(spark, folder).select("doc_id", "source", F.format_string("ch-%04d.xhtml", "idx").alias("file"))


@query(f"select source, part, min(idx) as first_idx, count(*) as posts, row_number() over (partition by source order by min(idx)) as part_no from (select source, idx, coalesce(strftime(published, '%Y'), 'Undated') as part from ({_CHAPTERS})) group by source, part")
def q_group_year(spark: SparkSession, folder: str) -> DataFrame:
    out = selection.group_parts(_chapters(spark, folder), "source", F.coalesce(F.date_format("published", "yyyy"), F.lit("Undated")))
    return out.select("source", "part", F.col("first_idx").cast("long"), "posts", F.col("part_no").cast("long"))


@query("select source, coalesce(y, 'all') as year, coalesce(m, 'all') as month, n from (select source, y, m, count(*) as n from (select source, coalesce(strftime(published at time zone 'UTC', '%Y'), 'Undated') as y, coalesce(strftime(published at time zone 'UTC', '%Y-%m'), 'Undated') as m from documents) group by source, rollup (y, m))")
def q_nested_sections(spark: SparkSession, folder: str) -> DataFrame:
    dated = lambda form: F.coalesce(F.date_format("published", form), F.lit("Undated"))
    d = read_table(spark, folder, "documents").select("source", dated("yyyy").alias("y"), dated("yyyy-MM").alias("m"))
    sets = d.groupingSets([["source", "y", "m"], ["source", "y"], ["source"]], "source", "y", "m").agg(F.count("*").alias("n"))
    return sets.select("source", F.coalesce("y", F.lit("all")).alias("year"), F.coalesce("m", F.lit("all")).alias("month"), "n")


_BUDGET = 20_000
_PACKED = f"""with recursive c as materialized ({_CHAPTERS}), f as (
select source, idx, n_chars as used, 1 as bin from c where idx = 1
union all select c.source, c.idx, case when f.used + c.n_chars > {_BUDGET} then c.n_chars else f.used + c.n_chars end, case when f.used + c.n_chars > {_BUDGET} then f.bin + 1 else f.bin end from f join c on c.source = f.source and c.idx = f.idx + 1)"""


@query(_PACKED + " select source, idx, cast(bin as bigint) as bin from f")
def q_pack_size(spark: SparkSession, folder: str) -> DataFrame:
    return selection.pack_in_order(_chapters(spark, folder), ["source"], "idx", "n_chars", _BUDGET)


@query(
    _PACKED
    + """, v as (select source, bin, min(f.idx) as first_idx, count(*) as posts, sum(n_chars) as bytes, max(case when n_chars > 20000 then 1 else 0 end) = 1 as oversize from f join c using (source, idx) group by source, bin), n as (select *, count(*) over (partition by source) as volumes, row_number() over (partition by source order by first_idx) as volume from v)
    select source, volume, volumes, posts, cast(bytes as bigint) as bytes, oversize, case when volumes > 1 then 'Vol. ' || volume || ' of ' || volumes else '' end as label, case when volumes > 1 then 'vol' || volume else '' end as slug, case when volumes > 1 then source || ', Vol. ' || volume else source end as title from n"""
)
def q_volumes(spark: SparkSession, folder: str) -> DataFrame:
    chapters = _chapters(spark, folder).withColumn("idx", F.col("idx").cast("long"))
    packed = selection.pack_in_order(chapters, ["source"], "idx", "n_chars", _BUDGET).join(chapters.select("source", "idx", "n_chars"), ["source", "idx"])
    per = packed.groupBy("source", F.lit("").alias("period"), "bin").agg(F.min("idx").alias("first_idx"), F.count("*").alias("posts"), F.sum("n_chars").alias("bytes"), (F.max("n_chars") > _BUDGET).alias("oversize"))
    named = selection.volume_names(per, "source", "period", "bin", "first_idx", F.col("source"), "size")
    return named.select("source", F.col("volume").cast("long"), "volumes", "posts", "bytes", "oversize", "label", "slug", "title")


_YEARS = f"""with recursive c as materialized (select *, coalesce(strftime(published, '%Y'), 'Undated') as period, row_number() over (partition by source, coalesce(strftime(published, '%Y'), 'Undated') order by idx) as k from ({_CHAPTERS})), f as (
select source, period, idx, k, n_chars as used, 1 as bin from c where k = 1
union all select c.source, c.period, c.idx, c.k, case when f.used + c.n_chars > {_BUDGET} then c.n_chars else f.used + c.n_chars end, case when f.used + c.n_chars > {_BUDGET} then f.bin + 1 else f.bin end from f join c on c.source = f.source and c.period = f.period and c.k = f.k + 1)"""


@query(
    _YEARS
    + """, v as (select source, period, bin, min(idx) as first_idx, count(*) as posts from f group by all), n as (select *, max(bin) over (partition by source, period) as parts, row_number() over (partition by source order by first_idx) as volume from v)
    select source, volume, posts, case when parts = 1 then period else period || ', part ' || bin || ' of ' || parts end as label, case when parts = 1 then period else period || '-part' || bin end as slug from n"""
)
def q_volumes_by_year(spark: SparkSession, folder: str) -> DataFrame:
    chapters = _chapters(spark, folder).withColumn("idx", F.col("idx").cast("long")).withColumn("period", F.coalesce(F.date_format("published", "yyyy"), F.lit("Undated")))
    packed = selection.pack_in_order(chapters, ["source", "period"], "idx", "n_chars", _BUDGET)
    per = packed.groupBy("source", "period", "bin").agg(F.min("idx").alias("first_idx"), F.count("*").alias("posts"))
    named = selection.volume_names(per, "source", "period", "bin", "first_idx", F.col("source"), "year")
    return named.select("source", F.col("volume").cast("long"), "posts", "label", "slug")


@query(
    """with recursive a as materialized (select o_custkey, l_orderkey, l_partkey, max(cast(l_quantity as bigint)) as s from lineitem join orders on o_orderkey = l_orderkey group by all),
    o as materialized (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as idx from orders),
    x as materialized (select o.o_custkey, o.idx, coalesce(map_from_entries(list((a.l_partkey, a.s)) filter (a.l_partkey is not null)), map {}) as m from o left join a on a.o_custkey = o.o_custkey and a.l_orderkey = o.o_orderkey group by all),
    f as (select o_custkey, idx, 1 as bin, 10 + coalesce(list_sum(map_values(m)), 0) as used, map_keys(m) as seen from x where idx = 1
    union all select x.o_custkey, x.idx, case when over then f.bin + 1 else f.bin end, case when over then 10 + coalesce(list_sum(map_values(x.m)), 0) else f.used + add end, case when over then map_keys(x.m) else list_concat(f.seen, map_keys(x.m)) end
    from f join x on x.o_custkey = f.o_custkey and x.idx = f.idx + 1, lateral (select 10 + coalesce(list_sum(list_transform(list_filter(map_entries(x.m), lambda e: not list_contains(f.seen, e.key)), lambda e: e.value)), 0) as add), lateral (select f.used + add > 400 as over))
    select o_custkey, idx, cast(bin as bigint) as bin from f"""
)
def q_pack_shared(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.withColumn("idx", idx)
    items = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_quantity").cast("long").alias("s"))
    assets = rows.join(items, "o_orderkey").select("o_custkey", "idx", "l_partkey", "s")
    return selection.pack_with_shared(rows.withColumn("w", F.lit(10)), ["o_custkey"], "idx", "w", assets, "l_partkey", "s", 400)


_COVER = _KICKER.format(c="null::varchar[]", t="title")


@query(
    f"""with d as (select source, doc_id, title, published, {_COVER} as kicker from (select source, doc_id, published, case when doc_id % 5 = 0 then t || ': ' || t || ': ' || t else t end as title from (select *, coalesce(title, 'Untitled') as t from documents))),
    a as (select * from d where length(title) <= 80 qualify row_number() over (partition by source, kicker order by published desc nulls last, doc_id) = 1),
    s as (select source, title, kicker, row_number() over (partition by source order by published desc nulls last, doc_id) as line from a qualify line <= 6),
    u as (select source, title, max(published) as p, min(doc_id) as t from (select *, row_number() over (partition by source, title order by published desc nulls last, doc_id) as r from d where length(title) <= 80) where r = 1 and (source, title) not in (select source, title from s) group by all),
    m as (select u.source, u.title, 'FEATURE' as kicker, row_number() over (partition by u.source order by p desc nulls last, t) + coalesce((select count(*) from s where s.source = u.source), 0) as line from u)
    select b.source, g.line, coalesce(x.kicker, '') as kicker, coalesce(x.title, '') as title from (select distinct source from d) b cross join (select cast(unnest(range(1, 7)) as int) as line) g left join (select * from s union all by name select * from m where line <= 6) x on x.source = b.source and x.line = g.line"""
)
def q_cover_lines(spark: SparkSession, folder: str) -> DataFrame:
    t = F.coalesce("title", F.lit("Untitled"))
    d = read_table(spark, folder, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat_ws(": ", t, t, t)).otherwise(t).alias("title"), "published")
    d = d.withColumn("kicker", text.kicker("title", F.lit(None).cast("array<string>")))
    return covers.cover_lines(d, "source", "published", "title", "kicker", "doc_id", 6)


# ---- synchronising ----

_SPLIT = "timestamp '2024-01-16 00:00:00'"
_LISTED = f"listed as (select user_id as key, arg_max(event_type, (ts, event_id)) as modified from events where ts >= {_SPLIT} group by 1), cached as (select user_id as key, arg_max(event_type, (ts, event_id)) as modified from events where ts < {_SPLIT} group by 1)"


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, folder, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    pick = lambda d: d.groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("modified"))
    return pick(e.where(F.col("ts") >= cut)), pick(e.where(F.col("ts") < cut))


@query(f"with {_LISTED} select l.key, l.modified, case when c.key is null then 'new' when l.modified <> c.modified then 'changed' else 'same' end as status from listed l left join cached c using (key)")
def q_sync_status(spark: SparkSession, folder: str) -> DataFrame:
    return sync.needs_fetch(*_snapshots(spark, folder), ["key"])


@query(
    f"""with {_LISTED}, s as (select l.key % 7 as source, count(*) filter (c.key is null) as new, count(*) filter (l.modified <> c.modified) as changed, count(*) filter (l.modified = c.modified) as same from listed l left join cached c using (key) group by 1),
    g as (select key % 7 as source, count(*) as stale from cached where key not in (select key from listed) group by 1)
    select source, coalesce(new, 0) as new, coalesce(changed, 0) as changed, coalesce(same, 0) as same, cast(0 as bigint) as removed, coalesce(stale, 0) as stale from s full join g using (source)"""
)
def q_sync_counters(spark: SparkSession, folder: str) -> DataFrame:
    listed, cached = _snapshots(spark, folder)
    status = sync.needs_fetch(listed, cached, ["key"]).withColumn("source", F.col("key") % 7)
    return sync.counters(status, sync.vanished(listed, cached, ["key"]).withColumn("source", F.col("key") % 7), "source")


@query(f"with {_LISTED} select key, modified from cached where key not in (select key from listed) union all select key, modified from listed")
def q_upsert(spark: SparkSession, folder: str) -> DataFrame:
    listed, cached = _snapshots(spark, folder)
    return sync.upsert(cached, listed, ["key"])


@query(f"with {_LISTED} select key from cached where key not in (select key from listed)")
def q_vanished(spark: SparkSession, folder: str) -> DataFrame:
    listed, cached = _snapshots(spark, folder)
    return sync.vanished(listed, cached, ["key"]).select("key")


@query("select blog_id, key, arg_max(seq, (fetched_at, seq)) as seq from posts group by 1, 2")
def q_latest_version(spark: SparkSession, folder: str) -> DataFrame:
    return sync.latest(read_table(spark, folder, "posts").select("blog_id", "key", "fetched_at", "seq"), ["blog_id", "key"], "fetched_at", "seq").select("blog_id", "key", "seq")


@query("select d.doc_id, coalesce(b.min_chars, 150) = 0 or d.n_chars >= coalesce(b.min_chars, 150) as passed from documents d left join blogs b on b.blog_id = d.source")
def q_quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    blogs = broadcast_if_small(read_table(spark, folder, "blogs").select(F.col("blog_id").alias("source"), "min_chars"))
    d = read_table(spark, folder, "documents").select("doc_id", "source", "n_chars").join(blogs, "source", "left")
    ok, bad = sync.gate(d, F.col("n_chars"), F.coalesce("min_chars", F.lit(150)))
    return ok.select("doc_id", F.lit(True).alias("passed")).unionByName(bad.select("doc_id", F.lit(False).alias("passed")))


@query("select event_id, event_type <> 'click' and (event_type = 'purchase' or coalesce(timestamp '2024-01-20 00:00:00' - interval 3 day < ts, false)) as blocked from events")
def q_asset_retry(spark: SparkSession, folder: str) -> DataFrame:
    error = F.when(F.col("event_type") != "click", F.col("event_type"))
    blocked = sync.blocks_retry(error, F.col("event_type") == "purchase", F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return read_table(spark, folder, "events").select("event_id", blocked.alias("blocked"))


@query("select distinct r_name as book from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey where c_acctbal > 9990 union select r_name from region where r_name not like 'A%'")
def q_books_to_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = read_table(spark, folder, "nation"), read_table(spark, folder, "region")
    books = broadcast_if_small(region).join(nation, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("book"), F.col("n_nationkey").alias("blog"))
    changed = read_table(spark, folder, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("blog"))
    return sync.to_rebuild(books, changed, region.where("r_name like 'A%'").select(F.col("r_name").alias("book")))


@query("select source, outcome, count(*) as n, min(url) as example from (select source, url, coalesce(lang, 'none') as outcome from documents) group by 1, 2")
def q_failure_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents").select("source", "url", F.coalesce("lang", F.lit("none")).alias("outcome"))
    return sync.failure_summary(d, "source")


@query(
    """with e as (select user_id, arg_max(event_type, (ts, event_id)) as last_type, count(*) as events, min(ts) as first_ts, max(ts) as last_ts from events group by 1) select user_id, last_type, events, strftime(first_ts, '%Y-%m-%d') as first_day, strftime(last_ts, '%Y-%m-%d') as last_day from e"""
)
def q_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    per = read_table(spark, folder, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("events"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.select("user_id", "last_type", "events", F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("b", "yyyy-MM-dd").alias("last_day"))


# ---- links, assets, reports ----


@query(
    f"""with c as (select source, idx, url, n_chars, 'ch-' || lpad(cast(idx as varchar), 4, '0') as file from ({_CHAPTERS})), n as (select source, {_NORM} as norm, arg_max(file, idx) as target from c group by all),
    l as (select source, file, {_NORM} as norm, url from (select source, file, url || '/?utm_medium=x' as url from c))
    select l.source, l.file, n.target from l left join n using (source, norm)"""
)
def q_internal_links(spark: SparkSession, folder: str) -> DataFrame:
    c = _chapters(spark, folder).withColumn("file", F.format_string("ch-%04d", "idx"))
    targets = links.link_targets(c, ["source"], "url", "file", "idx")
    refs = c.select("source", "file", F.concat("url", F.lit("/?utm_medium=x")).alias("href"))
    return links.resolve_links(refs, targets, ["source"], "href").select("source", "file", "target")


@query(
    _PACKED
    + """, p as (select c.source || '/' || c.idx as file, c.source || '/' || (c.idx + 7) as target, f.source || f.bin as volume, c.url from f join c using (source, idx))
    select a.file, a.target, case when a.volume = b.volume then a.target else b.url end as href from p a left join p b on b.file = a.target"""
)
def q_relink_outside(spark: SparkSession, folder: str) -> DataFrame:
    chapters = _chapters(spark, folder).withColumn("idx", F.col("idx").cast("long"))
    packed = selection.pack_in_order(chapters, ["source"], "idx", "n_chars", _BUDGET).join(chapters.select("source", "idx", "url"), ["source", "idx"])
    name = lambda k: F.concat("source", F.lit("/"), (F.col("idx") + k).cast("string"))
    placed = packed.select(name(0).alias("file"), F.concat("source", F.col("bin").cast("string")).alias("volume"), "url")
    refs = packed.select(name(0).alias("file"), name(7).alias("target"))
    return links.relink_outside(refs, placed).select("file", "target", "href")


@query("select p.blog_id, p.seq as id, t.seq as other from posts p join (select blog_id, seq, title from posts where length(title) > 25) t on t.blog_id = p.blog_id and t.seq <> p.seq and contains(p.html, t.title) group by all")
def q_bleed(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "posts")
    return links.bleeding_titles(p.select("blog_id", F.col("seq").alias("id"), F.col("html").alias("text")), p.select("blog_id", F.col("seq").alias("id"), "title"), "blog_id")


@query("select source, doc_id, cast(floor((row_number() over (partition by source order by doc_id) - 1) / 100) as bigint) as batch from documents")
def q_batches(spark: SparkSession, folder: str) -> DataFrame:
    return links.batch_ids(read_table(spark, folder, "documents").select("source", "doc_id"), "source", "doc_id", 100)


@query("with n as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, greatest(1, floor(count(*) over (partition by source) / 5)) as step from documents) select source, doc_id from n where i % step = 0 and i / step < 5")
def q_strided_sample(spark: SparkSession, folder: str) -> DataFrame:
    return links.strided(read_table(spark, folder, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("select nation, arg_max(kind, (n, -rank)) as picked from (select c_nationkey as nation, case c_mktsegment when 'BUILDING' then 'wordpress' when 'MACHINERY' then 'feed' else 'sitemap' end as kind, case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end as rank, count(*) as n from customer group by all) group by 1")
def q_pick_source(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "wordpress").when(F.col("c_mktsegment") == "MACHINERY", "feed").otherwise("sitemap")
    counts = read_table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation"), kind.alias("kind")).agg(F.count("*").alias("n"))
    return links.pick_source(counts, "nation", "kind", "n", {"wordpress": 0, "feed": 1, "sitemap": 2})


@query("select blog_id, depth, count(*) as n from (select blog_id, len(list_filter(string_split(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/'), lambda s: s <> '')) as depth from refs) group by 1, 2")
def q_depth_histogram(spark: SparkSession, folder: str) -> DataFrame:
    depth = F.size(F.filter(F.split(text.url_part("url", "path"), "/"), lambda s: s != ""))
    return read_table(spark, folder, "refs").groupBy("blog_id", depth.cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("select blog_id, prefix, n from (select blog_id, prefix, count(*) as n, row_number() over (partition by blog_id order by count(*) desc, prefix) as r from (select blog_id, array_to_string(list_filter(string_split(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/'), lambda s: s <> '')[1:2], '/') as prefix from refs) group by 1, 2) where r <= 8")
def q_prefix_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.filter(F.split(text.url_part("url", "path"), "/"), lambda s: s != "")
    per = read_table(spark, folder, "refs").groupBy("blog_id", F.array_join(F.slice(parts, 1, 2), "/").alias("prefix")).agg(F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy("blog_id").orderBy(F.desc("n"), "prefix"))
    return per.withColumn("_r", top).where("_r <= 8").select("blog_id", "prefix", "n")


@query("select user_id, event_id, missing from (select user_id, event_id, count(*) as missing from (select user_id, event_type, min(event_id) as event_id from events group by all) group by all)")
def q_first_missing(spark: SparkSession, folder: str) -> DataFrame:
    return links.first_missing(read_table(spark, folder, "events"), ["user_id"], "event_id", "event_type")


@query("select blog_id, count(distinct key) as posts, min(fetched_at) as first_fetch, max(fetched_at) as last_fetch, count(*) filter (featured_image is not null) as with_image, count(*) filter (featured_image is null) as without_image from posts group by 1")
def q_cache_status(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "posts")
    return p.groupBy("blog_id").agg(F.countDistinct("key").alias("posts"), F.min("fetched_at").alias("first_fetch"), F.max("fetched_at").alias("last_fetch"), F.count("featured_image").alias("with_image"), F.count_if(F.col("featured_image").isNull()).alias("without_image"))


@query(
    """with b as (select o_custkey as id, count(*) as files, sum(cast(round(o_totalprice * 100) as bigint)) as bytes, strftime(min(o_orderdate), '%Y') as a, strftime(max(o_orderdate), '%Y') as z from orders group by 1), k as (select c_custkey as id, c_name as kept from customer)
    select id, coalesce(b.files, 0) as files, cast(coalesce(b.bytes, 0) as bigint) as bytes, case when b.id is null then 'kept' when k.id is null then 'unknown' else 'built' end as state, case when a = z then a else a || ' – ' || z end as span from b full join k using (id)"""
)
def q_release_notes(spark: SparkSession, folder: str) -> DataFrame:
    built = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("files"), F.date_format(F.min("o_orderdate"), "yyyy").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy").alias("z"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("bytes"), F.lit(True).alias("_b"))
    kept = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit(True).alias("_k"))
    both = built.join(kept, "id", "full")
    state = F.when(F.col("_b").isNull(), "kept").when(F.col("_k").isNull(), "unknown").otherwise("built")
    zero = F.lit(0).cast("long")
    return both.select("id", F.coalesce("files", zero).alias("files"), F.coalesce("bytes", zero).alias("bytes"), state.alias("state"), text.span_text(F.col("a"), F.col("z"), " – ").alias("span"))


@query("select source, count(*) as posts, count(distinct lang) as langs, sum(n_chars) filter (n_chars >= 1000) as long_chars, string_agg(distinct coalesce(lang, '-'), ',' order by coalesce(lang, '-')) as lang_list from documents group by 1")
def q_build_report(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents")
    lang = F.array_join(F.sort_array(F.collect_set(F.coalesce("lang", F.lit("-")))), ",")
    return d.groupBy("source").agg(F.count("*").alias("posts"), F.countDistinct("lang").alias("langs"), F.sum(F.when(F.col("n_chars") >= 1000, F.col("n_chars"))).alias("long_chars"), lang.alias("lang_list"))


@query("select source, title, urls from (select source, title, sum(c) as n, string_agg(url, ' ' order by i) as urls from (select source, title, url, min(doc_id) as i, count(*) as c from documents where title is not null group by all) group by 1, 2) where n > 1")
def q_ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents").where("title is not null").groupBy("source", "title", "url").agg(F.min("doc_id").alias("i"), F.count("*").alias("c"))
    per = d.groupBy("source", "title").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("i", "url"))).alias("l"))
    return per.where("n > 1").select("source", "title", F.array_join(F.transform("l", lambda x: x["url"]), " ").alias("urls"))
