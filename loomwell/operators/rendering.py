"""Chapters, contents and package of a volume, and the zip container."""

from __future__ import annotations

import io
import posixpath
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions.text import escape_xml, joined, quote_attribute

# Fixed values of the container format.
MIMETYPE = "application/epub+zip"
CONTAINER = (
    '<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
    '<rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
)
STAMP = (2000, 1, 1, 0, 0, 0)


def _s(x: str) -> Column:
    return F.lit(x)


def page(language: Column, title: Column, body: Column) -> Column:
    """An XHTML page around a body."""
    lang = quote_attribute(language)
    head = [
        _s('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang='), lang, _s(" xml:lang="), lang,
        _s('>\n<head>\n<meta charset="utf-8"/>\n<title>'), escape_xml(title), _s('</title>\n<link rel="stylesheet" type="text/css" href="../Styles/styles.css"/>\n</head>\n<body>\n'),
    ]
    return F.concat(*head, body, _s("\n</body>\n</html>\n"))


def chapter_page(language: Column, blog: Column, item: Column, title: Column, byline: Column, url: Column, xhtml: Column, lead: Column) -> Column:
    figure = F.when(F.coalesce(lead, _s("")) != "", F.concat(_s('<figure class="lead"><img src='), quote_attribute(lead), _s(' alt=""/></figure>\n'))).otherwise("")
    line = F.when(F.coalesce(byline, _s("")) != "", F.concat(_s('<p class="byline">'), byline, _s("</p>\n"))).otherwise("")
    body = F.concat(
        _s('<section epub:type="chapter" class='), quote_attribute(F.concat(_s("blog-"), blog)), _s(" id="), quote_attribute(item), _s('>\n<header class="post-header">\n<h1>'),
        escape_xml(title), _s("</h1>\n"), line, _s('<p class="source">Originally published at <a href='), quote_attribute(url), _s(">"), escape_xml(url), _s("</a></p>\n</header>\n"),
        figure, xhtml, _s("\n</section>"),
    )
    return page(language, title, body)


def part_items(chapters: DataFrame, by: list[str], idx: str, file: Column, title: Column, meta: list[Column], excerpt: Column) -> DataFrame:
    """(by..., posts, items): the contents of a part in reading order."""
    dots = joined(" · ", *meta)
    line = F.concat(
        _s("<li><a href="), quote_attribute(file), _s(">"), escape_xml(title), _s("</a>"),
        F.when(dots != "", F.concat(_s(' <span class="date">'), escape_xml(dots), _s("</span>"))).otherwise(""),
        F.when(F.coalesce(excerpt, _s("")) != "", F.concat(_s('\n<p class="excerpt">'), escape_xml(excerpt), _s("</p>"))).otherwise(""), _s("</li>"),
    )
    lines = chapters.select(*by, F.col(idx).alias("_i"), line.alias("_l")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_l"))).alias("l"), F.count("*").alias("posts"))
    items = F.concat(_s('<ol class="part-list">\n'), F.array_join(F.transform("l", lambda x: x["_l"]), "\n"), _s("\n</ol>"))
    return lines.select(*by, "posts", items.alias("items"))


def part_page(language: Column, item: Column, label: Column, posts: Column, items: Column, kicker: Column | None = None) -> Column:
    """A part's page; with ``kicker`` that of a month inside a year."""
    count = F.concat(posts.cast("string"), F.when(posts == 1, " post").otherwise(" posts"))
    above = F.lit("") if kicker is None else F.concat(_s('<p class="kicker">'), escape_xml(kicker), _s("</p>\n"))
    kind = "part" if kicker is None else "part section"
    body = F.concat(_s(f'<section epub:type="part" class="{kind}" id='), quote_attribute(item), _s(">\n"), above, _s("<h1>"), escape_xml(label), _s('</h1>\n<p class="count">'), count, _s("</p>\n"), items, _s("\n</section>"))
    return page(language, label, body)


def play_order(points: DataFrame, by: list[str], part: str, section: str, idx: str) -> DataFrame:
    """Number navigation points after their children: chapters, then their section, then their part.

    points: one row a point with part and section places (null section for a part, null idx for a part or section).
    """
    last = 1 << 40
    order = Window.partitionBy(*by).orderBy(part, F.coalesce(section, F.lit(last)), F.coalesce(idx, F.lit(last)))
    return points.withColumn("play_order", F.row_number().over(order))


def navigation(files: list[tuple[str, str, str | None]], language: str, title: str) -> tuple[str, str]:
    """(nav.xhtml, toc.ncx) of (file, title, part) in reading order."""
    from html import escape

    esc = lambda x: escape(x, quote=True)
    entries: list[tuple[str | None, list[tuple[str, str]]]] = []
    for file, name, part in files:
        if not entries or entries[-1][0] != part:
            entries.append((part, []))
        entries[-1][1].append((file, name))
    items, points, n = [], [], 0
    for part, chapters in entries:
        inner, inner_points = [], []
        for f, t in chapters:
            n += 1
            inner.append(f'<li><a href="{esc(f)}">{esc(t)}</a></li>')
            inner_points.append(f'<navPoint id="np-{n}" playOrder="{n}"><navLabel><text>{esc(t)}</text></navLabel><content src="{esc(f)}"/></navPoint>')
        if part:
            n += 1
            items.append(f"<li><span>{esc(part)}</span><ol>{''.join(inner)}</ol></li>")
            points.append(f'<navPoint id="np-{n}" playOrder="{n}"><navLabel><text>{esc(part)}</text></navLabel><content src="{esc(chapters[0][0])}"/>{"".join(inner_points)}</navPoint>')
        else:
            items += inner
            points += inner_points
    nav = (
        f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{esc(language)}"><head><title>{esc(title)}</title></head>'
        f'<body><nav epub:type="toc"><h1>Contents</h1><ol>{"".join(items)}</ol></nav></body></html>\n'
    )
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:depth" content="{2 if any(p for p, _ in entries) else 1}"/></head><docTitle><text>{esc(title)}</text></docTitle><navMap>{"".join(points)}</navMap></ncx>\n'
    return nav, ncx


def package_document(title: str, language: str, identifier: str, files: list[str], assets: dict[str, str]) -> str:
    from html import escape

    esc = lambda x: escape(x, quote=True)
    manifest = [f'<item id="c{i}" href="{esc(f)}" media-type="application/xhtml+xml"/>' for i, f in enumerate(files)]
    manifest += [f'<item id="a{i}" href="{esc(f)}" media-type="{esc(t)}"/>' for i, (f, t) in enumerate(sorted(assets.items()))]
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(files)))
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="uid">{esc(identifier)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>{esc(language)}</dc:language></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{"".join(manifest)}</manifest>'
        f'<spine toc="ncx">{spine}</spine></package>\n'
    )


def container(title: str, language: str, identifier: str, chapters: list[tuple[str, str, str | None, str]], assets: dict[str, tuple[str, bytes]] | None = None, css: str = "") -> bytes:
    """A volume as bytes: (file, title, part, xhtml) in reading order; the mimetype comes first and uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, data, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, STAMP), data, how)
        put("mimetype", MIMETYPE, zipfile.ZIP_STORED)
        put("META-INF/container.xml", CONTAINER)
        nav, ncx = navigation([(f, t, p) for f, t, p, _ in chapters], language, title)
        put("OEBPS/nav.xhtml", nav)
        put("OEBPS/toc.ncx", ncx)
        put("OEBPS/Styles/styles.css", css)
        kinds = {"Styles/styles.css": "text/css"} | {f: t for f, (t, _) in (assets or {}).items()}
        put("OEBPS/content.opf", package_document(title, language, identifier, [c[0] for c in chapters], kinds))
        for file, _, _, xhtml in chapters:
            put(posixpath.join("OEBPS", file), xhtml)
        for file, (_, data) in (assets or {}).items():
            put(posixpath.join("OEBPS", file), data, zipfile.ZIP_STORED)
    return out.getvalue()


def package_volumes(chapters: DataFrame, by: list[str], title: str, language: str = "en") -> DataFrame:
    """(by..., title, posts, bytes, data): one container a volume.

    chapters: by..., idx, file, name, part, xhtml and a title column. A volume's pages meet in one task; the packing
    before has bounded its size by the volume's budget.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chapters.select(*by).schema) + ", title string, posts long, bytes long, data binary"

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx", kind="stable")
        name = str(group[title].iloc[0])
        rows = [(f, t, p if isinstance(p, str) and p else None, x) for f, t, p, x in zip(group["file"], group["name"], group["part"], group["xhtml"], strict=True)]
        data = container(name, language, "-".join(str(group[b].iloc[0]) for b in by), rows)
        return pd.DataFrame({**{b: [group[b].iloc[0]] for b in by}, "title": [name], "posts": [len(rows)], "bytes": [len(data)], "data": [data]})

    return chapters.select(*dict.fromkeys((*by, "idx", "file", "name", "part", "xhtml", title))).groupBy(*by).applyInPandas(pack, schema)


def stale_outputs(existing: DataFrame, written: DataFrame, book: str) -> DataFrame:
    """Files (name) of exactly this book that the last build did not write."""
    mine = existing.where(F.regexp_extract("name", r"^(.+)-(\d{8})(?:[.-][^.]+)?\.epub$", 1) == book)
    return mine.join(written.select("name").distinct(), "name", "left_anti")


__all__ = ["chapter_page", "container", "navigation", "package_volumes", "page", "part_items", "part_page", "play_order", "stale_outputs"]
