"""String, URL and label expressions; native but for the number formats of reports, so they stay in generated code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What must equal the established results.
TITLE_SEPARATORS = ("|", "–", "—", "-", "·", "»", "::", ":")
MAX_SUFFIX = 40
EXCERPT_CHARS = 220
TRACKING = r"^(utm_|fbclid|gclid|ref=)"
KICKERS = (
    (r"\b(mcp|agent|ai|llm)\b", "AI & MCP"),
    (r"\bopen[ -]?source\b", "OPEN SOURCE"),
    (r"\b(bank|financ|fintech|open finance|payments?)\b", "FINANCIAL SERVICES"),
    (r"\b(kubernetes|k8s|cloud|deploy|scal)", "PLATFORM"),
    (r"\b(secur|auth|oauth|jwt|token|revoke)", "SECURITY"),
    (r"\b(graphql|rest|grpc|openapi|schema)\b", "API DESIGN"),
)
SIZE_UNITS = {"": 1, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000}
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_part(url: Column | str, part: str) -> Column:
    """scheme, host (with port), path, query or fragment; empty where absent, null for null."""
    index = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(F.trim(col(url)), _URI, index)


def normalize_url(url: Column | str) -> Column:
    """//host/path?query without scheme, fragment, one leading www., trailing slashes and tracking pairs."""
    host = F.regexp_replace(F.lower(url_part(url, "host")), r"^www\.", "")
    path = F.regexp_replace(url_part(url, "path"), "/+$", "")
    pairs = F.filter(F.split(url_part(url, "query"), "&"), lambda q: (q != "") & ~F.lower(q).rlike(TRACKING))
    query = F.array_join(pairs, "&")
    return F.concat(F.lit("//"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def origin(url: Column | str) -> Column:
    return F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "host"))


def site_label(url: Column | str) -> Column:
    """The first label of the host that isn't www, blog or www2, in lower case; empty where there is none."""
    host = F.regexp_replace(F.lower(url_part(url, "host")), r"^[^@]*@|:\d+$", "")
    labels = F.filter(F.split(host, "[.]"), lambda p: ~p.isin("www", "blog", "www2"))
    return F.coalesce(F.get(labels, F.lit(0)), F.lit(""))


def is_site_name(tail: Column, label: Column) -> Column:
    word = F.regexp_replace(F.lower(tail), "[^a-z0-9]", "")
    return (F.length(word) >= 4) & (F.length(label) >= 4) & (word.startswith(label) | label.startswith(word))


def strip_site_suffix(title: Column | str, url: Column | str, headline: Column | str | None = None) -> Column:
    """Cut a tail that names the site, or that the page's own headline shows not to belong to the title.

    Separators are tried in their fixed order, each at its last place; a tail with its separator has at most 40
    characters. A null title stays null.
    """
    title, label = col(title), site_label(url)
    size = F.length(title)
    tries = []
    for sep in TITLE_SEPARATORS:
        from_end = F.instr(F.reverse(title), sep[::-1])
        cut = size - from_end - len(sep) + 1
        head = F.trim(F.substring(title, F.lit(1), cut))
        tail = F.trim(F.regexp_replace(F.substring(title, cut + 1, size), f"^(?:[{re.escape(sep[0])}])+", ""))
        fits = (from_end > 0) & (cut > 0) & (size - cut <= MAX_SUFFIX) & (head != "") & (tail != "")
        tries.append(F.when(fits & is_site_name(tail, label), head))
    out = F.coalesce(*tries)
    if headline is None:
        return F.coalesce(out, title)
    h1 = F.trim(F.regexp_replace(col(headline), r"\s+", " "))
    rest = F.trim(F.substring(title, F.length(h1) + 1, size))
    starts = rest.rlike("^(?:" + "|".join(re.escape(s) for s in TITLE_SEPARATORS) + ")")
    confirmed = (F.length(h1) >= 10) & (h1 != title) & title.startswith(h1) & (F.length(rest) <= MAX_SUFFIX) & starts
    return F.coalesce(out, F.when(confirmed, h1), title)


def slug(text: Column | str) -> Column:
    """Lower case, everything but letters and digits as a dash, dashes trimmed; x where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")
    return F.when(out == "", "x").otherwise(out)


def excerpt_of(excerpt: Column | str, body: Column | str) -> Column:
    """The excerpt without its ending ellipsis, else the body, cut at a space to 220 characters and an ellipsis."""
    given = F.trim(F.regexp_replace(F.coalesce(col(excerpt), F.lit("")), r"\s*(\[…\]|\[\.\.\.\]|…|\.\.\.)\s*$", ""))
    text = F.when(given != "", given).otherwise(F.coalesce(col(body), F.lit("")))
    short = F.concat(F.regexp_replace(F.substring(text, 1, EXCERPT_CHARS), " [^ ]*$", ""), F.lit("…"))
    return F.when(F.length(text) > EXCERPT_CHARS, short).otherwise(text)


def escape_xml(text: Column | str) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quote_attribute(text: Column | str) -> Column:
    """Escaped and quoted: double quotes unless the text holds one and no single quote."""
    e = escape_xml(text)
    double, single = e.contains('"'), e.contains("'")
    plain = F.concat(F.lit('"'), F.replace(e, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.when(double & ~single, F.concat(F.lit("'"), e, F.lit("'"))).otherwise(plain)


def joined(separator: str, *parts: Column) -> Column:
    """Join what is neither null nor empty."""
    return F.concat_ws(separator, *(F.when(p != "", p) for p in parts))


def kicker(title: Column | str, categories: Column | str) -> Column:
    """The first category that says something in capitals, else the first topic that the title matches, else OPINION."""
    named = F.get(F.filter(F.coalesce(col(categories), F.array().cast("array<string>")), lambda c: (F.lower(c) != "uncategorized") & (c != "")), F.lit(0))
    topic = F.coalesce(*(F.when(F.lower(col(title)).rlike(p), F.lit(k)) for p, k in KICKERS), F.lit("OPINION"))
    return F.coalesce(F.upper(named), topic)


def parse_size(text: Column | str) -> Column:
    """Bytes of 250, 2.5m, 1 GB; null for words, zero and negative numbers. Units are decimal."""
    t = F.lower(F.trim(col(text)))
    pattern = r"^(\d+(?:\.\d+)?)\s*([kmg]?)b?$"
    unit = F.regexp_extract(t, pattern, 2)
    factor = F.coalesce(*(F.when(unit == u, F.lit(n)) for u, n in SIZE_UNITS.items()))
    size = F.floor(F.regexp_extract(t, pattern, 1).try_cast("decimal(20,6)") * factor).cast("long")
    return F.when(t.rlike(pattern) & (size > 0), size)


@F.pandas_udf(T.StringType())
def _fixed(values: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.{d}f}" for v, d in zip(values, digits, strict=True)])


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits, rounded by its binary value; the JVM's formatter rounds the shortest decimal up
    instead, which differs on ties. For reports, which are small."""
    return _fixed(value.cast("double"), F.lit(digits))


def print_size(size: Column | str, digits: int = 0) -> Column:
    n = col(size).cast("double")
    return F.when(n >= 1e9, F.concat(fixed(n / 1e9, 2), F.lit(" GB"))).otherwise(F.concat(fixed(n / 1e6, digits), F.lit(" MB")))


def file_key(key: Column | str) -> Column:
    return F.regexp_replace(col(key), r"[^\p{L}\p{N}._-]", "_")


def span_text(first: Column, last: Column, joiner: str) -> Column:
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(joiner), last))


def accepts(text: Column | str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Some include pattern (if there are any) is found in the text, and no exclude pattern is."""
    ok = F.lit(True)
    if include:
        ok = ok & col(text).rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        ok = ok & ~col(text).rlike("|".join(f"(?:{p})" for p in exclude))
    return ok


def strip_patterns(text: Column | str, patterns: list[str]) -> Column:
    out = col(text)
    for p in patterns:
        out = F.trim(F.regexp_replace(out, p, ""))
    return out


def volume_label(number: Column, count: Column) -> Column:
    return F.when(count > 1, F.concat(F.lit("Vol. "), number.cast("string"), F.lit(" of "), count.cast("string"))).otherwise("")


def media_type(data: Column | str, content_type: Column | str, url: Column | str) -> Column:
    """Image type by magic bytes, then the server's word (html means no image), then the url's extension."""
    b, ct = col(data), F.lower(F.trim(F.regexp_replace(F.coalesce(col(content_type), F.lit("")), ";.*$", "")))
    head = F.hex(F.substring(b, 1, 16))
    text = F.lower(F.ltrim(F.decode(F.substring(b, 1, 256), "ISO-8859-1")))
    magic = F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
    magic = magic.when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
    magic = magic.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    magic = magic.when(text.rlike(r"^(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)?<svg"), "image/svg+xml")
    ext = F.lower(F.regexp_extract(url_part(url, "path"), r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    by_name = F.try_element_at(known, ext)
    html = text.rlike(r"^<(!doctype html|html)")
    claimed = F.when(ct.isin(*sorted(set(MEDIA_TYPES.values()))), ct).when((ct != "") & ~ct.endswith("octet-stream"), F.lit(None)).otherwise(by_name)
    return F.coalesce(magic, F.when(~html, claimed))


# Image types by file extension.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def image_key(url: Column | str) -> Column:
    """What makes two image urls the same picture: no query, no -WxH before the extension."""
    return F.regexp_replace(F.regexp_replace(col(url), r"\?.*$", ""), r"(?i)-\d+x\d+(?=\.[a-z]+$)", "")
