"""Timestamps in many notations, read as one instant.

``parse_instant`` is plain Python so that the dictionary operator can call it once per distinct value.
"""

from __future__ import annotations

import calendar
import re
import unicodedata
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names and common short forms by language, folded to plain lower-case letters.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia wrzesnia pazdziernika listopada grudnia",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
MORE_MONTHS = {
    "de": "janner feber maerz 0 0 0 0 0 0 0 0 0",
    "es": "0 0 0 0 0 0 0 0 setiembre 0 0 0",
    "pl": "styczen luty marzec kwiecien maj czerwiec lipiec sierpien wrzesien pazdziernik listopad grudzien",
    "ru": "январь февраль март апрель маи июнь июль август сентябрь октябрь ноябрь декабрь",
}
# Zone abbreviations, minutes east of UTC. IST, CST and BST follow the usage in mail headers and news feeds.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570,
    "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
FIRST_YEAR = 1995

_TIME = r"(?P<h>\d{1,2})(?:[:.h](?P<mi>\d{2}))?(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_ISO = re.compile(r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})[-/.](?P<d>\d{1,2})(?:[T\s,]+" + _TIME + r")?\s*(?P<rest>.*)", re.S)
_BASIC = re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:T?(?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?)?\s*(?P<rest>\D.*)?", re.S)
_NUMERIC = re.compile(r"(?P<a>\d{1,2})[-/.]\s?(?P<b>\d{1,2})[-/.]\s?(?P<y>\d{4})(?:[T\s,]+(?:at|um|à|a las|o|в)?\s*" + _TIME + r")?\s*(?P<rest>.*)", re.S)
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\s+")
_OFFSET = re.compile(r"(?:gmt|utc)?\s*([+-−])(\d{1,2}):?(\d{2})?", re.I)


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).replace("ł", "l")


def _names() -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for table in (MONTHS, MORE_MONTHS):
        for lang, row in table.items():
            for i, name in enumerate(row.split(), 1):
                if name != "0":
                    out.setdefault(lang, {})[_plain(name)] = i
    return out


_MONTH_BY_LANG = _names()


def _month(word: str, lang: str) -> int | None:
    """A month's number: the locale's names first, then any language whose reading is not contradicted by another."""
    word = _plain(word).rstrip(".")
    for tables in ([_MONTH_BY_LANG.get(lang, {})], [_MONTH_BY_LANG["en"]], list(_MONTH_BY_LANG.values())):
        exact = {t[word] for t in tables if word in t}
        if len(exact) == 1:
            return exact.pop()
        if len(word) >= 3:
            near = {n for t in tables for name, n in t.items() if name.startswith(word)}
            if len(near) == 1:
                return near.pop()
    return None


@lru_cache(512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _rest(rest: str) -> tuple[str | None, int | None, ZoneInfo | None] | None:
    """What follows the clock time: (am or pm, offset in minutes, named zone), or None if it cannot be read."""
    half, offset, zone = None, None, None
    rest = rest.strip()
    if m := re.match(r"([ap])\.?\s?m\.?(?![^\W\d_])", rest, re.I):
        half, rest = m[1].lower(), rest[m.end() :].strip()
    if m := re.match(r"(?:uhr|hs?|hrs|г\.?|ч)(?![^\W\d_])\.?", rest, re.I):
        rest = rest[m.end() :].strip()
    if m := _OFFSET.match(rest):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 18 or minutes > 59:
            return None
        offset, rest = (1 if m[1] == "+" else -1) * (hours * 60 + minutes), rest[m.end() :].strip()
    if m := re.match(r"\[([A-Za-z0-9_+/-]+)\]", rest):
        zone, rest = _zone(m[1]), rest[m.end() :].strip()
    elif m := re.match(r"\(?([A-Za-z]+(?:/[A-Za-z_+-]+)+)\)?", rest):
        zone, rest = _zone(m[1]), rest[m.end() :].strip()
    elif m := re.match(r"\(?([A-Za-z]{1,5})\)?(?![A-Za-z])", rest):
        if m[1].lower() not in ABBREVIATIONS:
            return None
        offset = ABBREVIATIONS[m[1].lower()] if offset is None else offset
        rest = rest[m.end() :].strip()
    return None if rest.strip(" .,") else (half, offset, zone)


def _micros(y: int, mo: int, d: int, g: dict[str, str | None], tail: str, tz: str | None) -> tuple[int, int] | None:
    parts = _rest(tail)
    if parts is None or y < FIRST_YEAR:
        return None
    half, offset, zone = parts
    h, mi, s = (int(g.get(k) or 0) for k in ("h", "mi", "s"))
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (half == "p")
    us = int(((g.get("f") or "") + "000000")[:6])
    over = timedelta(days=1) if (h, mi, s, us) == (24, 0, 0, 0) else timedelta(0)
    if over:
        h = 0
    if s == 60:
        s, over = 59, over + timedelta(seconds=1)
    try:
        wall = datetime(y, mo, d, h, mi, s, us) + over
    except (ValueError, OverflowError):
        return None
    if offset is not None:
        at = wall.replace(tzinfo=UTC) - timedelta(minutes=offset)
    else:
        # fold=0: the first of two equal clock times, and the offset before a gap
        at = wall.replace(tzinfo=zone or _zone(tz or "UTC") or UTC, fold=0).astimezone(UTC)
    return tuple(calendar.timegm(x.timetuple()) * 1_000_000 + x.microsecond for x in (at, wall))


def parse_instant(raw: str | None, tz: str | None, locale: str | None) -> int | None:
    """Microseconds since 1970 in UTC, or None for null, empty, unreadable values and years before 1995."""
    found = parse_clock(raw, tz, locale)
    return found[0] if found else None


def parse_clock(raw: str | None, tz: str | None, locale: str | None) -> tuple[int, int] | None:
    """(instant, wall clock as written) in microseconds, or None; a plain number's wall clock is that of ``tz``.

    A stated offset, zone or abbreviation counts; without one the clock is ``tz``'s. Digits alone are seconds (10) or
    milliseconds (13). In numeric dates the month stands first only for en-US; month names follow ``locale``.
    """
    text = unicodedata.normalize("NFKC", raw or "").replace("−", "-").strip()
    if not text:
        return None
    if re.fullmatch(r"\d{10}|\d{13}", text):
        us = int(text) * (1_000_000 if len(text) == 10 else 1000)
        if us < calendar.timegm((FIRST_YEAR, 1, 1, 0, 0, 0)) * 1_000_000:
            return None
        wall = datetime.fromtimestamp(us // 1_000_000, _zone(tz or "UTC") or UTC)
        return us, calendar.timegm(wall.timetuple()) * 1_000_000 + us % 1_000_000
    lang, _, region = (locale or "en-US").replace("_", "-").partition("-")
    if m := _ISO.fullmatch(text):
        return _micros(int(m["y"]), int(m["mo"]), int(m["d"]), m.groupdict(), m["rest"] or "", tz)
    if m := _BASIC.fullmatch(text):
        return _micros(int(m["y"]), int(m["mo"]), int(m["d"]), m.groupdict(), m["rest"] or "", tz)
    if m := _NUMERIC.fullmatch(text):
        a, b = int(m["a"]), int(m["b"])
        mo, d = (a, b) if region.upper() in ("US", "PH", "") and lang == "en" and "." not in text[:6] else (b, a)
        return _micros(int(m["y"]), mo, d, m.groupdict(), m["rest"] or "", tz)
    return _worded(text, lang, tz)


def _worded(text: str, lang: str, tz: str | None) -> tuple[int, int] | None:
    """Dates with a month name in any order: find day, month and year, then read the clock after them."""
    month = day = year = None
    end = 0
    for m in _WORDS.finditer(text):
        tok = m[0]
        if tok.isdigit():
            if len(tok) == 4 and year is None and (month or day):
                year = int(tok)
            elif len(tok) <= 2 and day is None:
                day = int(tok)
            else:
                break
        elif tok[0].isalpha() and month is None:
            month = _month(tok, lang) if day is not None or m.start() == 0 or not re.match(r"\s*[,.]", text[m.end() :]) else None
        if day is not None and month and year:
            end = m.end()
            break
    if not end:
        return None
    tail = re.sub(r"^[\s,.]*(?:г\.?|r\.?|roku)?[\s,.]*(?:at|um|à|a las|o godz\.?|o|в|-|–)?[\s,]*", "", text[end:], flags=re.I)
    m = re.match(_TIME, tail)
    return _micros(year, month, day, m.groupdict() if m else {}, tail[m.end() :] if m else tail, tz)
