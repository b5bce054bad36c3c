"""Blogs and books as checked settings: defaults, overrides, validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from datetime import UTC, datetime

from loomwell.functions.dates import resolve_date
from loomwell.functions.dom import selector
from loomwell.functions.text import SIZE_UNITS

# The accepted choices.
CHOICES = {"order": ("asc", "desc"), "group_by": ("none", "blog", "year", "year-month", "month"), "split": ("none", "size", "year", "month"), "readability": ("auto", "always", "never"), "source": ("auto", "wordpress", "feed", "sitemap")}
ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class SettingsError(ValueError):
    """A setting that cannot be used; the message names it."""


@dataclass(frozen=True)
class Blog:
    id: str
    url: str
    title: str = ""
    source: str = "auto"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    title_strip: tuple[str, ...] = ()
    category_strip: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    min_chars: int = 150
    delay: float | None = None


@dataclass(frozen=True)
class Book:
    id: str
    blogs: tuple[str, ...]
    title: str = ""
    order: str = "desc"
    group_by: str = "year"
    split: str = "size"
    readability: str = "auto"
    since: str | None = None
    until: str | None = None
    max_posts: int | None = None
    max_bytes: int = 200_000_000
    language: str = "en"


@dataclass(frozen=True)
class Settings:
    blogs: dict[str, Blog] = field(default_factory=dict)
    books: dict[str, Book] = field(default_factory=dict)

    def all_books(self) -> list[Book]:
        """A book of each blog, then the combined ones."""
        return [Book(b.id, (b.id,), b.title or b.id, since=b.since, until=b.until) for b in self.blogs.values()] + list(self.books.values())

    def select(self, ids: list[str]) -> list[Blog]:
        """Blogs by their own or a book's id in the order given, each once; all without ids."""
        if not ids:
            return list(self.blogs.values())
        out: dict[str, Blog] = {}
        for i in ids:
            names = (i,) if i in self.blogs else self.books[i].blogs if i in self.books else ()
            if not names:
                raise SettingsError(f"no blog or book is called {i!r}")
            out |= {n: self.blogs[n] for n in names}
        return list(out.values())


def size_of(value: object, name: str) -> int:
    """Bytes from 250, "2.5m" or "1 GB"."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmg]?)b?", str(value).strip().lower()) if not isinstance(value, bool) else None
    size = int(float(m[1]) * SIZE_UNITS[m[2]]) if m else 0
    if size <= 0:
        raise SettingsError(f"{name}: {value!r} is no size")
    return size


def _checked(kind: type, raw: dict, defaults: dict):
    known = {f.name for f in fields(kind)}
    values = {k: v for k, v in defaults.items() if k in known} | raw
    if unknown := sorted(set(values) - known):
        raise SettingsError(f"{raw.get('id')}: unknown settings {', '.join(unknown)}")
    values = {k: tuple(v) if isinstance(v, list) else (v,) if isinstance(v, str) and k in ("include", "exclude", "title_strip", "category_strip", "keep", "remove", "blogs") else v for k, v in values.items()}
    name = values.get("id")
    if not isinstance(name, str) or not ID.fullmatch(name):
        raise SettingsError(f"id {name!r} may hold letters, digits and ._- only")
    for k, allowed in CHOICES.items():
        if k in values and values[k] not in allowed:
            raise SettingsError(f"{name}.{k}: {values[k]!r} is none of {', '.join(allowed)}")
    for k in ("since", "until"):
        if values.get(k) and resolve_date(str(values[k]), datetime.now(UTC)) is None:
            raise SettingsError(f"{name}.{k}: {values[k]!r} is no date and no window like 7d")
    for k in ("include", "exclude", "title_strip", "category_strip"):
        for p in values.get(k, ()):
            try:
                re.compile(p)
            except re.error as e:
                raise SettingsError(f"{name}.{k}: {p!r}: {e}") from None
    for k in ("keep", "remove"):
        for s in values.get(k, ()):
            try:
                selector(s)
            except ValueError as e:
                raise SettingsError(f"{name}.{k}: {e}") from None
    if "max_bytes" in values:
        values["max_bytes"] = size_of(values["max_bytes"], f"{name}.max_bytes")
    try:
        return kind(**values)
    except TypeError as e:
        raise SettingsError(f"{name}: {e}") from None


def override(raw: dict, spec: str) -> None:
    """Apply ID.KEY=VALUE (the value read like a YAML scalar) to the raw settings."""
    target, eq, value = spec.partition("=")
    name, dot, key = target.rpartition(".")
    entry = next((e for part in ("blogs", "books") for e in raw.get(part) or [] if e.get("id") == name), None)
    if not eq or not dot or entry is None:
        raise SettingsError(f"{spec!r} is not ID.KEY=VALUE of a blog or book")
    words = {"true": True, "false": False, "null": None, "": None}
    text = value.strip()
    entry[key] = words[text.lower()] if text.lower() in words else int(text) if re.fullmatch(r"-?\d+", text) else [x.strip() for x in text[1:-1].split(",")] if re.fullmatch(r"\[.*\]", text) else text


def load_settings(raw: dict, overrides: list[str] = ()) -> Settings:
    """Settings from parsed YAML or JSON: {defaults, blogs, books}."""
    for spec in overrides:
        override(raw, spec)
    defaults = raw.get("defaults") or {}
    out: tuple[dict, dict] = ({}, {})
    for part, kind, table in (("blogs", Blog, out[0]), ("books", Book, out[1])):
        for entry in raw.get(part) or []:
            one = _checked(kind, entry, defaults)
            if one.id in out[0] or one.id in out[1]:
                raise SettingsError(f"id {one.id!r} is used twice")
            table[one.id] = one
    for book in out[1].values():
        if missing := [b for b in book.blogs if b not in out[0]]:
            raise SettingsError(f"{book.id}.blogs: no blog {', '.join(missing)}")
        if len(set(book.blogs)) < len(book.blogs):
            raise SettingsError(f"{book.id}.blogs: a blog comes twice")
    return Settings(*out)


def read_settings(path: str, overrides: list[str] = ()) -> Settings:
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return load_settings(json.loads(text), overrides)
    try:
        import yaml
    except ImportError as e:
        raise SettingsError("YAML settings need PyYAML; JSON works without") from e
    return load_settings(yaml.safe_load(text) or {}, overrides)


def with_collector_edition(book: Book) -> Book:
    """The same book in one volume under a name of its own."""
    return replace(book, id=f"{book.id}-collectors", split="none")
