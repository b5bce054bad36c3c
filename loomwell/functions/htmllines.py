"""The lines of an html value: the reading on which the line-based operators agree."""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags at which a line ends.
BREAKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th pre blockquote section article aside nav main "
    "header footer figure figcaption form button hr br center noscript".split()
)
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+|[^>]*+)>")
UNFINISHED = re.compile(r"</?(?:[a-zA-Z][^<>]*)?\Z|<!(?:[^<>]*)?\Z")
MARK = re.compile(r"<[!?][^>]*>|" + TAG.pattern)
_DIGITS = re.compile(r"[0-9]+")


def visible_lines(value: str | None) -> list[str]:
    """Lines as a reader sees them: decoded, white space collapsed, case and digits kept; empty ones left out."""
    if not value:
        return []
    text = UNFINISHED.sub("", HIDDEN.sub("\x00", value))
    text = MARK.sub(lambda m: "\n" if (m[2] or "").lower() in BREAKS else "", text).replace("\x00", "")
    out = []
    for part in re.split(r"[\n\r]", text):
        line = " ".join(_html.unescape(part).split())
        if line:
            out.append(line)
    return out


def fold_line(line: str) -> str:
    return _DIGITS.sub("0", line.lower())


def html_lines(value: str | None) -> list[str]:
    """The lines in order, folded: lower case, runs of digits as one 0. Null and empty values have none."""
    return [fold_line(x) for x in visible_lines(value)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_lines_udf(values: pd.Series) -> pd.Series:
    return values.map(html_lines)
