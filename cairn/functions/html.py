"""Text of HTML fragments."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that part words.
BREAKS = frozenset("br div h1 h2 h3 h4 li p tr".split())

# Comments and declarations, the text of scripts and styles (which is no markup, and counts as text), and tags.  What is not closed goes on to the end of the
# text, and no quantifier gives back what it took, so each character is read once or twice.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style)\b[^>]*>(.*?)(?=</\1\b|\Z)|</?([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+(?:>|\Z)",
    re.S | re.I,
)


_CLOSED = re.compile(r"&(?:#\d+|#[xX][\da-fA-F]+|[A-Za-z][\dA-Za-z]*);")


def _closed(text: str) -> str:
    """Text whose references are decoded where they end in a semicolon."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text)


def fragment_text(value: str | None, unescape: Callable[[str], str] = html.unescape) -> str | None:
    """Text with space at breaking tags, other tags gone, references decoded, white space folded; scripts and styles count as text."""
    if value is None:
        return None
    pieces, at = [], 0
    for found in _MARKUP.finditer(value):
        pieces.append(unescape(value[at : found.start()]))
        raw, inside, tag = found.groups()
        pieces.append(inside if raw else " " if tag and tag.lower() in BREAKS else "")
        at = found.end()
    pieces.append(unescape(value[at:]))
    return " ".join("".join(pieces).split())


@F.pandas_udf(T.StringType())
def html_text(values: pd.Series) -> pd.Series:
    return values.map(fragment_text)


@F.pandas_udf(T.StringType())
def closed_html_text(values: pd.Series) -> pd.Series:
    return values.map(lambda value: fragment_text(value, _closed))
