"""Column functions for decoding and cleaning text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions.common import PY_SPACE_RUN, col_of, cut, py_strip


def normalize_newlines(c) -> Column:
    """Text-mode read: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.replace(F.replace(col_of(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def decode_text(content) -> Column:
    """Bytes -> text as UTF-8 with undecodable bytes dropped, newlines normalised.

    A valid input is cast directly, so a genuine U+FFFD in valid text survives;
    only repaired input has its replacement characters removed.
    """
    b = col_of(content)
    text = F.when(F.is_valid_utf8(b), b.cast("string")).otherwise(
        F.regexp_replace(F.make_valid_utf8(b), "�", "")
    )
    return normalize_newlines(text)


def detect_encoding(content) -> Column:
    """``utf-8`` when the bytes are valid UTF-8, else ``latin-1`` (which decodes anything)."""
    return F.when(F.is_valid_utf8(col_of(content)), F.lit("utf-8")).otherwise(F.lit("latin-1"))


def decode_detected(content) -> Column:
    """Decode with the encoding chosen by :func:`detect_encoding` (no bytes dropped)."""
    b = col_of(content)
    return F.when(F.is_valid_utf8(b), b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))


def clean_column_name(c, max_chars: int | None = None) -> Column:
    """Header cell for a Markdown table.

    Blank / ``nan`` / ``NaN`` / ``None`` -> ``Unnamed_Column``; stripped; ``|`` -> ``_``;
    CR and LF -> space; longer than ``max_chars`` -> cut there with ``...`` (default: whole).
    """
    c = col_of(c)
    s = py_strip(c)
    cleaned = cut(F.translate(s, "|\n\r", "_  "), max_chars)
    return F.when(c.isNull() | s.isin("", "nan", "NaN", "None"), F.lit("Unnamed_Column")).otherwise(cleaned)


def clean_cell(c, escape_times: int = 1, max_chars: int | None = None) -> Column:
    """Table cell: null-like -> ``''``; whitespace runs -> one space; ``| [ ]`` escaped;
    longer than ``max_chars`` -> cut there with ``...`` (default: whole); stripped.

    ``escape_times=2`` reproduces the double cleaning of CSV and workbook cells.
    """
    c = col_of(c)
    out = c
    for _ in range(escape_times):
        out = _clean_once(out, max_chars)
    return out


def _clean_once(c: Column, max_chars: int | None) -> Column:
    # Each step feeds the next exactly once. Blank input needs no test of its
    # own: stripping makes it ''. The final strip of the original is a no-op
    # here (the text was stripped first and a cut ends in '...').
    spaced = F.regexp_replace(py_strip(c), PY_SPACE_RUN, " ")
    # three literal replaces (no regex, no conversion to a Java string)
    escaped = spaced
    for ch in "|[]":
        escaped = F.replace(escaped, F.lit(ch), F.lit("\\" + ch))
    null_like = c.isNull() | F.lower(c).isin("nan", "none", "null")
    return F.when(null_like, F.lit("")).otherwise(cut(escaped, max_chars))


def json_valid(c) -> Column:
    """True when the whole text is one JSON value (an empty string is not): what :func:`pretty_json`
    can print, whatever its size. Repeated keys, ``NaN`` and ``Infinity`` are accepted."""
    return pretty_json(col_of(c)).isNotNull()


@F.pandas_udf(T.StringType())
def pretty_json(s: pd.Series) -> pd.Series:
    """``json.dumps(json.loads(x), indent=2)``: the one per-value Python step.

    Spark's own pretty printer spaces keys differently (``"a" : 1``), so the
    exact layout the reference produces needs Python's serialiser.
    """

    def fmt(x):
        if x is None:
            return None
        try:
            return json.dumps(json.loads(x), indent=2)
        except (ValueError, RecursionError):
            return None

    return s.map(fmt)


def fence(body, lang: str | Column = "") -> Column:
    """A fenced code block: ``` + lang, newline, body, newline, ```."""
    lang_col = lang if isinstance(lang, Column) else F.lit(lang)
    return F.concat(F.lit("```"), lang_col, F.lit("\n"), col_of(body), F.lit("\n```"))
