"""Small shared helpers for Column code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's ``str.isspace`` / ``re`` ``\s`` treat as whitespace. Java's
# ``\s`` is ASCII only, so this class is spelled out.
PY_SPACE = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


# The same set as characters, for ``trim(BOTH ... FROM x)``, and as a run pattern in
# Java's Unicode mode (its White_Space property plus the four separators Python adds).
PY_SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
PY_SPACE_RUN = "(?U)[\\s\\x1c-\\x1f]+"


def col_of(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (touches only the ends)."""
    return F.trim(col_of(c), F.lit(PY_SPACE_CHARS))


def cut(c, limit: int | None, keep: int | None = None) -> Column:
    """Longer than ``limit`` code points -> first ``keep`` (default limit-3) plus ``...``; as it is without a limit.

    One regex over the value (it is referenced once, so an expensive input
    expression is evaluated once).
    """
    if limit is None:
        return col_of(c)
    keep = limit - 3 if keep is None else keep
    return F.regexp_replace(col_of(c), f"(?s)^(.{{{keep}}}).{{{limit - keep + 1},}}\\z", "$1...")


def md5_prefix(c, n: int = 12) -> Column:
    return F.substring(F.md5(col_of(c)), 1, n)
