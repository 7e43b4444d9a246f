"""Column functions on file names and paths (projections, fuse under codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprep.functions.common import col_of

# Python ``os.path.splitext`` rule: the extension starts at the last dot of the
# base name, provided a non-dot character comes before that dot.
_EXT_RE = r"^\.*[^.].*(\.[^.]*)$"


def basename(path) -> Column:
    """Last path component (``/`` separated)."""
    return F.regexp_extract(col_of(path), r"([^/]*)$", 1)


def raw_extension(path) -> Column:
    """``splitext`` extension of the base name, case kept (``''`` when none)."""
    return F.regexp_extract(basename(path), _EXT_RE, 1)


def extension(path) -> Column:
    """Lower-cased ``splitext`` extension, ``''`` when none."""
    return F.lower(raw_extension(path))


def stem(path) -> Column:
    """Base name without its extension."""
    base = basename(path)
    ext = raw_extension(path)
    return base.substr(F.lit(1), F.length(base) - F.length(ext))


def is_temp_file(name) -> Column:
    """Office lock files, editor temp files, backups and OS system files.

    ``~x``, ``.~x``, ``*.tmp``, ``*.bak`` are tested case-sensitively; the
    system names case-insensitively.
    """
    n = basename(name)
    return (
        n.startswith("~")
        | n.startswith(".~")
        | n.endswith(".tmp")
        | n.endswith(".bak")
        | F.lower(n).isin("thumbs.db", "desktop.ini", ".ds_store")
    )


def package_name(path, suffix: str | Column = "") -> Column:
    """``<stem>`` or ``<stem>_<suffix>``: the name shared by the ``.md`` and ``.zip`` outputs."""
    suffix_col = suffix if isinstance(suffix, Column) else F.lit(suffix)
    return F.concat_ws("_", stem(path), F.nullif(suffix_col, F.lit("")))
