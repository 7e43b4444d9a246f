"""Column functions over HTML pages and converted Markdown.

The reference hands HTML to an outside converter (GitHub Markdown, ATX headings, no wrapping). Here an Arrow-batched
function reads each page once (:mod:`corpusprep.functions.html_pages`): nested lists, tables and verbatim blocks need a
state that SQL functions don't keep, and a chain of replacements would read the page once for each tag.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions.common import PY_SPACE, col_of, py_strip
from corpusprep.functions.html_pages import page_markdown

# Entities decoded in titles and text.
ENTITIES: list[tuple[str, str]] = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]


def decode_entities(c) -> Column:
    out = col_of(c)
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


@F.pandas_udf(T.StringType())
def _markdown(pages: pd.Series) -> pd.Series:
    return pages.map(lambda page: None if page is None else page_markdown(page))


def html_to_markdown(html) -> Column:
    return _markdown(col_of(html))


def html_title(html) -> Column:
    """Text of the first ``<title>``, entities decoded and trimmed; null when absent."""
    raw = F.regexp_extract(col_of(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    t = F.trim(decode_entities(raw))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def html_links(html) -> Column:
    """All ``href`` values of ``<a>`` tags, in order (array); in quotes of either kind or bare."""
    pattern = r"""(?i)<a[ \t\r\n](?:[^>]*?[ \t\r\n"'/])?href[ \t\r\n]*=[ \t\r\n]*("[^"]*+"|'[^']*+'|[^ \t\r\n"'>]++)"""
    return F.transform(F.regexp_extract_all(col_of(html), F.lit(pattern), 1), lambda v: F.regexp_replace(v, r"^[\"']|[\"']$", ""))


def with_front_matter(markdown, title) -> Column:
    """Standalone output: a YAML block with the title ahead of the body when one exists."""
    t = col_of(title)
    body = col_of(markdown)
    return F.when(t.isNull(), body).otherwise(F.concat(F.lit("---\ntitle: "), t, F.lit("\n---\n\n"), body))


def front_matter_title(markdown) -> Column:
    """``title:`` of the first YAML block found at a line start, stripped; null when absent."""
    pattern = f"(?ms)^---{PY_SPACE}*\ntitle:{PY_SPACE}*(.*?)\n"
    raw = F.regexp_extract(col_of(markdown), pattern, 1)
    m = col_of(markdown).rlike(pattern)
    return F.when(m, py_strip(raw))


def table_of_contents(markdown) -> Column:
    """Bullet list of ATX headings, indented by level (empty string when none); ``#`` lines in fences are no headings."""
    body = F.regexp_replace(col_of(markdown), r"(?ms)^(`{3,}+)[^`\n]*+\n.*?^\1`*+[ \t]*+$", "")
    heads = F.regexp_extract_all(body, F.lit(r"(?m)^(#{1,6}) (.+)$"), 0)
    items = F.transform(
        heads,
        lambda h: F.concat(
            F.repeat(F.lit("  "), F.length(F.regexp_extract(h, r"^(#+)", 1)) - 1),
            F.lit("- "),
            F.regexp_extract(h, r"^#+ (.*)$", 1),
        ),
    )
    return F.array_join(items, "\n")


def fix_table_captions(c) -> Column:
    """Converter caption lines ``\\n\\n: []{...}Tabela ...`` -> bold line."""
    return F.regexp_replace(col_of(c), r"(\n\n): \[\]\{.*?\}(Tabela[^\n]+)", "\n\n**$2**")


def fix_media_paths(c) -> Column:
    """``media/media/`` -> ``media/``."""
    return F.replace(col_of(c), F.lit("media/media/"), F.lit("media/"))


def fix_pdf_quotes(c) -> Column:
    """PDF text fix: `` " **;**`` -> ``"**;**``."""
    return F.replace(col_of(c), F.lit(' " **;**'), F.lit('"**;**'))
