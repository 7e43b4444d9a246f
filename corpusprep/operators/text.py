"""Plain text, JSON and source-code files -> Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.paths import extension
from corpusprep.functions.text import fence, pretty_json

# Code extensions rendered as fenced blocks tagged with the extension.
CODE_EXTS = [".py", ".js", ".java", ".cs", ".c", ".cpp", ".go", ".rb", ".php", ".rs", ".kt", ".swift"]

INVALID_JSON = "invalid JSON"


def render_simple(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Add ``parser``, ``language``, ``markdown``, ``error``.

    ``.json``: pretty-printed (indent 2) in a ``json`` fence when valid, else the
    raw text in a bare fence with ``error`` set. Code: fence tagged with the
    extension, ``language`` set. Anything else (``.txt`` and unknown types): the
    text unchanged. The JSON pretty printer is the only Python step; it decides
    validity too and gets nulls for every row that is no JSON file.
    """
    ext = extension(F.col(path_col))
    text = F.col(text_col)
    is_json = ext == ".json"
    out = files.withColumn("_ext", ext).withColumn("_pretty", pretty_json(F.when(is_json, text)))
    ext_c = F.col("_ext")
    is_json = ext_c == ".json"
    is_code = ext_c.isin(*CODE_EXTS)
    return (
        out.withColumn(
            "parser",
            F.when(is_json, F.lit("json_simple")).when(is_code, F.lit("code_simple")).otherwise(F.lit("txt_simple")),
        )
        .withColumn("language", F.when(is_code, F.regexp_replace(ext_c, r"^\.", "")))
        .withColumn(
            "markdown",
            F.when(is_json & F.col("_pretty").isNotNull(), fence(F.col("_pretty"), "json"))
            .when(is_json, fence(text))
            .when(is_code, fence(text, F.regexp_replace(ext_c, r"^\.", "")))
            .otherwise(text),
        )
        .withColumn("error", F.when(is_json & F.col("_pretty").isNull(), F.lit(INVALID_JSON)))
        .drop("_ext", "_pretty")
    )
