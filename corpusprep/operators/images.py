"""Image triage: size, decorative removal, resize plan, embedding, relinking.

Input ``images``: ``(doc_key, placeholder, filename, bytes)``. Every decision is
a projection (a ``when`` chain over header fields), so triage is narrow; only
the Markdown edit joins decisions back to their documents.

Pixel decoding, resampling and re-encoding are not done: sizes come from the
file headers, and the byte size used for embedding is that of the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.config import DEFAULT, Settings
from corpusprep.functions.common import PY_SPACE
from corpusprep.functions.images import data_uri, image_format, image_size, sniff_image_type
from corpusprep.operators.ordered import ordered_concat
from corpusprep.session import materialize

# Suggested-name extensions kept as they are (others become .png).
KEPT_EXTS = [".png", ".jpg", ".jpeg", ".gif", ".bmp"]


def with_size(images: DataFrame, bytes_col: str = "bytes") -> DataFrame:
    """Add ``width``, ``height`` (null when unknown) and ``decodable``."""
    sized = images.withColumn("_size", image_size(F.col(bytes_col)))
    sized = sized.withColumn("width", F.col("_size.width")).withColumn("height", F.col("_size.height")).drop("_size")
    return sized.withColumn("decodable", F.col("width").isNotNull() & F.col("height").isNotNull())


def final_name(filename) -> F.Column:
    """``base + ext`` with an unknown extension replaced by ``.png``."""
    f = F.col(filename) if isinstance(filename, str) else filename
    ext = F.regexp_extract(f, r"^\.*[^.].*(\.[^.]*)$", 1)
    base = f.substr(F.lit(1), F.length(f) - F.length(ext))
    return F.concat(base, F.when(F.lower(ext).isin(*KEPT_EXTS), ext).otherwise(F.lit(".png")))


def drop_decorative(images: DataFrame, threshold_px: int) -> DataFrame:
    """Images with both sides below ``threshold_px``."""
    return images.where((F.col("width") < threshold_px) & (F.col("height") < threshold_px))


def resize_plan(images: DataFrame, max_px: int) -> DataFrame:
    """Target size with the longest side capped at ``max_px``, ratio kept (thumbnail rule)."""
    longest = F.greatest("width", "height")
    scale = F.least(F.lit(1.0), F.lit(float(max_px)) / longest)
    big = longest > max_px
    tw = F.when(big, F.greatest(F.lit(1), F.round(F.col("width") * scale).cast("bigint"))).otherwise(F.col("width"))
    th = F.when(big, F.greatest(F.lit(1), F.round(F.col("height") * scale).cast("bigint"))).otherwise(F.col("height"))
    return images.withColumn("target_width", tw).withColumn("target_height", th)


def embed_small(images: DataFrame, threshold_kb: int, bytes_col: str = "bytes", fmt_col: str = "format") -> DataFrame:
    """Images smaller than ``threshold_kb`` KiB, with their ``data:`` URI."""
    small = images.where(F.length(bytes_col) < threshold_kb * 1024)
    return small.withColumn("data_uri", data_uri(F.col(bytes_col), F.col(fmt_col)))


def triage_images(images: DataFrame, settings: Settings = DEFAULT, bytes_col: str = "bytes") -> DataFrame:
    """``action`` (remove / embed / relink), ``format``, ``data_uri``, ``new_path`` per image.

    Undecodable bytes are kept and relinked as PNG; decorative images (both
    sides below the threshold) are removed when enabled; small ones embedded
    when enabled; everything else relinked to ``media/<base>.<fmt>``.
    """
    sized = with_size(images, bytes_col)
    name = final_name("filename")
    fmt = F.when(F.col("decodable"), image_format(name)).otherwise(F.lit("PNG"))
    t = settings.decorative_threshold_px
    decorative = (
        F.lit(settings.exclude_decorative and t > 0)
        & F.col("decodable")
        & (F.col("width") < t)
        & (F.col("height") < t)
    )
    kb = settings.small_image_threshold_kb
    small = F.lit(settings.embed_small_images and kb > 0) & F.col("decodable") & (F.length(bytes_col) < kb * 1024)
    action = F.when(decorative, F.lit("remove")).when(small, F.lit("embed")).otherwise(F.lit("relink"))
    base = name.substr(F.lit(1), F.length(name) - F.length(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)))
    out = sized.withColumn("format", fmt).withColumn("action", action)
    out = out.withColumn("data_uri", F.when(F.col("action") == "embed", data_uri(F.col(bytes_col), F.col("format"))))
    out = out.withColumn(
        "new_path", F.when(F.col("action") == "relink", F.concat(F.lit("media/"), base, F.lit("."), F.lower(F.col("format"))))
    )
    if settings.apply_max_res and settings.max_image_res_px > 0:
        out = resize_plan(out, settings.max_image_res_px)
    return out


_NS = PY_SPACE[1:-1]
# any Markdown image link whose target has no blank and no ')': alt, target, title
LINK = rf'!\[([^\]]*)\]\(([^){_NS}]+)({PY_SPACE}*"(?:[^"]*)")?\)'


_OPEN = re.compile(r"!\[([^\]]*)\]\(")
_CLOSE = re.compile(rf'({PY_SPACE}*"(?:[^"]*)")?\)')


def edited(text: str, edits: Iterable[dict]) -> str:
    """``text`` with the image links of ``edits`` (placeholder, action, target) removed or given their target; titles are kept.

    One scan: at every link, a trie of the placeholders gives those that stand there, and the longest that ends the
    link counts. Placeholders may hold blanks and brackets.
    """
    trie: dict = {}
    for e in edits:
        node = trie
        for c in e["placeholder"]:
            node = node.setdefault(c, {})
        node[None] = e
    out, done, at = [], 0, 0
    while link := _OPEN.search(text, at):
        at, node, here = link.end(), trie, link.end()
        found = []
        while True:
            if None in node:
                found.append((here, node[None]))
            node = node.get(text[here]) if here < len(text) else None
            if node is None:
                break
            here += 1
        for end, e in reversed(found):
            close = _CLOSE.match(text, end)
            if close and (e["action"] == "remove" or e["target"] is not None):
                out.append(text[done : link.start()])
                if e["action"] != "remove":
                    out.append(f"![{link[1]}]({e['target']}{close[1] or ''})")
                done = at = close.end()
                break
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def _edited(texts: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or e is None else edited(t, e) for t, e in zip(texts, edits, strict=True)], dtype=object)


def _links(md) -> F.Column:
    """Links of a text in order, each with the text before it, and at last the text after them: one scan."""
    return F.arrays_zip(
        F.regexp_extract_all(md, F.lit(LINK), 0).alias("whole"),
        F.regexp_extract_all(md, F.lit(LINK), 1).alias("alt"),
        F.regexp_extract_all(md, F.lit(LINK), 2).alias("link_target"),
        F.regexp_extract_all(md, F.lit(LINK), 3).alias("title"),
        F.split(md, LINK, -1).alias("seg"),
    )


def _relinked(docs: DataFrame, decisions: DataFrame, key: str, md_col: str) -> DataFrame:
    """``(_n, _text)``: the texts ``(_n, key, md_col)`` with every link whose target has a decision removed or given its target.

    A join of links and decisions: a map of a document's decisions is searched from its start for every link.
    """
    links = docs.select("_n", key, F.posexplode(_links(F.col(md_col))).alias("_at", "_link")).select("_n", key, "_at", "_link.*")
    own = decisions.select(F.col(key).alias("_key"), "placeholder", "action", "target", F.lit(True).alias("_decided"))
    found = links.join(own, (F.col(key) == F.col("_key")) & (F.col("link_target") == F.col("placeholder")), "left")
    link = (
        F.when(F.col("whole").isNull(), F.lit(""))
        .when(F.col("_decided").isNull(), F.col("whole"))
        .when(F.col("action") == "remove", F.lit(""))
        .otherwise(F.concat(F.lit("!["), F.col("alt"), F.lit("]("), F.col("target"), F.col("title"), F.lit(")")))
    )
    return ordered_concat(found.select("_n", "_at", F.concat("seg", link).alias("_piece")), ["_n"], "_at", "_piece", "", "_text")


def apply_image_decisions(docs: DataFrame, decisions: DataFrame, key: str = "doc_key", md_col: str = "markdown") -> DataFrame:
    """Edit Markdown image links by decision (remove / embed / relink); titles kept.

    One scan of the text whatever the number of images: placeholders without blanks or ``)`` (all extracted
    files) are joined with the links; a document with others goes through :func:`edited`, where the
    longest placeholder that fits a link counts.
    """
    target = F.coalesce(F.col("data_uri"), F.col("new_path"))
    # of a placeholder decided on twice, the least decision counts
    once = decisions.groupBy(key, "placeholder").agg(F.min(F.struct("action", "data_uri", "new_path")).alias("_x"))
    once = materialize(once.select(key, "placeholder", "_x.*").select(key, "placeholder", "action", target.alias("target")))
    plain = ~F.col("placeholder").rlike(rf"[){_NS}]")
    kinds = materialize(once.groupBy(key).agg(F.bool_and(plain).alias("_plain")))
    # numbered and written: keys may repeat
    numbered = materialize(docs.join(kinds, key, "left").withColumn("_n", F.monotonically_increasing_id()))
    texts = _relinked(numbered.where("_plain"), once, key, md_col)
    listed = once.join(kinds.where("NOT _plain"), key).groupBy(key).agg(F.collect_list(F.struct("placeholder", "action", "target")).alias("_edits"))
    odd = numbered.where("NOT _plain").join(listed, key).select("_n", _edited(F.col(md_col), F.col("_edits")).alias("_text"))
    changed = F.when(F.col("_plain").isNull(), F.col(md_col)).otherwise(F.col("_text")).alias(md_col)
    out = numbered.join(texts.unionByName(odd), "_n", "left")
    return out.select(*[changed if c == md_col else F.col(f"`{c}`") for c in [key, *[c for c in docs.columns if c != key]]])


def image_summary(decisions: DataFrame, key: str = "doc_key", bytes_col: str = "bytes") -> DataFrame:
    """Counts and bytes by document and action, with per-document and overall
    subtotals (``rollup``; null marks a subtotal)."""
    return decisions.rollup(key, "action").agg(
        F.count(F.lit(1)).alias("images"), F.sum(F.length(bytes_col)).alias("bytes")
    )


__all__ = [
    "with_size", "final_name", "drop_decorative", "resize_plan", "embed_small", "triage_images",
    "apply_image_decisions", "image_summary", "sniff_image_type",
]
