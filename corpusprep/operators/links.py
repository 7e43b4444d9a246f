"""Image links in Markdown documents: find, classify, resolve, flatten, rewrite.

Refs are extracted per document (narrow), resolved against a media catalogue
by an equi-join on the normalised path (only refs and paths are shuffled,
never document text), then folded back into the text. Documents without a
local ref bypass the join entirely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.common import PY_SPACE, col_of

_NS = PY_SPACE[1:-1]  # the class body, to build negated classes
MD_IMAGE = rf'!\[([^\]]*)\]\(([^){_NS}]+)(?:{PY_SPACE}*"([^"]*)")?\)'
HTML_IMAGE = rf"(?i)<img{PY_SPACE}+[^>]*?src{PY_SPACE}*={PY_SPACE}*(['\"]){PY_SPACE}*([^'\"]+){PY_SPACE}*\1"

def image_refs(docs: DataFrame, key: str = "doc_key", text_col: str = "markdown", path_col: str = "path") -> DataFrame:
    """All image refs: ``(key, [_dir,] syntax, pos, ref)``, with the directory of the document where ``docs`` has
    ``path_col``; syntax 0 = ``![..](..)``, 1 = ``<img src>``;
    ``pos`` counts matches of that syntax in document order."""
    found = lambda rx, n: F.transform(
        F.regexp_extract_all(F.col(text_col), F.lit(rx), 2), lambda r, i: F.struct(F.lit(n).alias("syntax"), i.alias("pos"), r.alias("ref"))
    )
    directory = [dirname(path_col).alias("_dir")] if path_col in docs.columns else []
    return docs.select(key, *directory, F.inline(F.concat(found(MD_IMAGE, 0), found(HTML_IMAGE, 1))))


def distinct_refs(refs: DataFrame, key: str = "doc_key") -> DataFrame:
    """First occurrence of every ref per document (Markdown refs come before HTML ones)."""
    directory = [F.max("_dir").alias("_dir")] if "_dir" in refs.columns else []
    firsts = refs.groupBy(key, "ref").agg(F.min(F.struct("syntax", "pos")).alias("first"), *directory)
    return firsts.select(key, "ref", "first.syntax", "first.pos", *(["_dir"] if directory else []))


def classify_ref(ref) -> Column:
    r = col_of(ref)
    return (
        F.when(r.startswith("http://") | r.startswith("https://"), F.lit("external"))
        .when(r.startswith("data:"), F.lit("data"))
        .when(r.startswith("/"), F.lit("absolute"))
        .otherwise(F.lit("local"))
    )


def normalize_path(path) -> Column:
    """``os.path.normpath`` for ``/`` paths: drop empty and ``.`` parts, fold ``..``."""
    p = col_of(path)
    absolute = p.startswith("/")
    parts = F.split(p, "/")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        up = F.when((F.size(acc) > 0) & (last != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(
            F.when(absolute, acc).otherwise(F.concat(acc, F.array(s)))
        )
        return F.when((s == "") | (s == "."), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), folded)).otherwise(F.when(folded == "", F.lit(".")).otherwise(folded))


def dirname(path) -> Column:
    return F.regexp_extract(col_of(path), r"^(.*)/[^/]*$", 1)


def flatten_media_name(ref) -> Column:
    """``../`` and ``./`` dropped, ``/`` -> ``_``; no extension -> ``.png`` added."""
    flat = F.replace(F.replace(F.replace(col_of(ref), F.lit("../"), F.lit("")), F.lit("./"), F.lit("")), F.lit("/"), F.lit("_"))
    has_ext = flat.rlike(r"^\.*[^.].*\.[^.]*$")
    return F.when(has_ext, flat).otherwise(F.concat(flat, F.lit(".png")))


def resolve_local_refs(refs: DataFrame, docs: DataFrame, media: DataFrame, key: str = "doc_key",
                       path_col: str = "path", media_path: str = "path") -> DataFrame:
    """Local refs with ``resolved`` (normalised absolute path), ``exists``, ``media_name``, ``new_ref``.

    ``refs`` come from :func:`distinct_refs`; ``docs`` supply each document's
    path; ``media`` is the file listing. The existence test is an equi-join
    on the resolved path (AQE broadcasts the listing when it is small).
    """
    local = refs.where(classify_ref("ref") == "local")
    with_dir = local if "_dir" in refs.columns else local.join(docs.select(key, dirname(path_col).alias("_dir")), key)
    resolved = with_dir.withColumn("resolved", normalize_path(F.concat(F.col("_dir"), F.lit("/"), F.col("ref")))).drop("_dir")
    catalogue = media.select(F.col(media_path).alias("resolved")).distinct().withColumn("exists", F.lit(True))
    out = resolved.join(catalogue, "resolved", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    name = flatten_media_name(F.col("ref"))
    return out.withColumn("media_name", name).withColumn(
        "new_ref", F.when(F.col("exists"), F.concat(F.lit("media/"), name))
    )


def missing_refs(resolved: DataFrame) -> DataFrame:
    """Local refs whose file does not exist (reported, left unchanged in the text)."""
    return resolved.where(~F.col("exists"))


def media_name_clashes(resolved: DataFrame, key: str = "doc_key") -> DataFrame:
    """Different refs of one document flattened to the same media name."""
    ok = resolved.where("exists")
    return ok.groupBy(key, "media_name").agg(F.countDistinct("ref").alias("refs")).where("refs > 1")


# any Markdown image link (alt, target, title) and any <img ... src=...> tag
# (prefix, quote, value, rest); the tag's value is matched case-insensitively
MD_LINK = rf'!\[([^\]]*)\]\(([^){_NS}]+)({PY_SPACE}*"(?:[^"]*)")?\)'
IMG_TAG = rf"(?i)(<img{PY_SPACE}+[^>]*?src{PY_SPACE}*={PY_SPACE}*)(['\"])([^'\"]*)\2([^>]*?>)"


def split_rewrite(text: Column, pattern: str, groups: int, build) -> Column:
    """Rewrite every match of ``pattern`` in one scan: split the text around the
    matches, rebuild each match with ``build(element)`` (fields ``g0``..``gN``),
    join the pieces. Linear in the text however many matches there are."""
    # two scans of the text (matches, and the pieces between them); the groups
    # are then read from each short match
    z = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("seg"))

    def piece(e):
        g = {f"g{k}": F.regexp_extract(e["m"], pattern, k) for k in range(1, groups + 1)}
        g["g0"] = e["m"]
        return F.concat(e["seg"], F.when(e["m"].isNull(), F.lit("")).otherwise(build(g)))

    return F.array_join(F.transform(z, piece), "")


def rewrite_links(docs: DataFrame, resolved: DataFrame, key: str = "doc_key", text_col: str = "markdown") -> DataFrame:
    """Replace every found local ref by its ``media/`` name in both syntaxes,
    keeping alt text, titles and tag attributes.

    Each document gets a map ``ref -> new_ref`` (and a lower-cased one for
    ``<img>`` tags, which match case-insensitively; on a clash the longer,
    then earlier, ref wins); the text is then rewritten in one scan per
    syntax. Documents without an image link are not joined at all.
    """
    found = resolved.where("exists")
    rank = F.struct((-F.length("ref")).alias("l"), F.col("syntax"), F.col("pos"))
    by_lower = found.groupBy(key, F.lower("ref").alias("_lref")).agg(
        F.collect_list(F.struct("ref", "new_ref")).alias("_exact"), F.min_by("new_ref", rank).alias("_new")
    )
    maps = by_lower.groupBy(key).agg(
        F.map_from_entries(F.flatten(F.collect_list("_exact"))).alias("_m"), F.map_from_entries(F.collect_list(F.struct("_lref", "_new"))).alias("_mi")
    )
    flagged = docs.withColumn("_has_local", _has_local_ref(F.col(text_col)))
    touched = flagged.where("_has_local").join(maps, key, "left")

    def md(e):
        new = F.try_element_at(F.col("_m"), e["g2"])
        return F.when(new.isNull(), e["g0"]).otherwise(F.concat(F.lit("!["), e["g1"], F.lit("]("), new, e["g3"], F.lit(")")))

    def tag(e):
        new = F.try_element_at(F.col("_mi"), F.lower(e["g3"]))
        return F.when(new.isNull(), e["g0"]).otherwise(F.concat(e["g1"], e["g2"], new, e["g2"], e["g4"]))

    text = F.col(text_col)
    once = split_rewrite(split_rewrite(text, MD_LINK, 3, md), IMG_TAG, 4, tag)
    rewritten = touched.withColumn(text_col, F.when(F.col("_m").isNull(), text).otherwise(once)).drop("_m", "_mi")
    return rewritten.unionByName(flagged.where(~F.col("_has_local"))).drop("_has_local")


def _has_local_ref(text: Column) -> Column:
    """Cheap superset of "has an image ref": documents without one skip the join
    (one with refs that all turn out remote simply finds no links)."""
    return F.coalesce(text.contains("![") | text.rlike("(?i)<img"), F.lit(False))
