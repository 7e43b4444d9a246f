"""Packages: metadata JSON, media layout, the entries of each document's ZIP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.common import col_of


def metadata_json(docs: DataFrame, extra: list[str] | None = None, out_col: str = "metadata") -> DataFrame:
    """``{"source_filename": .., "parser": .., <extra>...}`` as JSON text (null fields left out)."""
    fields = [F.col("source_filename"), F.col("parser")] + [F.col(c) for c in extra or []]
    return docs.withColumn(out_col, F.to_json(F.struct(*fields)))


def normalize_metadata(meta, base) -> Column:
    """Parser metadata merged under the base keys (base keys win); values as text."""
    m = F.transform_values(col_of(meta), lambda k, v: v.cast("string"))
    b = col_of(base)
    kept = F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)


def flatten_nested_media(entries: DataFrame, package: str = "package", entry: str = "entry") -> DataFrame:
    """``media/media/x`` -> ``media/x``; a file already at ``media/x`` wins over the nested one."""
    nested = F.col(entry).startswith("media/media/")
    final = F.when(nested, F.concat(F.lit("media/"), F.expr(f"substring({entry}, 13)"))).otherwise(F.col(entry))
    depth = F.when(nested, 1).otherwise(0)
    w = Window.partitionBy(package, "_final").orderBy("_depth")
    return (
        entries.withColumn("_final", final)
        .withColumn("_depth", depth)
        .withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .withColumn("source_entry", F.col(entry))
        .withColumn(entry, F.col("_final"))
        .drop("_final", "_depth", "_rn")
    )


def package_entries(docs: DataFrame, media: DataFrame | None = None, package: str = "package") -> DataFrame:
    """Union of ``<package>.md``, ``metadata.json`` and ``media/<name>`` entries:
    ``(package, entry, kind, bytes)``. Documents with empty or missing Markdown
    get no package at all (and their media are dropped with them)."""
    ok = docs.where(F.col("markdown").isNotNull() & (F.length("markdown") > 0))
    name = F.col(package)
    first = ok
    if "part_no" in docs.columns:  # later parts of a long table are entries of their own
        name = F.when(F.col("part_no") == 0, name).otherwise(F.format_string("%s.part%05d", name, F.col("part_no")))
        first = ok.where("part_no = 0")
    md = ok.select(package, F.concat(name, F.lit(".md")).alias("entry"), F.lit("markdown").alias("kind"),
                   F.encode("markdown", "UTF-8").alias("bytes"))
    ok = first
    meta = ok.select(package, F.lit("metadata.json").alias("entry"), F.lit("metadata").alias("kind"),
                     F.encode(F.coalesce("metadata", F.lit("{}")), "UTF-8").alias("bytes"))
    out = md.unionByName(meta)
    if media is not None:
        files = media.join(ok.select(package), package, "left_semi").select(
            package, F.concat(F.lit("media/"), F.col("name")).alias("entry"), F.lit("media").alias("kind"), F.col("bytes")
        )
        out = out.unionByName(files)
    return out
