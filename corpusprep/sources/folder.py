"""Folder sources: the file listing with contents, and text lines of delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from corpusprep.session import materialize


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Regular files of ``folder``: ``path, modificationTime, length, content``.

    Non-recursive by default (as the original); hidden ``_x``/``.x`` names are
    never listed by Spark. ``content`` is only read for the rows and columns a
    plan uses, so filter on ``path``/``length`` first.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def text_lines(files: DataFrame, path: str = "path", text_col: str = "text") -> DataFrame:
    """Decoded file text -> ``(path, ord, line)``; CR before LF dropped."""
    return files.select(path, F.posexplode(F.split(F.col(text_col), "\n")).alias("ord", "line")).withColumn(
        "line", F.regexp_replace("line", "\r$", "")
    ).withColumn("ord", F.col("ord").cast("bigint"))


def read_lines(spark: SparkSession, paths: list[str] | str, glob: str | None = None) -> DataFrame:
    """Lines ``(path, ord, line, encoding)`` of delimited files of any size; ``ord`` counts a file's lines from 0.

    ``spark.read.text`` splits a big file across tasks. A line's number is its place in its split plus the
    lines of the splits before, so nothing reads a file from its start. The encoding of a file is
    UTF-8 if all its lines are, else latin-1. The lines are written once into the shared checkpoint folder.
    """
    return number_lines(spark.read.option("pathGlobFilter", glob) if glob else spark.read, paths)


def number_lines(reader: DataFrameReader, paths: list[str] | str) -> DataFrame:
    """:func:`read_lines` through a reader with options of its own."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # as binaryFile spells it
    lines = materialize(reader.text(paths).select(
        path.alias("path"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").cast("binary").alias("_bytes"),
    ))
    # a row for each split of a file
    splits = lines.groupBy("path", "_split").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), F.bool_and(F.is_valid_utf8("_bytes")).alias("_utf8"))
    of_file = Window.partitionBy("path")
    earlier = of_file.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "path", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.min("_utf8").over(of_file).alias("_utf8")
    )
    text = F.when(F.col("_utf8"), F.col("_bytes").cast("string")).otherwise(F.decode("_bytes", "ISO-8859-1"))
    return lines.join(splits, ["path", "_split"]).select(
        "path", (F.col("_before") + F.col("_row") - F.col("_first")).alias("ord"), text.alias("line"),
        F.when(F.col("_utf8"), "utf-8").otherwise("latin-1").alias("encoding"),
    )


def read_image_sizes(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Sizes of image files any type the JVM decodes, by path: ``path, width, height``.

    Spark's built-in ``image`` source decodes each file on the executors; files
    it cannot decode are kept with width and height -1 (``dropInvalid`` off).
    """
    img = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return img.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))
