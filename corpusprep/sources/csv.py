"""Delimited files: whole corpora by detected dialect, and Spark's CSV reader for TSV files and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.operators.records import record_lines
from corpusprep.operators.tables import SEPARATORS, parse_csv_lines, split_fields
from corpusprep.operators.types import column_types
from corpusprep.sources.folder import number_lines, read_lines


def read_csv_corpus(spark: SparkSession, folder: str, dialects: DataFrame, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Files of ``folder`` with their own separator (``dialects``: path, separator),
    all cells as text, in rows of any width: ``(path, row_id, cells ARRAY<STRING>)``, header included.

    Records may span lines inside quotes; files are read line by line, so they may be of any size. ``row_id`` is the number of
    a record's first line.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    lines = number_lines(reader.option("pathGlobFilter", glob) if glob else reader, folder)
    own = dialects.select("path", "separator")
    records = record_lines(lines, own, SEPARATORS).where(F.col("line") != "")
    cells = records.join(own, "path")
    return cells.select("path", F.col("ord").alias("row_id"), split_fields(F.col("line"), F.col("separator")).alias("cells"))


def read_tsv_corpus(spark: SparkSession, paths: list[str] | str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (``path, ord, fields, ncols, n_fields, bad``) and column types (``path, column, name, type``) of tab-separated files
    of any size, each with its own columns and types. :func:`corpusprep.operators.types.typed_frame` gives one file as columns."""
    lines = read_lines(spark, paths, glob)
    dialects = lines.select("path").distinct().withColumn("separator", F.lit("\t"))
    rows, headers = parse_csv_lines(record_lines(lines, dialects, SEPARATORS), dialects)
    return rows, column_types(rows, headers)


def read_tsv(spark: SparkSession, paths: list[str] | str, infer: bool = True) -> DataFrame:
    """Tab-separated files with a header, types inferred (as the original)."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", infer).csv(paths)


def read_bundle(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Translation bundles: comma separated, quoted, blanks after separators skipped, all text."""
    return (
        spark.read.option("sep", ",").option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True).option("multiLine", True).csv(paths)
    )
