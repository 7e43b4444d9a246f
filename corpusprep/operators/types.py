"""Types of the columns of delimited files, each file with its own.

Every cell is of a kind: missing, boolean, integer, float or text. A column's type is the least that holds all its cells:
integers and floats are floats, other mixtures are text, and a column without any value is text. The kinds seen are bits,
so a column folds by bitwise or: partial aggregates per file and column, whatever the file's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.common import col_of
from corpusprep.operators.tables import header_names, na_to_empty

BOOLEAN, INTEGER, FLOAT, TEXT = 1, 2, 4, 8


def kind_of(cell) -> Column:
    """Bit of the cell's kind; 0 for a missing one."""
    c = na_to_empty(col_of(cell))
    return (
        F.when(c == "", 0).when(c.rlike(r"^[+-]?[0-9]{1,18}$"), INTEGER)
        .when(c.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?$") | F.lower(c).isin("inf", "-inf"), FLOAT)
        .when(c.isin("true", "True", "TRUE", "false", "False", "FALSE"), BOOLEAN).otherwise(TEXT)
    )


def type_of(kinds) -> Column:
    """Spark type name of a column whose cells had these kinds."""
    k = col_of(kinds)
    return F.when(k == BOOLEAN, "boolean").when(k == INTEGER, "bigint").when(k.isin(FLOAT, FLOAT | INTEGER), "double").otherwise("string")


def column_types(rows: DataFrame, headers: DataFrame, path: str = "path") -> DataFrame:
    """``(path, column, name, type)``, columns from 0, of parsed rows (``path, fields, bad``) and headers (``path, names``)."""
    cells = rows.where(~F.col("bad")).select(path, F.posexplode("fields").alias("column", "cell"))
    kinds = cells.groupBy(path, "column").agg(F.bit_or(kind_of("cell")).alias("kinds"))
    names = headers.select(path, F.posexplode(header_names("names")).alias("column", "name"))
    return names.join(kinds, [path, "column"], "left").select(path, "column", "name", type_of(F.coalesce("kinds", F.lit(0))).alias("type"))


def typed_text(cell, type_: Column) -> Column:
    """A cell as its value is written: integers without sign of plus and leading zeros, floats with a point, True and False.

    Floats above 10,000,000 or below 0.001 stay as they are in the file. A missing cell is empty.
    """
    c = na_to_empty(col_of(cell))
    number = c.try_cast("double")
    plain = (F.abs(number) < 1e7) & ((F.abs(number) >= 1e-3) | (number == 0))
    return (
        F.when(c == "", c).when(type_ == "bigint", F.coalesce(c.try_cast("bigint").cast("string"), c))
        .when((type_ == "double") & plain, number.cast("string")).when(type_ == "boolean", F.initcap(c)).otherwise(c)
    )


def typed_rows(rows: DataFrame, types: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with their fields as :func:`typed_text`."""
    by_file = types.groupBy(path).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "type"))), lambda t: t["type"]).alias("_types"))
    zipped = F.arrays_zip(F.col("fields").alias("c"), F.slice("_types", F.lit(1), F.size("fields")).alias("t"))
    fields = F.when(F.col("_types").isNull() | F.col("bad"), F.col("fields")).otherwise(F.transform(zipped, lambda z: typed_text(z["c"], z["t"])))
    return rows.join(by_file, path, "left").withColumn("fields", fields).drop("_types")


def typed_frame(rows: DataFrame, types: DataFrame, file: str, path: str = "path") -> DataFrame:
    """One file's rows as columns of its own types, in the order of the file's columns."""
    columns = types.where(F.col(path) == file).orderBy("column").collect()  # as many as the file has columns
    cells = rows.where((F.col(path) == file) & ~F.col("bad"))
    value = lambda i: F.nullif(na_to_empty(F.try_element_at(F.col("fields"), F.lit(i + 1))), F.lit(""))
    return cells.select(*(value(c["column"]).try_cast(c["type"]).alias(c["name"]) for c in columns))
