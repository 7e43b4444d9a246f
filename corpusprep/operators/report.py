"""Per-file outcomes and the batch report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.operators.ordered import global_index


FAILED = "Failed to process"


def status_of(skip: Column, produced: Column, reason: Column) -> tuple[Column, Column]:
    """Status and message of a file."""
    status = F.when(skip, "skipped").when(produced, "ok").otherwise("failed")
    return status, F.when(skip, "Skipping unsupported file").when(produced, "Successfully processed").otherwise(reason)


def outcomes(routed: DataFrame, docs: DataFrame, key: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(path, parser, status, message)``: ``skipped`` for unsupported or temp
    files, ``failed`` when no Markdown came out (or it is empty), else ``ok``.
    A failure never stops the batch: it is just a row. ``keep``: more columns of ``routed``."""
    first = docs.where("part_no = 0") if "part_no" in docs.columns else docs
    j = routed.select(key, *keep, "processor", "_skip").join(first.select(key, "parser", "markdown", "error"), key, "left")
    produced = F.col("markdown").isNotNull() & (F.length("markdown") > 0)
    status, message = status_of(F.col("_skip"), produced, F.coalesce(F.col("error"), F.lit(FAILED)))
    return j.select(key, *keep, F.coalesce(F.col("parser"), F.col("processor")).alias("parser"), status.alias("status"), message.alias("message"))


def batch_report(outs: DataFrame) -> DataFrame:
    """Per parser: files found (not skipped), ok, failed."""
    found = outs.where(F.col("status") != "skipped")
    return found.groupBy("parser").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def progress(outs: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """Running percent ``(i + 1) / n * 100`` in path order over the files processed."""
    order_cols = order_cols or ["path"]
    found = outs.where(F.col("status") != "skipped").select(*order_cols)
    idx = global_index(found, order_cols, "_i", total_col="_n")
    return idx.select(*order_cols, ((F.col("_i") + 1) / F.col("_n") * 100).alias("percent"))
