"""Sink: documents as Markdown + metadata rows, partitioned by parser."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_markdown(docs: DataFrame, out_dir: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """``(package, source_filename, parser, markdown, metadata, error)`` rows under
    ``<out_dir>/parser=<parser>/`` in ``fmt`` (json or parquet)."""
    cols = [c for c in ("package", "source_filename", "parser", "markdown", "metadata", "error") if c in docs.columns]
    docs.select(*cols).write.mode(mode).partitionBy("parser").format(fmt).save(out_dir)
