"""Routing: extension registry, processor choice, supported/skipped split, output names.

The registry is a fixed-size table (tens of rows), so it is always broadcast:
routing a corpus of any size is a map-side hash lookup with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusprep.config import DEFAULT, Settings
from corpusprep.functions.paths import extension, is_temp_file, package_name

# Processors and their extensions, in registration order (later
# registrations of the same extension win).
REGISTRATIONS: list[tuple[str, list[str]]] = [
    ("pdf", [".pdf"]),
    ("markdown", [".md", ".markdown"]),
    ("slides", [".pptx", ".ppt"]),
    ("tabular", [".csv", ".xlsx", ".xls", ".tsv"]),
    ("simple", [".txt", ".json", ".py", ".js", ".java", ".cs", ".c", ".cpp", ".go", ".rb", ".php", ".rs", ".kt", ".swift"]),
    ("converter", [".docx", ".doc", ".rtf", ".odt", ".epub", ".html", ".htm", ".org", ".tex", ".wiki"]),
]

# Formats the external converter takes; used only for extensions
# no processor claims, and only when the converter is present.
CONVERTER_FORMATS: list[str] = [
    ".docx", ".odt", ".epub", ".html", ".htm", ".rtf", ".tex", ".xml", ".csv", ".tsv", ".opml", ".org",
]

REGISTRY_SCHEMA = "ext string, processor string, ord int"


def extension_registry(spark: SparkSession, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """All registrations as rows ``(ext, processor, ord)``; ``extra`` appends user registrations."""
    rows = []
    ord_ = 0
    for processor, exts in REGISTRATIONS:
        for ext in exts:
            rows.append((ext, processor, ord_))
            ord_ += 1
    for ext, processor in extra or []:
        rows.append((ext.lower(), processor, ord_))
        ord_ += 1
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def resolve_registry(registry: DataFrame) -> DataFrame:
    """One processor per extension: the last registration wins."""
    w = Window.partitionBy("ext").orderBy(F.col("ord").desc())
    return registry.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "ord")


def register(registry: DataFrame, ext: str, processor: str) -> DataFrame:
    """Add a registration after all existing ones."""
    spark = registry.sparkSession
    nxt = registry.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("ord"))
    return registry.unionByName(
        nxt.select(F.lit(ext.lower()).alias("ext"), F.lit(processor).alias("processor"), F.col("ord").cast("int"))
    )


def converter_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in CONVERTER_FORMATS], "ext string")


def route(files: DataFrame, registry: DataFrame | None = None, path_col: str = "path",
          settings: Settings = DEFAULT) -> DataFrame:
    """Add ``ext``, ``processor``, ``supported`` to each file.

    Registered extension -> its processor; else a converter format (when the
    converter is on) -> ``converter``; else ``simple`` and ``supported = false``.
    """
    spark = files.sparkSession
    # the library's own table is small; of a table given, Catalyst knows the size
    reg = F.broadcast(resolve_registry(extension_registry(spark))) if registry is None else resolve_registry(registry)
    withext = files.withColumn("ext", extension(F.col(path_col)))
    out = withext.join(reg, "ext", "left")
    if settings.converter_formats:
        conv = converter_table(spark).withColumn("_conv", F.lit(True))
        out = out.join(F.broadcast(conv), "ext", "left")
        conv_hit = F.coalesce(F.col("_conv"), F.lit(False))
    else:
        conv_hit = F.lit(False)
    out = out.withColumn("supported", F.col("processor").isNotNull() | conv_hit).withColumn(
        "processor",
        F.coalesce(F.col("processor"), F.when(conv_hit, F.lit("converter")), F.lit("simple")),
    )
    return out.drop("_conv")


def can_process(files: DataFrame, registry: DataFrame | None = None, path_col: str = "path",
                settings: Settings = DEFAULT) -> DataFrame:
    """Files a registered processor takes: known extension and not a temp file.

    The spreadsheet processor additionally skips ``~$`` names (already covered by ``~``).
    """
    spark = files.sparkSession
    reg = resolve_registry(registry if registry is not None else extension_registry(spark)).select(F.col("ext").alias("_ext"))
    keyed = files.withColumn("_ext", extension(F.col(path_col)))
    kept = keyed.join(F.broadcast(reg) if registry is None else reg, "_ext", "left_semi")
    return kept.where(~is_temp_file(F.col(path_col))).drop("_ext")


def split_supported(files: DataFrame, registry: DataFrame | None = None, path_col: str = "path",
                    settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(supported, skipped). Supported = registered extension or converter format.

    With ``settings.skip_temp_files`` temp/system files go to the skipped side too.
    """
    routed = route(files, registry, path_col, settings)
    keep: Column = F.col("supported")
    if settings.skip_temp_files:
        keep = keep & ~is_temp_file(F.col(path_col))
    supported = routed.where(keep)
    skipped = routed.where(~keep).withColumn(
        "reason",
        F.when(F.col("supported"), F.lit("temporary or system file")).otherwise(
            F.concat(F.lit("unsupported extension: "), F.col("ext"))
        ),
    )
    return supported, skipped


def output_names(files: DataFrame, suffix: str = "", path_col: str = "path") -> DataFrame:
    """``package``, ``md_name`` (``<package>.md``) and ``zip_name`` (``<package>.zip``)."""
    pkg = package_name(F.col(path_col), suffix)
    return (
        files.withColumn("package", pkg)
        .withColumn("md_name", F.concat(F.col("package"), F.lit(".md")))
        .withColumn("zip_name", F.concat(F.col("package"), F.lit(".zip")))
    )


def name_collisions(named: DataFrame, path_col: str = "path") -> DataFrame:
    """Packages targeted by more than one source file.

    One row per colliding source with ``sources`` (how many share the package)
    and ``survivor`` (the greatest path keeps the package, so the result is
    deterministic where the reference's depends on listing order).
    """
    counts = named.groupBy("package").agg(
        F.count(F.lit(1)).alias("sources"), F.max(path_col).alias("survivor_path")
    ).where("sources > 1")
    return (
        named.select("package", F.col(path_col).alias("path"))
        .join(counts, "package")
        .withColumn("survivor", F.col("path") == F.col("survivor_path"))
        .drop("survivor_path")
    )
