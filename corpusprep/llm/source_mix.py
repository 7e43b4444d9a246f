"""Mixing sources to target weights.

Tokens are counted per source, targets are set by weight, and a source's
repetition rate is its target over its size. A document is emitted floor(rate)
times, and once more with the rest of the rate as probability, drawn by a hash
of its id, so that reruns agree.

Targets share the total by weight, but none goes above ``most`` times its
source; what is left over is shared by weight among the others. With a level L
such that the sum of min(cap, L * weight) is the total, that is what a target
is; L rises in a few aggregates over the sources, of which only sums come to
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of sources that may be broadcast: some ten megabytes.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, draw (what the copy is drawn by: the id, or a hash of the text where it is null), source, size."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("draw"),
        F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"),
    )


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of each row by source (code points, null last) from 0, without bringing all sources to one task."""
    order = F.col("source").asc_nulls_last()
    placed = materialize(
        sources.repartitionByRange(order).sortWithinPartitions(order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    offset, offsets = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], offset))
        offset += r["count"]
    if not offsets:
        return placed.select("source", "source_size", F.col("place").alias("rank"))
    before = sources.sparkSession.createDataFrame(offsets, "part int, before bigint")
    return placed.join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("place")).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source in ``sizes`` (source, size).

    Sources in the order of their code points, null last, have the weights in turn.
    """
    ranked = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    turn = F.pmod(F.col("rank"), F.lit(len(weights)))
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, w).otherwise(weight)
    table = materialize(ranked.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * most))
    level, full = 0.0, -1
    while True:
        below = F.col("cap") < F.col("weight") * F.lit(level)
        r = table.agg(
            F.sum("source_size").alias("all"), F.count(F.when(below, 1)).alias("full"), F.sum(F.when(below, F.col("cap"))).alias("given"),
            F.sum(F.when(~below, F.col("weight"))).alias("weight"),
        ).first()
        if r["full"] == full or not r["weight"]:
            break
        full, level = r["full"], ((r["all"] or 0) - (r["given"] or 0)) / r["weight"]
    return table.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _copies(draw: Column, rate: Column, seed: int) -> Column:
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), draw), 11) / float(1 << 53)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def _rated(rows: DataFrame, targets: DataFrame, source: Column) -> DataFrame:
    """``rows`` with source_size, target, rate of their source."""
    right = targets.withColumnsRenamed({"source": "_of", "source_size": "_source_size", "target": "_target"})
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    return rows.join(right, source.eqNullSafe(F.col("_of"))).withColumn("_rate", rate).drop("_of")


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (size times the copies emitted), copies.

    A null text has size 0, and null sources are one source. Repeated rows are
    drawn alike, by their id. An empty table has an empty result.
    """
    sizes = materialize(document_sizes(docs, id_col, text_col, source_col))
    rated = _rated(sizes, materialize(source_targets(sizes, weights, most)), F.col("source"))
    rated = rated.withColumn("copies", _copies(F.col("draw"), F.col("_rate"), seed))
    return rated.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """The documents of the mix: each row as often as it is taken, numbered from 1 in ``copy_col``.

    If the table has a column of that name, the number's column has an underscore before its name (as many as it takes).
    """
    while copy_col.lower() in {c.lower() for c in docs.columns}:
        copy_col = f"_{copy_col}"
    sizes = materialize(document_sizes(docs, id_col, text_col, source_col).select("source", "size"))
    targets = materialize(source_targets(sizes, weights, most))
    draw = F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(F.col(text_col).cast("string")))
    # the table's columns go into a struct, so none can clash with those of the targets
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), draw.alias("_draw"), F.col(source_col).cast("string").alias("_src"))
    rated = _rated(rows, targets, F.col("_src")).withColumn("_copies", _copies(F.col("_draw"), F.col("_rate"), seed))
    taken = rated.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return taken.select("_row.*", F.col("_copy").alias(copy_col))
