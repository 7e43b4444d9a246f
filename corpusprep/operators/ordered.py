"""Ordered work inside groups that stays parallel when one group is huge.

A window ``partitionBy(group)`` sends a whole group to one task, so a group
holding a third of all rows would serialise the job. These helpers split each
group into blocks of ``block`` consecutive order keys: per-block work runs in
parallel, and only one small row per block reaches the per-group step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.session import materialize

BLOCK = 4096


def _block(order_col: str, block: int):
    return F.floor(F.col(order_col) / F.lit(block)).cast("bigint")


def running_sum_before(df: DataFrame, group_cols: list[str], order_col: str, value_col: str, out_col: str,
                       block: int = BLOCK) -> DataFrame:
    """``out_col`` = sum of ``value_col`` over earlier rows of the group (by ``order_col``).

    Two-level scan: block totals (partial aggregate) -> prefix over blocks
    (one row per block) -> prefix inside each block (at most ``block`` rows).
    """
    blk = "_blk"
    d = df.withColumn(blk, _block(order_col, block))
    totals = d.groupBy(*group_cols, blk).agg(F.sum(value_col).alias("_bsum"))
    wb = Window.partitionBy(*group_cols).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_boff", F.coalesce(F.sum("_bsum").over(wb), F.lit(0))).drop("_bsum")
    wi = Window.partitionBy(*group_cols, blk).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    inner = d.withColumn("_ioff", F.coalesce(F.sum(value_col).over(wi), F.lit(0)))
    return (
        inner.join(offsets, [*group_cols, blk])
        .withColumn(out_col, (F.col("_boff") + F.col("_ioff")).cast("bigint"))
        .drop(blk, "_boff", "_ioff")
    )


def ordered_concat(df: DataFrame, group_cols: list[str], order_col: str, value_col: str, sep: str, out_col: str,
                   block: int = BLOCK) -> DataFrame:
    """One string per group: ``value_col`` joined with ``sep`` in ``order_col`` order.

    Blocks are joined in parallel first; the group step joins block strings.
    """
    blk = "_blk"
    d = df.withColumn(blk, _block(order_col, block))

    def joined(order_c, value_c):
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order_c, value_c))), lambda s: s[value_c]), sep
        )

    parts = d.groupBy(*group_cols, blk).agg(joined(order_col, value_col).alias("_part"))
    return parts.groupBy(*group_cols).agg(joined(blk, "_part").alias(out_col))


def _range_placed(df: DataFrame, order_cols: list[str], partitions: int | None) -> DataFrame:
    """``df`` with ``_pid`` and ``_place``: range partition in ``order_cols`` order, and position in it from 0.

    Written once into the shared checkpoint folder: bounds of a range partitioning come from a
    sample of the columns that a branch keeps, so two branches of a plan would disagree.
    """
    ranged = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    placed = ranged.sortWithinPartitions(*order_cols).withColumn("_pid", F.spark_partition_id())
    # the id's low 33 bits count the rows of a partition
    return materialize(placed.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def global_index(df: DataFrame, order_cols: list[str], out_col: str = "index", partitions: int | None = None,
                 total_col: str | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order, without a single-task window.

    Rows are range-partitioned and sorted; each range partition numbers its
    rows locally, and the partition sizes (one row per partition) give the
    offsets and, with ``total_col``, the row count.
    """
    placed = _range_placed(df, order_cols, partitions)
    # the sizes table has one row per partition: bounded by the partition count
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_total", F.sum("_n").over(Window.partitionBy())).drop("_n")
    out = placed.join(F.broadcast(offs), "_pid").withColumn(out_col, (F.col("_off") + F.col("_place")).cast("bigint"))
    if total_col:
        out = out.withColumn(total_col, F.col("_total").cast("bigint"))
    return out.drop("_pid", "_place", "_off", "_total")


def group_index(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str = "index") -> DataFrame:
    """0-based position of each row in its group in ``order_cols`` order; a huge group is spread over tasks.

    The global position, less that of the group's first row.
    """
    indexed = global_index(df, [*group_cols, *order_cols], "_global")
    # written, so that its size is known: few groups are broadcast, and no task gets a whole group
    start = materialize(indexed.groupBy(*group_cols).agg(F.min("_global").alias("_start")))
    return indexed.join(start, group_cols).withColumn(out_col, F.col("_global") - F.col("_start")).drop("_global", "_start")
