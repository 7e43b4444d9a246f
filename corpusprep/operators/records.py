"""Records of delimited files whose quoted fields hold line breaks, from lines that any number of tasks have read.

Whether a line starts a record depends on the lines before it: an open quoted field may
go on into it. A line maps that state (0 outside, 1 inside a quoted field) to the state after it, and there
are four such maps: the state stays, it flips, or it is 0 or 1 whatever it was. So the
state before a line is the value of the last line of the third or fourth kind, flipped by the
parity of the flips since, which prefix sums give in blocks of lines and then over the blocks. Nothing
reads a file from its start, and only lines with a quote take part.

A quote that is never closed opens no record of several lines: from there on, every line is a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.common import col_of
from corpusprep.operators.ordered import group_index
from corpusprep.session import materialize

#: Lines of a block, as a power of two.
BLOCK_BITS = 12


def closed(record, sep: str) -> Column:
    """Whether every quoted field of the record is closed in it."""
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"[^{sep}]*+|[^"{sep}][^{sep}]*+|)'
    return col_of(record).rlike(rf"\A{field}(?:{sep}{field})*+\z")


def by_separator(of, separators: list[str], sep: Column) -> Column:
    """``of(s)`` for the row's separator: a literal pattern each, so none is compiled per row."""
    out = F.when(sep == separators[0], of(separators[0]))
    for s in separators[1:]:
        out = out.when(sep == s, of(s))
    return out


def _before(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``fixed`` (last ``value`` before the row, null for none) and ``odd`` (flips between it, or the start, and the row: odd or not)."""
    window = Window.partitionBy(*keys).orderBy(order)
    so_far, earlier = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_flips", F.sum("flip").over(so_far))
    set_at = F.when(F.col("value").isNotNull(), F.struct("value", "_flips"))
    last = summed.withColumn("_last", F.last(set_at, ignorenulls=True).over(earlier))
    odd = (F.col("_flips") - F.col("flip") - F.coalesce("_last._flips", F.lit(0))) % 2
    return last.withColumn("fixed", F.col("_last.value")).withColumn("odd", odd).drop("_flips", "_last")


def record_spans(lines: DataFrame, dialects: DataFrame, separators: list[str], path: str = "path") -> DataFrame:
    """``(path, first, last)``: the lines of every record that has several. ``lines``: ``(path, ord, line)``, numbered from 0."""
    quoted = lines.where(F.col("line").contains('"')).join(dialects.select(path, "separator"), path)
    alone = by_separator(lambda s: closed("line", s), separators, F.col("separator"))
    inside = by_separator(lambda s: closed(F.concat(F.lit('"'), F.col("line")), s), separators, F.col("separator"))
    maps = quoted.select(path, "ord", alone.alias("a"), inside.alias("b")).where("NOT (a AND NOT b)").select(
        path, "ord", F.shiftright("ord", BLOCK_BITS).alias("block"),
        F.when(F.col("a") & F.col("b"), 0).when(~F.col("a") & ~F.col("b"), 1).alias("value"), (~F.col("a") & F.col("b")).cast("int").alias("flip"),
    )
    maps = materialize(_before(maps, [path, "block"], "ord"))
    # a block as one map: that of its last line
    value, flip = F.coalesce("value", "fixed"), F.when(F.col("value").isNotNull(), 0).otherwise((F.col("odd") + F.col("flip")) % 2)
    ends = maps.groupBy(path, "block").agg(F.max_by(F.struct(value.alias("v"), flip.alias("f")), "ord").alias("end"))
    blocks = ends.select(
        path, "block", ((F.col("end.v") + F.col("end.f")) % 2).alias("value"), F.when(F.col("end.v").isNull(), F.col("end.f")).otherwise(0).alias("flip")
    )
    starts = _before(blocks, [path], "block").select(path, "block", ((F.coalesce("fixed", F.lit(0)) + F.col("odd")) % 2).alias("start"))
    states = maps.join(starts, [path, "block"]).withColumn("was", (F.coalesce("fixed", "start") + F.col("odd")) % 2)
    states = states.withColumn("then", F.coalesce("value", (F.col("was") + F.col("flip")) % 2))
    # a record of several lines opens where the state turns to 1 and ends where it turns to 0; the two alternate
    turns = group_index(states.where("was != then").select(path, "ord"), [path], ["ord"], "k")
    spans = turns.groupBy(path, F.shiftright("k", 1).alias("k")).agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("n"))
    return spans.where("n = 2").select(path, "first", "last")


def record_lines(lines: DataFrame, dialects: DataFrame, separators: list[str], path: str = "path") -> DataFrame:
    """Records ``(path, ord, line)`` of ``lines``; ``ord`` is that of the first line, the lines of a record are joined by line breaks."""
    spans = record_spans(lines, dialects, separators, path)
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    # a mark stands where a record opens and, for one that goes on into other blocks, at their starts
    cut = spans.select(path, "first", "last", F.explode(F.sequence(block("first"), block("last"))).alias("_block"))
    marks = cut.select(path, "_block", F.greatest("first", F.shiftleft("_block", BLOCK_BITS)).alias("ord"), F.lit(None).cast("string").alias("line"),
                       F.struct("first", "last").alias("_mark"))
    rows = lines.select(path, block("ord").alias("_block"), "ord", "line", F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"))
    earlier = Window.partitionBy(path, "_block").orderBy("ord", F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = marks.unionByName(rows).withColumn("_in", F.last("_mark", ignorenulls=True).over(earlier)).where(F.col("_mark").isNull())
    member = F.coalesce(F.col("ord") <= F.col("_in.last"), F.lit(False))
    held = held.select(path, "_block", "ord", "line", F.when(member, F.col("_in.first")).alias("_first"), F.when(member, F.col("_in.last")).alias("_last"),
                       F.when(~member, F.monotonically_increasing_id()).alias("_alone"))
    # the lines of a block are in one task already, so that its pieces of records need no other shuffle
    said = F.array_sort(F.collect_list(F.struct("ord", "line")))
    text = lambda whole: F.array_join(F.transform(whole, lambda x: x["line"]), "\n")
    keys = [path, "_block", "_first", "_last", "_alone"]
    pieces = held.groupBy(*keys).agg(said.alias("_said")).select(
        *keys, F.coalesce("_first", F.col("_said")[0]["ord"]).alias("ord"),
        F.when(F.col("_alone").isNotNull(), F.col("_said")[0]["line"]).otherwise(text(F.col("_said"))).alias("line"),
    )
    pieces = materialize(pieces)
    whole = F.col("_alone").isNotNull() | (block("_first") == block("_last"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "line")))
    joined = pieces.where(~whole).groupBy(path, "ord").agg(text(parts).alias("line"))
    return pieces.where(whole).select(path, "ord", "line").unionByName(joined.select(path, "ord", "line"))
