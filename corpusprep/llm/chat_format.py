"""Chat formatting: collapse of cumulative snapshots, then rendering. DataFrame functions only.

A conversation that is logged again after each turn leaves snapshots that are
prefixes of longer ones. Each conversation's turns are numbered, and a rolling
hash (128 bits, the exclusive or of the hashes of number, role and text) stands
for every prefix. A conversation whose whole hash is a proper prefix of another
is dropped by an anti-join; of equal conversations the smallest id stays.

A conversation may be huge, and its turn numbers may be null or repeat. All rows are
put in one order over range partitions, which gives each its position. A block is a run
of at most ``BLOCK_ROWS`` positions inside a run of ``1 << BLOCK_BITS`` turn numbers, so it
is bounded whatever the numbers are. Turns are hashed and rendered in blocks; only a row
for each block is ordered over the whole conversation. A long one comes out as several
parts, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.operators.ordered import global_index
from corpusprep.session import materialize

#: Turn numbers of a block, as a power of two.
BLOCK_BITS = 9
#: Rows of a block at most; turn numbers that are null or repeat would make it longer.
BLOCK_ROWS = 512


def _hashes(*cols: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, block, number (from 1), role, text and the rolling hashes h1, h2 of the prefix that ends here.

    Turns are ordered by turn number (null last), role and text. A row logged
    twice counts once. A null role or text is empty. Rows without an id are one conversation.
    A block is the position of its first row in the order of the whole table.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    rows = global_index(rows, [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")], "at")
    # runs of turn numbers, in pieces of BLOCK_ROWS positions of the table: no key has more rows than that
    rows = rows.select("conv", F.shiftright("turn", BLOCK_BITS).alias("run"), F.floor(F.col("at") / BLOCK_ROWS).alias("piece"), "at", "role", "text")
    pieces = rows.groupBy("conv", "run", "piece").agg(F.min("at").alias("first"))
    starts = pieces.select(
        F.col("conv").alias("p_conv"), F.col("run").alias("p_run"), F.col("piece").alias("p_piece"),
        F.min("first").over(Window.partitionBy("conv")).alias("conv_start"), F.min("first").over(Window.partitionBy("conv", "run")).alias("run_start"),
    )
    own = (F.col("piece") == F.col("p_piece")) & F.col("conv").eqNullSafe(F.col("p_conv")) & F.col("run").eqNullSafe(F.col("p_run"))
    rows = rows.join(starts, own).select(
        "conv", (F.col("at") - (F.col("at") - F.col("run_start")) % BLOCK_ROWS).alias("block"), (F.col("at") - F.col("conv_start") + 1).alias("number"),
        "role", "text",
    )
    e1, e2 = _hashes(F.col("number"), F.col("role"), F.col("text"))
    rows = materialize(rows.withColumn("e1", e1).withColumn("e2", e2))

    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    start = totals.select("conv", "block", *(F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in (1, 2)))
    start = start.drop("conv").withColumnRenamed("block", "b_block")
    so_far = Window.partitionBy("block").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.select("conv", "block", "number", "role", "text", *(F.bit_xor(f"e{i}").over(so_far).alias(f"x{i}") for i in (1, 2)))
    rolled = rolled.join(start, F.col("block") == F.col("b_block"))
    return rolled.select("conv", "block", "number", "role", "text", *(F.col(f"x{i}").bitwiseXOR(F.col(f"s{i}")).alias(f"h{i}") for i in (1, 2)))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv, n_turns, n_copies of the conversations that are no proper prefix of another; turns: as ``numbered_turns`` returns.

    Of equal conversations the smallest id stays (null last).
    """
    whole = turns.groupBy("conv").agg(F.max(F.struct("number", "h1", "h2")).alias("end")).select("conv", "end.*")
    heads = whole.groupBy("number", "h1", "h2").agg(
        F.min(F.struct(F.col("conv").isNull().alias("none"), "conv")).alias("head"), F.count("*").alias("n_copies")
    )
    # every prefix, the whole conversation too; one that comes up as a whole only is no proper prefix
    prefixes = turns.groupBy("number", "h1", "h2").agg(F.count("*").alias("seen"))
    proper = heads.join(prefixes, ["number", "h1", "h2"]).where("seen > n_copies").select("number", "h1", "h2")
    kept = heads.join(proper, ["number", "h1", "h2"], "left_anti")
    return kept.select(F.col("head.conv").alias("conv"), F.col("number").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """conv_id, part (from 0), n_turns, n_copies, rendered of every maximal conversation.

    Parts hold the turns of a block each; joined in order they are the conversation. An
    empty table has an empty result.
    """
    numbered = materialize(numbered_turns(turns, conv_col, turn_col, role_col, text_col))
    keep = maximal_conversations(numbered)
    blocks = numbered.groupBy("conv", "block").agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("conv").orderBy("block")
    blocks = blocks.withColumn("part", F.row_number().over(in_order) - 1).drop("n")
    kept = keep.withColumnRenamed("conv", "k_conv")
    parts = blocks.join(kept, F.col("conv").eqNullSafe(F.col("k_conv"))).withColumnsRenamed({"block": "p_block"}).drop("k_conv", "conv")
    rows = numbered.join(parts, F.col("block") == F.col("p_block"))
    line = F.struct("number", rendered(F.col("role"), F.col("text")).alias("line"))
    return rows.groupBy(F.col("conv").alias("conv_id"), F.col("block").alias("_block"), "part", "n_turns", "n_copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "").alias("rendered")
    ).select("conv_id", F.col("part").cast("bigint").alias("part"), "n_turns", "n_copies", "rendered")


#: The same over ``conversations`` in DuckDB, with prefixes compared turn by turn instead of by hash. It doesn't cut a run
#: of turn numbers that has more than ``BLOCK_ROWS`` rows.
ORACLE = f"""
WITH r AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), t AS (
  SELECT *, turn >> {BLOCK_BITS} AS block, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS number FROM r
), s AS (
  SELECT conv_id, count(*) AS n_turns, list(struct_pack(role := role, text := text) ORDER BY number) AS said FROM t GROUP BY conv_id
), heads AS (
  SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM s GROUP BY said, n_turns
), prefixes AS (
  SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM s)
), kept AS (
  SELECT * FROM heads WHERE said NOT IN (SELECT said FROM prefixes)
)
SELECT t.conv_id, dense_rank() OVER (PARTITION BY t.conv_id ORDER BY t.block NULLS LAST) - 1 AS part, k.n_turns, k.n_copies,
  string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.number) AS rendered
FROM t JOIN kept AS k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY t.conv_id, t.block, k.n_turns, k.n_copies
"""
