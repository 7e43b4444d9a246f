"""Prefix trie of conversations, by collapse of whole sequences.

A conversation's turns have rolling 128-bit hashes, one for each prefix; that of the
whole conversation stands for its sequence. Identical conversations make one sequence with a
weight and a list of the conversations that end there. A sequence that is a proper
prefix of another is dropped by an anti-join; the others are the leaves. A node of the
trie is a distinct prefix, and all its figures are sums and minima over the weighted
sequences that start with it:

* a sequence is the *owner* of a node if its smallest conversation is the smallest of the node.
  A sequence that owns a node owns all deeper ones on its way, so the depth of the first that it owns says it all;
* a node's children are counted by their owners, its leaves by the leaf sequences;
* what a subtree saves is the words of all its members' turns from the node on, once for each conversation,
  less the words of its distinct nodes, once for each owner. Both are words of one sequence from a depth on.

So a few aggregates by prefix make the trie, whatever its depth. A conversation or a node may hold a
third of all rows: turns are hashed and summed in blocks of ``1 << BLOCK_BITS``, prefixes are aggregated with partial sums,
and what many children look up at one parent is salted.

Turns are ordered by turn number (null first), turns with equal numbers by the SHA-256 of their role and text; a row logged
twice is two turns. A null role or text is empty. Rows without a conversation id belong to no conversation and are left out. An empty
table has an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.source_mix import n_words
from corpusprep.operators.ordered import global_index
from corpusprep.session import materialize

#: Turns of a block, as a power of two.
BLOCK_BITS = 9
#: Keys that the children of one node are spread over.
SALT = 64
#: Conversation ids of one string of an end list.
RUN = 256

#: Conversations of a family share their first turns: 20 ids each, 0 to 3 turns by the id's CRC-32.
FAMILY = 20
SHARED = 4


def _turns(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, at (place in the order of all turns), digest, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = table.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), n_words(text).alias("words"),
    ).where("conv IS NOT NULL")
    # the texts are read once, and only their digests move
    return global_index(materialize(rows), ["conv", F.col("turn").asc_nulls_first(), "digest"], "at").drop("turn")


def rebuilt_conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, number, digest, words of conversations that share the first turns of their family's first.

    Conversation c has the first h turns of c - c % 20 (h: CRC-32 of c, modulo 4), then its own without its first h.
    Every conversation has a row with number 0, which stands for the empty prefix; turns count from 1.
    """
    turns = _turns(table, conv_col, turn_col, role_col, text_col)
    piece = F.shiftright("at", BLOCK_BITS).alias("piece")
    pieces = materialize(turns.groupBy("conv", piece).agg(F.min("at").alias("first"), F.count("*").alias("n")))
    convs = pieces.groupBy("conv").agg(F.min("first").alias("start"), F.sum("n").alias("n")).select(
        "conv", "start", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(SHARED)).alias("h")
    )
    bases = convs.select(F.col("conv").alias("b_conv"), F.col("n").alias("b_n"))
    convs = materialize(convs.join(bases, F.col("base") == F.col("b_conv"), "left").select(
        "conv", "start", "base", "h", F.least("h", F.coalesce("b_n", F.lit(0))).alias("lent")
    ))
    # a conversation of any length: its facts reach its turns by pieces
    facts = pieces.join(convs, "conv").select(F.col("conv").alias("p_conv"), F.col("piece").alias("p_piece"), "start", "h", "lent")
    placed = turns.join(facts, (F.col("conv") == F.col("p_conv")) & (F.shiftright("at", BLOCK_BITS) == F.col("p_piece")))
    placed = placed.withColumn("number", F.col("at") - F.col("start") + 1)
    own = placed.where("number > h").select("conv", (F.col("number") - F.col("h") + F.col("lent")).alias("number"), "digest", "words")
    heads = placed.where((F.col("number") < SHARED) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("b_conv"), "number", "digest", "words")
    lent = convs.join(heads, F.col("base") == F.col("b_conv")).where("number <= h").select("conv", "number", "digest", "words")
    empty = convs.select("conv", F.lit(0).cast("bigint").alias("number"), F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("words"))
    return own.unionByName(lent).unionByName(empty)


def _hashes() -> list[Column]:
    """Two hashes of a turn at its place; the row of the empty prefix has none."""
    return [F.when(F.col("number") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(i), "number", "digest")).alias(f"e{i}") for i in (1, 2)]


def _block() -> Column:
    return F.shiftright("number", BLOCK_BITS).alias("block")


def collapsed(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences, the end list and the prefixes of the sequences, from ``turns`` (conv, number, digest, words).

    sequences: depth, h1, h2, head (smallest conversation), weight, total (words);
    ends: depth, h1, h2, conv; prefixes: head, block, number, h1, h2, before (words of earlier turns), words,
    depth, weight, total.
    """
    rows = materialize(turns.select("conv", _block(), "number", "words", *_hashes()))
    totals = materialize(rows.groupBy("conv", "block").agg(
        F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"), F.sum("words").alias("t_words"), F.max("number").alias("last")
    ))
    ends = totals.groupBy("conv").agg(
        F.max("last").alias("depth"), F.bit_xor("t1").alias("h1"), F.bit_xor("t2").alias("h2"), F.sum("t_words").alias("total")
    )
    ends = materialize(ends)
    sequences = materialize(ends.groupBy("depth", "h1", "h2").agg(
        F.min("conv").alias("head"), F.count("*").alias("weight"), F.min("total").alias("total")
    ))
    earlier = Window.partitionBy("head").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.join(sequences, F.col("conv") == F.col("head")).select(
        "head", F.col("block").alias("s_block"), "depth", "weight", "total",
        *(F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in (1, 2)),
        F.coalesce(F.sum("t_words").over(earlier), F.lit(0)).alias("s_words"),
    )
    joined = rows.join(blocks, (F.col("conv") == F.col("head")) & (F.col("block") == F.col("s_block")))
    so_far = Window.partitionBy("conv", "block").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = joined.select(
        "head", "block", "number", "depth", "weight", "total", "words",
        *(F.bit_xor(f"e{i}").over(so_far).bitwiseXOR(F.col(f"s{i}")).alias(f"h{i}") for i in (1, 2)),
        (F.col("s_words") + F.sum("words").over(so_far) - F.col("words")).alias("before"),
    )
    return sequences, ends.select("depth", "h1", "h2", "conv"), materialize(prefixes)


def prefix_trie(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and end list of the trie over ``turns`` (conv, number, digest, words), see ``rebuilt_conversations``.

    nodes: depth, h1, h2 (the prefix), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens; ends: depth, h1, h2, conv for each conversation that ends at a node.
    """
    sequences, ends, rows = collapsed(turns)
    key = ["number", "h1", "h2"]
    firsts = materialize(rows.groupBy(*key).agg(F.min("head").alias("owner"), F.max(F.col("number") < F.col("depth")).alias("goes_on")))

    # leaves: sequences that aren't proper prefixes of others
    proper = firsts.where("goes_on").select(F.col("number").alias("depth"), "h1", "h2")
    leaves = sequences.join(proper, ["depth", "h1", "h2"], "left_anti").select(F.col("head").alias("l_head"))
    owned = firsts.groupBy(F.col("owner").alias("o_head")).agg(F.min("number").alias("from"))
    facts = sequences.join(owned, F.col("head") == F.col("o_head"), "left").join(leaves, F.col("head") == F.col("l_head"), "left").select(
        "head", F.coalesce("from", F.col("depth") + 1).alias("from"), "depth", F.col("l_head").isNotNull().alias("leaf")
    )
    # the prefix before the first node of its own: its hashes, and the words up to there
    last_shared = rows.select(
        F.col("head").alias("r_head"), (F.col("number") + 1).alias("r_from"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), (F.col("before") + F.col("words")).alias("shared")
    )
    facts = materialize(facts.join(last_shared, (F.col("head") == F.col("r_head")) & (F.col("from") == F.col("r_from")), "left").drop("r_head", "r_from"))

    # facts of a sequence reach its prefixes by blocks
    by_block = rows.select("head", "block").distinct().join(facts.select("head", "from", "leaf", F.coalesce("shared", F.lit(0)).alias("shared")), "head")
    owns = F.col("number") >= F.col("from")
    rest = F.col("total") - F.col("before")
    nodes = rows.join(by_block, ["head", "block"]).groupBy(*key).agg(
        F.min("head").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum(((F.col("number") + 1 >= F.col("from")) & (F.col("number") < F.col("depth"))).cast("bigint")).alias("n_children"),
        F.sum(F.col("leaf").cast("bigint")).alias("n_leaves"),
        F.sum(F.col("weight") * rest - F.when(owns, rest).otherwise(F.col("total") - F.col("shared"))).alias("saved_tokens"),
    )

    # a sequence owns the parents of all its nodes but the first
    salt = F.pmod(F.xxhash64("head"), F.lit(SALT))
    lookups = facts.where("from BETWEEN 1 AND depth").select("head", "from", (F.col("from") - 1).alias("number"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), salt.alias("salt"))
    found = lookups.select(*key, "salt").distinct().join(firsts.select(*key, F.col("owner").alias("parent")), key)
    parents = lookups.join(found, [*key, "salt"]).select(F.col("head").alias("f_head"), F.col("from").alias("f_depth"), "parent")
    nodes = nodes.join(parents, (F.col("conv_id") == F.col("f_head")) & (F.col("number") == F.col("f_depth")), "left")
    return nodes.select(
        F.col("number").alias("depth"), "h1", "h2", "conv_id", F.when(F.col("number") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
    ), ends


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's strings, comma-joined, from rows in the order of (depth, h1, h2, run): one string at a time."""
    group, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([v], pa.int64()) for v in group] + [pa.array([digest.hexdigest()])], names=["depth", "h1", "h2", "ends_sha256"])

    for batch in batches:
        for *own, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != group:
                if group:
                    yield done()
                group, digest = own, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if group:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, h1, h2, ends_sha256: of the ids that end at a node, ascending, comma-joined.

    Runs of ``RUN`` ids become strings in parallel. A digest is made from first to last, so the strings of one node pass through one task,
    one after the other.
    """
    key = ["depth", "h1", "h2"]
    placed = global_index(ends, [*key, "conv"], "at")
    runs = placed.groupBy(*key, F.floor(F.col("at") / RUN).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    ordered = runs.repartition(*key).sortWithinPartitions(*key, "run").select(*key, "ids")
    return ordered.mapInArrow(_digests, "depth bigint, h1 bigint, h2 bigint, ends_sha256 string")


def trie_digest(table: DataFrame) -> DataFrame:
    """The trie's nodes with the digest of their end lists, as registered."""
    nodes, ends = prefix_trie(rebuilt_conversations(table))
    listed = nodes.join(end_digests(ends), ["depth", "h1", "h2"], "left")
    return listed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: The same over ``conversations`` in DuckDB: sequences as lists, a subtree as all lists that start with the node's.
ORACLE = f"""
WITH r AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS said FROM r GROUP BY c
), k AS (
  SELECT c, said, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b:
    list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) % {SHARED} AS h FROM s
), b AS (
  SELECT k.c, coalesce(p.said[1:k.h], []) || k.said[k.h + 1:] AS said FROM k LEFT JOIN s AS p ON p.c = k.c - k.c % {FAMILY}
), p AS (
  SELECT c, unnest(range(0, len(said) + 1)) AS depth, said FROM b
), n AS (
  SELECT depth, said[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(said) = depth) AS ends
  FROM p GROUP BY ALL
), w AS (
  SELECT *, (n_convs - 1) * coalesce(len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')), 0) AS saved,
    NOT EXISTS (SELECT 1 FROM n AS x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS leaf FROM n
), t AS (
  SELECT n.depth, n.path, sum(w.saved) AS saved_tokens, count(*) FILTER (WHERE w.leaf) AS n_leaves, count(*) FILTER (WHERE w.depth = n.depth + 1) AS n_children
  FROM n JOIN w ON w.depth >= n.depth AND w.path[1:n.depth] = n.path GROUP BY ALL
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN t ON t.depth = n.depth AND t.path = n.path LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.path = n.path[1:n.depth - 1]"""
