"""Merkle manifest of a dataset: a root over all rows, and for every row the proof that it is in it.

A row's leaf is the SHA-256 of its fields. The leaves of a group (a language) stand in the
order of their ids, and every two consecutive nodes make a parent, level by level, up to the group's
root; the groups' roots, in the groups' order, make the root in the same way.

Levels are built as strings. An aligned block is 64 consecutive nodes, its level one hex string of
64 characters a node; the next level hashes the substrings of 128 characters, six levels
up to the block's root. The roots of blocks are the nodes of the next, 64 times smaller layer of blocks.
The sibling of a node is the 64 characters beside it, and a row's proof is the string of its block's
sibling segments, followed by that of its block's root among the roots, and so on. No
task sees more of a tree than blocks.

Null ids come first in a group, a null group first among groups; rows with equal ids follow the order
of their leaves, and equal rows have equal leaves, so any order of them gives the same tree. Each has a proof of
its own place. An empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.operators.ordered import global_index
from corpusprep.session import materialize

#: Levels in a block: 64 nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's CRC-32 this divides are tampered with in the audit.
TAMPER_EVERY = 7


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def document_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """group, id, leaf, claimed: the leaf of the row as an auditor finds it, here with 1 added to n_chars of some rows."""
    columns = {f: F.col(f) for f in fields}
    changed = columns | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}  # the largest long has a successor, too
    tampered = (F.crc32(F.col(id_col).cast("string")) % TAMPER_EVERY == 0) & F.col("n_chars").isNotNull()
    own = leaf(*columns.values())
    return docs.select(
        F.col(group_col).cast("string").alias("group"), F.col(id_col).alias("id"), own.alias("leaf"),
        F.when(tampered, leaf(*changed.values())).alias("claimed"),
    ).withColumn("claimed", F.coalesce("claimed", "leaf"))


#: Every level of a block from the lowest up, each a string; ``height`` is 0 for a node that is alone.
_ALL_LEVELS = f"""
aggregate(slice(sequence(1, {LEVELS}), 1, height), array(level), (done, k) -> concat(done, array(array_join(transform(
  sequence(0, int((length(element_at(done, -1)) - 1) div 128)), i -> sha2(substring(element_at(done, -1), i * 128 + 1, 128), 256)), ''))))"""

#: The node beside node ``x.pos`` of a block, on the level k - 1: empty if there is none.
_BESIDE = f"substring(levels[k - 1], int((shiftright(x.pos & {(1 << LEVELS) - 1}, k - 1) ^ 1) * 64 + 1), 64)"
_SIBLINGS = f"array_join(transform(slice(sequence(1, {LEVELS}), 1, height), k -> {_BESIDE}), '')"
_SIDES = f"""array_join(transform(slice(sequence(1, {LEVELS}), 1, height), k ->
  CASE WHEN shiftright(x.pos, k - 1) & 1 = 1 THEN 'l' WHEN {_BESIDE} = '' THEN '-' ELSE 'r' END), '')"""

#: The node that ``{node}`` and the siblings lead to.
_FOLDED = """
aggregate(slice(sequence(1, 1 + length(sides)), 1, length(sides)), named_struct('node', {node}, 'used', 0), (a, k) -> named_struct(
  'node', CASE substring(sides, k, 1)
    WHEN 'l' THEN sha2(concat(substring(siblings, a.used * 64 + 1, 64), a.node), 256)
    WHEN 'r' THEN sha2(concat(a.node, substring(siblings, a.used * 64 + 1, 64)), 256)
    ELSE sha2(a.node, 256) END,
  'used', a.used + CASE WHEN substring(sides, k, 1) = '-' THEN 0 ELSE 1 END), a -> a.node)"""


def folded(node: str) -> Column:
    """The root that the column ``node`` gives with the row's ``sides`` and ``siblings``."""
    return F.expr(_FOLDED.format(node=node))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks (tree, block, n, items, height, levels, root) of nodes (tree, n, pos, node, and more); n: nodes of the tree in this layer."""
    carried = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    blocks = nodes.groupBy("tree", F.shiftright("pos", LEVELS).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *carried))).alias("items")
    )
    # ceil(log2(n)) levels in the last layer of a tree, where its only block is
    own = F.when(F.col("n") > 1, F.least(F.length(F.bin(F.col("n") - 1)), F.lit(LEVELS))).otherwise(0)
    blocks = blocks.withColumn("height", own).withColumn("level", F.expr("array_join(items.node, '')"))
    return blocks.withColumn("levels", F.expr(_ALL_LEVELS)).drop("level").withColumn("root", F.expr("element_at(levels, -1)"))


def climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Layers of blocks over the trees' nodes; in the last every tree has one block, with its root. largest: nodes of the largest tree."""
    layers = [materialize(_blocks(nodes))]
    while largest > 1 << LEVELS:
        largest = -(-largest >> LEVELS)
        above = layers[-1].select("tree", F.ceil(F.col("n") / (1 << LEVELS)).alias("n"), F.col("block").alias("pos"), F.col("root").alias("node"))
        layers.append(materialize(_blocks(above)))
    return layers


def descend(layers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every node of the lowest layer with sides and siblings up to the top.

    tops: tree, sides and siblings above the tree's root, and more columns to hand down.
    """
    handed = [c for c in tops.columns if c not in ("tree", "sides", "siblings")]
    above = tops.withColumnsRenamed({"tree": "u_tree", "sides": "u_sides", "siblings": "u_siblings"}).withColumn("u_block", F.lit(0).cast("bigint"))
    for layer in reversed(layers):
        joined = layer.drop("root").join(above, (F.col("tree") == F.col("u_tree")) & (F.col("block") == F.col("u_block")))
        items = f"transform(items, x -> struct(x AS item, concat({_SIDES}, u_sides) AS sides, concat({_SIBLINGS}, u_siblings) AS siblings))"
        nodes = joined.select("tree", *handed, F.inline(F.expr(items))).select("tree", *handed, "sides", "siblings", "item.*")
        above = nodes.select(
            F.col("tree").alias("u_tree"), F.col("pos").alias("u_block"), F.col("sides").alias("u_sides"), F.col("siblings").alias("u_siblings"), *handed
        )
    return nodes


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (group, id, leaf, and more) with the tree's subroot (of the group), root, and each leaf's sides and siblings.

    sides has a character a level: the sibling stands left (l), right (r) or there is none (-); siblings are those there are.
    """
    extra = [c for c in leaves.columns if c not in ("group", "id", "leaf")]
    placed = global_index(materialize(leaves), ["group", "id", "leaf"], "at")
    groups = materialize(placed.groupBy("group").agg(F.min("at").alias("start"), F.count("*").alias("n")))
    largest, n_groups = groups.agg(F.max("n"), F.count("*")).first()
    named = groups.select(F.col("group").alias("g_group"), F.col("start").alias("tree"), "n")
    nodes = placed.join(named, F.col("group").eqNullSafe(F.col("g_group"))).select(
        "tree", "n", (F.col("at") - F.col("tree")).alias("pos"), F.col("leaf").alias("node"), "group", "id", *extra
    )
    layers = climb(nodes, largest or 0)

    # the groups' roots are the leaves of one more tree; a group's start orders it among the groups
    subroots = layers[-1].select(F.col("tree").alias("group_tree"), F.col("root").alias("node"))
    ranked = global_index(subroots, ["group_tree"], "pos").withColumn("tree", F.lit(0).cast("bigint")).withColumn("n", F.lit(n_groups))
    tops = climb(ranked, n_groups)
    crown = tops[-1].select("tree", "root", F.lit("").alias("sides"), F.lit("").alias("siblings"))
    above = descend(tops, crown).select(F.col("group_tree").alias("tree"), F.col("node").alias("subroot"), "root", "sides", "siblings")
    return descend(layers, materialize(above)).select("group", "id", F.col("node").alias("leaf"), "subroot", "root", "sides", "siblings", *extra)


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the claimed leaf with the original siblings), verified."""
    proofs = manifest(document_leaves(docs)).withColumn("folded_root", folded("claimed"))
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def verified(node: str, root: str) -> Column:
    """Whether a leaf leads to a root that was published apart from the table."""
    return folded(node) == F.lit(root)



def _field_sql(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(f if f != "n_chars" else n_chars) for f in FIELDS) + ")"


def _climb_sql(name: str, start: str) -> str:
    """Levels (tree, level, nodes) above the lists that ``start`` gives."""
    return f"""{name} AS (
  {start} UNION ALL
  SELECT tree, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM {name} WHERE len(nodes) > 1)"""


#: The audit over ``documents`` in DuckDB: every tree as lists of its levels, every proof folded level by level.
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b:
      list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) % {TAMPER_EVERY} = 0
      AND n_chars IS NOT NULL THEN {_leaf_sql('CAST(n_chars AS HUGEINT) + 1')} END AS claimed
  FROM documents
), placed AS (
  SELECT *, coalesce(claimed, leaf) AS node, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), {_climb_sql('levels', "SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY tree")},
subroots AS (SELECT tree, nodes[1] AS subroot, level AS height FROM levels WHERE len(nodes) = 1),
{_climb_sql('crown', "SELECT CAST(0 AS BIGINT) AS tree, 0 AS level, list(subroot ORDER BY tree) AS nodes FROM subroots HAVING count(*) > 0")},
top AS (SELECT nodes[1] AS root, level AS crown_height FROM crown WHERE len(nodes) = 1),
path AS (
  SELECT doc_id, lang, leaf, pos, tree, subroot, root, height + crown_height AS height, 0 AS level, node, '' AS siblings
  FROM placed JOIN subroots USING (tree), top
  UNION ALL
  SELECT doc_id, lang, leaf, pos, tree, subroot, root, height, level + 1,
    sha256(CASE WHEN place & 1 = 1 THEN coalesce(beside, '') || node ELSE node || coalesce(beside, '') END), siblings || coalesce(beside, '')
  FROM (
    SELECT x.*, y.place, y.nodes[xor(y.place, 1) + 1] AS beside
    FROM (SELECT path.*, h.own FROM path JOIN (SELECT tree, height AS own FROM subroots) AS h USING (tree) WHERE level < path.height) AS x
    JOIN LATERAL (
      SELECT CASE WHEN x.level < x.own THEN x.pos >> x.level ELSE (x.tree - 1) >> (x.level - x.own) END AS place,
        CASE WHEN x.level < x.own THEN l.nodes ELSE c.nodes END AS nodes
      FROM (SELECT 1) LEFT JOIN levels AS l ON l.tree = x.tree AND l.level = x.level LEFT JOIN crown AS c ON c.level = x.level - x.own
    ) AS y ON true))
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root, node = root AS verified FROM path WHERE level = height"""
