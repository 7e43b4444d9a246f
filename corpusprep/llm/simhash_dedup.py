"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints at most 2h bits apart have a value in common that is at most h
bits from each. So every distinct fingerprint emits all its variants within half
the radius, and fingerprints that share a variant are compared. The radius here
is odd, 2h + 1: the bits are split into blocks, one block at a time is erased,
and the variants are taken over the other bits. Erasing a block with a differing
bit leaves 2h differing bits at most, so the variants meet again. (With variants
of h and h + 1 bits on the two sides instead, a radius of 3 takes 2,146 rows a
fingerprint; this way it takes 196 with four blocks.)

Fingerprints, not documents, are linked, so a group of copies is one row. Of the
fingerprints under one variant only a spanning forest of verified links goes on,
never all pairs. Components are found by alternating large-star and small-star
steps, whose every row is an edge or a minimum.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.text_units import utf8
from corpusprep.session import materialize, release

SHINGLE = 3
RADIUS = 3
BLOCKS = 4
HASH_SEED = 42
_CHUNK = 1 << 16


def simhash(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats counted; 0 without words.

    A bit is set if it is set in over half of the shingles' XXH64 values. A text
    of fewer words than a shingle is one shingle.
    """
    words = (text if isinstance(text, bytes) else utf8(text)).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    take = min(shingle, len(words))
    starts, ends = starts[: len(words) - take + 1], ends[take - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        s, e = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(s, e, strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of id and text), fingerprint (the 64 bits as a bigint)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(x, shingle) for x in batch.column("units").to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(prints.view(np.int64))], ["doc_id", "key", "fingerprint"]
            )

    doc_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    keyed = docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("key"), text.cast("binary").alias("units"))
    return keyed.mapInArrow(scan, "doc_id bigint, key bigint, fingerprint bigint")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def ball(radius: int, blocks: int) -> list[tuple[int, np.ndarray]]:
    """For each way to erase bits: the mask of the bits left, and the changes within half the radius on them."""
    out = []
    for b in range(blocks if radius % 2 else 1):
        left = [i for i in range(64) if radius % 2 == 0 or not 64 * b // blocks <= i < 64 * (b + 1) // blocks]
        flips = [sum(1 << i for i in c) for h in range(radius // 2 + 1) for c in itertools.combinations(left, h)]
        out.append((sum(1 << i for i in left), np.array(flips, dtype=np.uint64)))
    return out


def variants(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """variant, fingerprint: every fingerprint under each of its variants."""
    balls = ball(radius, blocks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = batch.column("fingerprint").slice(at, 1000).to_numpy().view(np.uint64)
                for mask, flips in balls:
                    keys = ((own & np.uint64(mask))[:, None] ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64))], ["variant", "fingerprint"]
                    )

    return prints.select("fingerprint").mapInArrow(emit, "variant bigint, fingerprint bigint")


def _forest(members: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links (least member of the component, member) among fingerprints under one variant."""
    members = np.unique(members)
    root = np.arange(len(members))
    for i in range(len(members) - 1):
        near = np.flatnonzero(np.bitwise_count(members[i + 1 :] ^ members[i]) <= radius) + i + 1
        if len(near):
            joined = np.unique(np.append(root[near], root[i]))
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    linked = np.flatnonzero(root != np.arange(len(members)))
    return members[root[linked]].view(np.int64).tolist(), members[linked].view(np.int64).tolist()


def links(variant_rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: verified links that join the fingerprints as all pairs within the radius would."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        for batch in itertools.chain(batches, [None]):
            a: list[int] = []
            b: list[int] = []
            end = len(key)
            if batch is not None:
                key = np.concatenate([key, batch.column("variant").to_numpy()])
                own = np.concatenate([own, batch.column("fingerprint").to_numpy().view(np.uint64)])
                end = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            runs = np.flatnonzero(np.append(True, key[1:end] != key[: end - 1])) if end else np.empty(0, dtype=np.int64)
            sizes = np.diff(np.append(runs, end))
            pairs = runs[sizes == 2]
            near = pairs[(own[pairs] != own[pairs + 1]) & (np.bitwise_count(own[pairs] ^ own[pairs + 1]) <= radius)] if end else pairs
            a += np.minimum(own[near], own[near + 1]).view(np.int64).tolist()
            b += np.maximum(own[near], own[near + 1]).view(np.int64).tolist()
            for lo, n in zip(runs[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                x, y = _forest(own[lo : lo + n], radius)
                a += x
                b += y
            key, own = key[end:], own[end:]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    grouped = variant_rows.repartition("variant").sortWithinPartitions("variant")
    return grouped.mapInArrow(scan, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge (a, b)."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:  # until nothing changes: about as many rounds as a component's size has bits
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        # large star: the larger neighbours of a node go to the least one around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and it, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """doc_id, key, fingerprint (16 hex digits), component_id, first (whether the row is its component's first).

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` bits. A null text has fingerprint 0, like one without words. A
    null id never is a component's smallest unless all are null. Repeated rows
    are in one component; each has a row in the result, and all rows equal to
    the first in id and text count as first.
    """
    members = materialize(fingerprints(docs, shingle, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    prints = materialize(members.groupBy("fingerprint").agg(F.min(place).alias("least")))
    roots = components(materialize(links(variants(prints, radius, blocks), radius)))
    linked = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint")
    heads = linked.groupBy("root").agg(F.min("least").alias("head"))
    head = linked.join(heads, "root").select("fingerprint", "head")
    # written, so that the join below deals both sides out anew and can split a fingerprint with many documents
    known = materialize(prints.join(head, "fingerprint", "left").select("fingerprint", F.coalesce("head", "least").alias("head")))
    return members.join(known, "fingerprint").select(
        "doc_id", "key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"), (place == F.col("head")).alias("first"),
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The first document of each near-duplicate group, with all its columns; of repeated rows one stays."""
    groups = near_duplicate_groups(docs, shingle, radius, blocks, id_col, text_col)
    key, id_key = _unused(docs, "key"), _unused(docs, "id_key")
    stay = groups.where("first").select(F.col("key").alias(key), F.coalesce("doc_id", "key").alias(id_key)).distinct()
    doc_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    rows = docs.withColumn(key, row_key(doc_id, text)).withColumn(id_key, F.coalesce(doc_id, row_key(doc_id, text)))
    return rows.join(stay, [key, id_key], "left_semi").dropDuplicates([key, id_key]).select(*docs.columns)


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in itertools.chain([f"_{name}"], (f"_{name}{i}" for i in itertools.count())) if n not in taken)
