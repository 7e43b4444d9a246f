"""Best-fit packing of documents into token sequences of a fixed size.

A document is its token ids and an end id. One that is longer than a sequence is
cut into pieces of that size, the first of which takes what is over; others are one
piece. Packing needs only the lengths: the histogram of piece lengths (at most
``size`` counts, whatever the corpus) comes to the driver, and best fit by falling
length runs over the counts, many equal pieces into many equal rooms at a time. The
plan is a table of runs of slots, and a piece takes the slot of its rank among the
pieces of its length, by a join.

Null and empty texts are a document of the end id alone. Null or repeated ids,
equal rows and ties of length are packed like any other rows: every row gets its
own slots. An empty table has an empty result.

Ids are those of a byte-level BPE vocabulary file of the ``tokenizers`` library; special
tokens' strings in a text are ordinary text. They are computed with ``tiktoken`` from the
same file's vocabulary, which gives the same ids in a third of the time.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from corpusprep.operators.ordered import global_index
from corpusprep.session import materialize

SIZE = 1024
END_ID = 2
#: Characters of a text that are encoded at a time; a stretch goes on to the next white space.
STRETCH = 1 << 20
#: Pieces of an Arrow batch.
BATCH = 1 << 14

#: How byte-level BPE parts a text (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No token goes over from a character to white space after it. Python counts \x1c to \x1f as white space, the pattern doesn't.
_BREAK = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    """The encoding of a byte-level BPE file's text; a worker keeps it over its tasks."""
    spec = json.loads(vocabulary)
    special = {t["content"] for t in spec["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, length: int = STRETCH) -> Iterator[str]:
    """The text in parts that are encoded alike alone and together."""
    start = 0
    while len(text) - start > length:
        at = _BREAK.search(text, start + length)
        if not at:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def token_ids(text: str | None, vocabulary: str, end_id: int = END_ID) -> bytes:
    """Ids of the text and the end id, as unsigned 32-bit little-endian numbers."""
    encoding = _encoding(vocabulary)
    ids = b"".join(array("I", encoding.encode_ordinary(part)).tobytes() for part in stretches(text or ""))
    return ids + array("I", [end_id]).tobytes()


def document_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id",
                    text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32 and, with ``keep_ids``, ids of every document's pieces.

    tokenizer: path of the vocabulary file on the driver; its text is broadcast (some megabytes, whatever the corpus).
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [
        StructField("doc_id", rows.schema["doc_id"].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids_crc32", LongType()),
    ] + [StructField("ids", BinaryType())] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, schema = batch.column(0), [], None
            schema = pa.schema([
                pa.field("doc_id", ids.type), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()),
                pa.field("ids_crc32", pa.int64()),
            ] + [pa.field("ids", pa.binary())] * keep_ids)

            def flush(rows: list[tuple], ids: pa.Array = ids, schema: pa.Schema = schema) -> pa.RecordBatch:
                row, *columns = zip(*rows, strict=True)
                return pa.record_batch([ids.take(pa.array(row)), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

            for row, text in enumerate(batch.column(1)):
                tokens = memoryview(token_ids(text.as_py(), vocabulary.value, end_id))
                n = len(tokens) // 4
                first = (n - 1) % size + 1
                for piece, end in enumerate(range(first, n + 1, size)):
                    start = max(end - size, 0) if piece else 0
                    part = tokens[4 * start : 4 * end]
                    out.append((row, piece, start, end - start, zlib.crc32(part), *([bytes(part)] if keep_ids else [])))
                    if len(out) >= BATCH:
                        yield flush(out)
                        out = []
            if out:
                yield flush(out)

    return rows.mapInArrow(cut, StructType(fields))


def plan_slots(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit by falling length over counts: runs of slots, and the number of sequences.

    A run (length, first, n, sequence, each, offset) gives the pieces of that length ranked
    first to first + n - 1 places: ``each`` to a sequence, from ``offset`` on, in
    consecutive sequences. A step that isn't the last of its length empties a set of equal rooms or
    splits it once, so there are a few thousand sets of equal rooms at most, and a set holds
    at most 44 different lengths (1 + ... + 45 is above 1024): the plan's size is bounded by ``size``.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many) of the sequences that have it
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(room: int, length: int = length) -> None:
            nonlocal left, rank
            fit, sets = room // length, rooms[room]
            while left and sets:
                first, n = sets.pop()
                # whole rooms take ``fit`` pieces each, then one takes the rest
                for each, used in ((fit, min(n, left // fit)), (left % fit, 1)):
                    if not each or not used or not n or not left:
                        continue
                    each = min(each, left)
                    plan.append((length, rank, each * used, first, each, size - room))
                    if room - each * length:
                        rooms.setdefault(room - each * length, []).append((first, used))
                    rank, left, first, n = rank + each * used, left - each * used, first + used, n - used
                if n:
                    sets.append((first, n))

        for room in sorted(r for r, sets in rooms.items() if r >= length and sets):
            if left:
                place(room)
        if left:
            new = -(-left // (size // length))
            rooms.setdefault(size, []).append((sequences, new))
            sequences += new
            place(size)
    return plan, sequences


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``size``) with sequence_id and offset, both long, from 0."""
    spark = pieces.sparkSession
    # a number of its own for each row: equal rows of one length, however many, spread over range partitions
    table = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # ``size`` rows at most
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    plan = [(length, before[length] + first, before[length] + first + n - 1, sequence, each, offset)
            for length, first, n, sequence, each, offset in plan_slots(counts, size)[0]]
    slots = spark.createDataFrame(plan, "_length bigint, _first bigint, _last bigint, _sequence bigint, _each bigint, _offset bigint")
    # rank within length: the place in the order of lengths
    ranked = global_index(table, ["length", "_row"], "_at")
    taken = (F.col("length") == F.col("_length")) & F.col("_at").between(F.col("_first"), F.col("_last"))
    nth: Column = F.col("_at") - F.col("_first")
    packed = ranked.join(F.broadcast(slots), taken)  # the plan's size is bounded, see plan_slots
    return packed.select(
        *pieces.columns, (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).cast("bigint").alias("offset"),
    )


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, n_pieces, ids (unsigned 32-bit little-endian numbers) from packed pieces that kept their ids.

    A sequence is at most ``size`` tokens, so a group is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"),
        F.unhex(F.array_join(F.transform(ordered, lambda x: x["ids"]), "")).alias("ids"),
    )
