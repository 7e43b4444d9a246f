"""Finding repeated windows of a corpus without shuffling the corpus by window.

Shared by the two substring deduplications. A window is a number of consecutive
units (words or bytes) of one document. All work is routed by *anchors*: each
window selects the least hash among its short grams, and runs of neighbouring
windows with the same selection form a *context* (see ``text_units.contexts``).
Equal windows have equal anchors, so they meet under one key, with one row for
some tens of windows:

1. count anchors (partial aggregates) and keep those that occur twice;
2. list, for each document, its repeated anchors, and write out its contexts
   under them as hashes with positions;
3. fold identical contexts into one with a count and the first occurrence: all
   windows of such copies repeat;
4. where an anchor has several distinct contexts, bring their units to the
   anchor's shard, in which a judge (a suffix automaton or a suffix array)
   decides on their windows;
5. an anchor with more distinct contexts than one task should hold is settled
   by counting its windows one by one, with partial aggregates, instead;
6. bring the decided spans back to the documents.

Every step is keyed by anchor, context or document, so the work is linear in
the corpus. Copies fold before they meet: no step holds all copies of a passage
in one task. Positions are exact; 64-bit hashes identify grams and 128 bits
(anchor and context) identify contexts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.text_units import byte_prefix, contexts, packs, prefix_hash, span_hash, words_of
from corpusprep.session import materialize, release

#: Bytes of context units that one shard holds, on average: its automaton or its ranks stay in the cache.
SHARD_BYTES = 1 << 17
#: Distinct contexts of one anchor that go to a shard; an anchor with more is settled window by window.
CONTEXTS_PER_ANCHOR = 2000

#: judge(units of distinct contexts, their windows, their counts, order of their first occurrences) -> window starts in each
#: that are to go at its first occurrence
Judge = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, units (UTF-8 bytes of the text, null as it is) and the key (k1, k2) of a document: its id, or a hash of
    the text where that is null, and a hash of both."""
    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("k1"), F.xxhash64(doc_id, text).alias("k2"),
        text.cast("binary").alias("units"),
    )


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(batch: pa.RecordBatch, unit: str, window: int, gram: int) -> Iterator:
    texts = [x or b"" for x in batch.column("units").to_pylist()]
    for pack in packs(texts, unit, window):
        found = contexts(pack, unit, window, gram)
        if found is not None:
            yield found


def repeated_anchors(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """k1 and the sorted anchors of that document that occur twice or more in the corpus."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1 = batch.column("k1").to_numpy()
            for run in _runs(batch, unit, window, gram):
                yield pa.RecordBatch.from_arrays([_signed(run.anchor), pa.array(k1[run.row])], ["anchor", "k1"])

    placed = materialize(docs.select("k1", "units").mapInArrow(place, "anchor bigint, k1 bigint"))
    # written first, so that the join below deals both sides out anew and can split a hot anchor
    repeated = materialize(placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    anchors = placed.join(repeated, "anchor", "left_semi").groupBy("k1").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))
    anchors = materialize(anchors)
    release(placed, repeated)
    return anchors


def occurrences(docs: DataFrame, anchors: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """Contexts under repeated anchors: anchor, context, k1, k2, start (unit in the document), windows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            wanted = batch.column("anchors")
            offsets, values = wanted.offsets.to_numpy(), wanted.values.to_numpy()
            # one sorted table of (row, anchor) pairs; rows come in order and their anchors are sorted
            for run in _runs(batch, unit, window, gram):
                anchor, keep = run.anchor.view(np.int64), np.zeros(len(run.anchor), dtype=bool)
                for row, lo, hi in _groups(run.row):
                    own = values[offsets[row] : offsets[row + 1]]
                    at = np.searchsorted(own, anchor[lo:hi])
                    keep[lo:hi] = own[np.minimum(at, len(own) - 1)] == anchor[lo:hi]
                row = run.row[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[keep]), _signed(run.context[keep]), pa.array(k1[row]), pa.array(k2[row]),
                     pa.array(run.start[keep].astype(np.int64)), pa.array(run.windows[keep].astype(np.int32))],
                    ["anchor", "context", "k1", "k2", "start", "windows"],
                )

    joined = docs.select("k1", "k2", "units").join(anchors, "k1")
    return joined.mapInArrow(place, "anchor bigint, context bigint, k1 bigint, k2 bigint, start bigint, windows int")


def _groups(sorted_rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    if len(sorted_rows):
        cuts = np.flatnonzero(np.diff(sorted_rows)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(sorted_rows)), strict=True):
            yield int(sorted_rows[lo]), int(lo), int(hi)


def distinct_contexts(places: DataFrame) -> DataFrame:
    """Identical contexts as one row: anchor, context, n, first (its first occurrence)."""
    return places.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("first"))


def _to_compare(distinct: DataFrame) -> DataFrame:
    """Those whose anchor has others, with the number of its contexts."""
    anchors = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1"))
    chosen = materialize(distinct.join(anchors, "anchor"))
    release(anchors)
    return chosen


def _cut(units: bytes, unit: str, wanted: list[tuple[int, int]], window: int) -> list[bytes]:
    """Units of contexts given as (start, windows)."""
    if unit == "byte":
        return [units[s : s + m + window - 1] for s, m in wanted]
    words = units.split()
    return [b" ".join(words[s : s + m + window - 1]) for s, m in wanted]


def _with_units(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents that hold the first occurrence of chosen contexts, with those as ``wanted`` (twice where a row is repeated)."""
    wanted = chosen.groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")).agg(
        F.collect_list(F.struct("anchor", "context", "n", "first.start", "first.windows")).alias("wanted")
    )
    return docs.select("k1", "k2", "units").join(wanted, ["k1", "k2"])


_SPANS = "k1 bigint, k2 bigint, lo bigint, hi bigint"


def _judged_in_shards(docs: DataFrame, chosen: DataFrame, unit: str, window: int, judge: Judge, shards: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            k1s, k2s, texts, all_wanted = (batch.column(c) for c in ("k1", "k2", "units", "wanted"))
            for i in range(batch.num_rows):
                k1, k2, wanted = k1s[i].as_py(), k2s[i].as_py(), all_wanted[i].as_py()
                parts = _cut(texts[i].as_py(), unit, [(w["start"], w["windows"]) for w in wanted], window)
                rows += [(w["anchor"] % shards, w["anchor"], w["context"], w["n"], k1, k2, w["start"], w["windows"], p)
                         for w, p in zip(wanted, parts, strict=True)]
                if len(rows) > 4000:
                    yield _pieces(rows)
                    rows = []
        if rows:
            yield _pieces(rows)

    def decide(table: pa.Table) -> pa.Table:
        pairs = np.rec.fromarrays([table.column("anchor").to_numpy(), table.column("context").to_numpy()])
        table = table.take(pa.array(np.unique(pairs, return_index=True)[1]))
        k1, k2, start, windows, n = (table.column(c).to_numpy() for c in ("k1", "k2", "start", "windows", "n"))
        order = np.empty(len(k1), dtype=np.int64)
        order[np.lexsort((start, k2, k1))] = np.arange(len(k1))
        piece, lo, hi = [], [], []
        for i, flagged in enumerate(judge(table.column("units").to_pylist(), windows, n, order)):
            if len(flagged):
                a, b = merged(flagged, flagged + window)
                piece.append(np.full(len(a), i))
                lo.append(a + start[i])
                hi.append(b + start[i])
        piece, lo, hi = (np.concatenate([*x, np.empty(0, dtype=np.int64)]) for x in (piece, lo, hi))
        return pa.table({"k1": k1[piece], "k2": k2[piece], "lo": lo, "hi": hi})

    pieces = _with_units(docs, chosen).mapInArrow(
        cut, "shard bigint, anchor bigint, context bigint, n bigint, k1 bigint, k2 bigint, start bigint, windows int, units binary"
    )
    return pieces.groupBy("shard").applyInArrow(decide, _SPANS)


_PIECES = pa.schema([
    ("shard", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
    ("start", pa.int64()), ("windows", pa.int32()), ("units", pa.binary()),
])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _judged_by_window(docs: DataFrame, chosen: DataFrame, unit: str, window: int, later_only: bool) -> DataFrame:
    """The same decision for contexts of crowded anchors: a window goes by the count, or the first place, of its hash."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("k1", "k2", "units", "wanted")}
                parts = _cut(row["units"], unit, [(w["start"], w["windows"]) for w in row["wanted"]], window)
                for w, part in zip(row["wanted"], parts, strict=True):
                    prefix = prefix_hash(words_of(part, np.zeros(1, dtype=np.int64)).hash) if unit == "word" else byte_prefix(part)
                    at = np.arange(w["windows"])
                    same = lambda v, m=w["windows"]: pa.array(np.full(m, v, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [same(w["anchor"]), same(w["context"]), same(w["n"]), same(row["k1"]), same(row["k2"]),
                         pa.array(at + w["start"]), pa.array(at.astype(np.int32)),
                         _signed(span_hash(prefix, at, at + window)), _signed(span_hash(prefix, at + 1, at + window))],
                        ["anchor", "context", "n", "k1", "k2", "at", "i", "h1", "h2"],
                    )

    rows = _with_units(docs, chosen).mapInArrow(
        hashes, "anchor bigint, context bigint, n bigint, k1 bigint, k2 bigint, at bigint, i int, h1 bigint, h2 bigint"
    )
    rows = materialize(rows.dropDuplicates(["anchor", "context", "i"]))
    facts = rows.groupBy("h1", "h2").agg(F.sum("n").alias("all"), F.min(F.struct("k1", "k2", "at")).alias("earliest")).where("all > 1")
    hit = rows.join(facts, ["h1", "h2"])
    if later_only:
        hit = hit.where(F.struct("k1", "k2", "at") > F.col("earliest"))
    return hit.select("k1", "k2", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))


def repeated_spans(docs: DataFrame, unit: str, window: int, gram: int, judge: Judge, later_only: bool,
                   shard_bytes: int = SHARD_BYTES, contexts_per_anchor: int = CONTEXTS_PER_ANCHOR) -> DataFrame:
    """k1, k2 and spans [lo, hi) of units that repeated windows of the document cover.

    docs: as ``keyed`` returns. later_only: an occurrence without an earlier one stays.
    """
    anchors = repeated_anchors(docs, unit, window, gram)
    places = materialize(occurrences(docs, anchors, unit, window, gram))
    release(anchors)
    distinct = materialize(distinct_contexts(places))
    chosen = _to_compare(distinct)
    crowded = F.col("contexts") > contexts_per_anchor
    size = chosen.agg(F.sum(F.col("first.windows") + window), F.max("contexts")).first()
    units = (size[0] or 0) * (6 if unit == "word" else 1)
    shards = max(1, math.ceil(units / shard_bytes))
    spans = _judged_in_shards(docs, chosen.where(~crowded), unit, window, judge, shards)
    if (size[1] or 0) > contexts_per_anchor:
        spans = spans.unionByName(_judged_by_window(docs, chosen.where(crowded), unit, window, later_only))
    copies = places.join(distinct.where("n > 1").select("anchor", "context", F.struct("first.k1", "first.k2", "first.start").alias("earliest")), ["anchor", "context"])
    if later_only:
        copies = copies.where(F.struct("k1", "k2", "start") > F.col("earliest"))
    spans = spans.unionByName(copies.select("k1", "k2", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + window - 1).alias("hi")))
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    release(places, distinct, chosen)
    return spans


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of at least one span, as maximal runs in order."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    apart = lo[1:] > hi[:-1]
    return lo[np.append(True, apart)], hi[np.append(apart, True)]


def runs_of(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int]]]:
    """Maximal runs of each row's ``spans`` (none for null)."""
    spans = batch.column("spans")
    offsets, values = spans.offsets.to_numpy(), spans.values
    lo, hi = values.field("lo").to_numpy(), values.field("hi").to_numpy()
    for a, b, null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans.is_null().to_pylist(), strict=True):
        yield [] if null or a == b else [(x, y) for x, y in zip(*(z.tolist() for z in merged(lo[a:b], hi[a:b])), strict=True)]


def without(units, runs: list[tuple[int, int]]) -> list:
    """Parts of a sequence between the runs."""
    ends = [0, *(hi for _, hi in runs)]
    return [units[a:b] for a, b in zip(ends, [*(lo for lo, _ in runs), len(units)], strict=True)]
