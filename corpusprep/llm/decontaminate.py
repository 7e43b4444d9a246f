"""Benchmark decontamination with a distributed positional inverted index.

The index covers every token of the training corpus. It is cut into segments of
about a megabyte of text; a segment is one row with its sorted terms and, of
each, the token positions, so a segment is searched where it lies and no
posting is shuffled. It is written to the shared folder and may be searched
again with other test sets.

A search takes the distinct windows of the test items. In a segment, a window's
posting lists, shifted by the term's place in the window, are intersected from
the rarest term on; most windows end at a term that the segment doesn't have.
With a ``slop`` above 0, a proximity match is a start from which each term stands
at its place or at most that many words off it.

The windows go to the segments in blocks of bounded size, one search for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.text_units import ALNUM_FOLD, Words, packs, utf8, words_of
from corpusprep.session import materialize

WINDOW = 10
#: Words that each word of a proximity match may be off its place: one word put in, left out or moved.
SLOP = 1
#: Windows of test items that one search broadcasts: 16 MB of term hashes at most with windows of ten words.
WINDOWS_PER_SEARCH = 200_000
SEGMENT_BYTES = 1 << 20
_POSITION_BITS = 24
_POSITIONS = (1 << _POSITION_BITS) - 1


def folded(text: str | None) -> bytes:
    """A-Z in lower case, and a blank for every ASCII character that is no letter or digit."""
    return utf8(text).translate(ALNUM_FOLD)


_SEGMENT = (
    "doc_id array<bigint>, k1 array<bigint>, k2 array<bigint>, first array<bigint>, words array<int>, total array<bigint>, "
    "terms array<bigint>, offsets array<int>, positions array<int>"
)


def _segment(words: Words, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each piece, sorted terms, offsets of their posting lists, positions."""
    terms, term = np.unique(words.hash.view(np.int64), return_inverse=True)
    postings = np.sort(term.astype(np.int64) << _POSITION_BITS | np.arange(len(term)))
    offsets = np.searchsorted(postings, np.arange(len(terms) + 1) << _POSITION_BITS)
    return np.bincount(words.doc, minlength=pieces), terms, offsets, postings & _POSITIONS


def build_index(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of the corpus: their pieces of documents (id, key, first word, words, words of the document) and posting lists.

    A document longer than a segment is cut into pieces that share window - 1 words.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch.column("doc_id").to_pylist()
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            long: dict[int, int] = {}  # words of documents that are cut into pieces

            def texts(units: pa.Array = batch.column("units"), long: dict[int, int] = long) -> Iterator[bytes]:
                for r, unit in enumerate(units):  # one at a time, so that no second copy of the batch is held
                    text = (unit.as_py() or b"").translate(ALNUM_FOLD)
                    if len(text) > 2 * segment_bytes:
                        long[r] = len(text.split())
                    yield text

            for pack in packs(texts(), "word", window, segment_bytes):
                words = words_of(pack.buffer, pack.starts)
                assert len(words.doc) < 1 << _POSITION_BITS
                n, terms, offsets, positions = _segment(words, len(pack.rows))
                total = [long.get(int(r), int(m)) for r, m in zip(pack.rows, n, strict=True)]
                row = [[doc_id[r] for r in pack.rows], k1[pack.rows], k2[pack.rows], pack.first, n.astype(np.int32), total, terms,
                       offsets.astype(np.int32), positions.astype(np.int32)]
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.list_(k)) for x, k in zip(row, kinds, strict=True)],
                    ["doc_id", "k1", "k2", "first", "words", "total", "terms", "offsets", "positions"],
                )

    doc_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    rows = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("k1"), F.xxhash64(doc_id, text).alias("k2"), text.cast("binary").alias("units")
    )
    return rows.mapInArrow(index, _SEGMENT)


def test_windows(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, wid (hash of the window), terms: the windows of every item; one with fewer words, but not none, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms = words_of(folded(text), np.zeros(1, dtype=np.int64)).hash.view(np.int64)
                if len(terms):
                    rows = np.lib.stride_tricks.sliding_window_view(terms, min(window, len(terms)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(rows)), pa.array(list(rows), pa.list_(pa.int64()))], ["item", "terms"]
                    )

    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, terms array<bigint>").select("item", F.xxhash64("terms").alias("wid"), "terms").distinct()


test_windows.__test__ = False  # no test of pytest's


class _Queries:
    """Windows of equal length, as places in a table of their terms."""

    def __init__(self, wid: list[int], terms: list[list[int]]) -> None:
        self.groups = []
        self.vocabulary = np.unique(np.concatenate([np.array(t, dtype=np.int64) for t in terms])) if terms else np.empty(0, dtype=np.int64)
        for size in sorted({len(t) for t in terms}):
            some = [i for i, t in enumerate(terms) if len(t) == size]
            self.groups.append((size, np.array([wid[i] for i in some]), np.searchsorted(self.vocabulary, np.array([terms[i] for i in some]))))


def _intersected(wids: np.ndarray, places: np.ndarray, df: np.ndarray, at: np.ndarray, postings: np.ndarray, offsets: np.ndarray,
                 ends: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """wid, first token, last one and exactness of every match of windows of one length, all windows at a time.

    postings: (term, position) in one number, ascending, so all lists lie in it one after the other. Each window starts
    from the list of its rarest term, shifted by the term's place in the window (and by up to ``slop`` words either way).
    The other lists, rarest first, are intersected with what is left: the list holds the start, shifted by its term's place,
    or a position at most ``slop`` off, if the first posting that isn't below is near enough. A match lies within the
    piece (up to the next of ``ends``) that holds its rarest term.
    """
    size, freq = places.shape[1], df[places]
    alive = np.flatnonzero(freq.min(axis=1) > 0)
    order = np.argsort(freq[alive], axis=1, kind="stable")
    wanted = at[places[alive]].astype(np.int64)
    rarest = wanted[np.arange(len(alive)), order[:, 0]]
    n = (offsets[rarest + 1] - offsets[rarest]).astype(np.int64)
    window = np.repeat(np.arange(len(alive)), n)
    inside = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    place = postings[offsets[rarest][window] + inside] & _POSITIONS
    start = place - order[window, 0]
    piece = np.searchsorted(ends, place, side="right")
    begin, end = np.append(0, ends)[piece], ends[piece]
    if slop:  # a start for each stand of the rarest term
        near = np.arange(-slop, slop + 1)
        window, begin, end = (np.repeat(x, len(near)) for x in (window, begin, end))
        start = (start[:, None] + near).ravel()
    first, last, exact = np.full(len(start), len(postings)), np.full(len(start), -1), np.ones(len(start), dtype=bool)
    for k in range(0 if slop else 1, size):
        place = order[window, k]
        goal, term = start + place, wanted[window, place] << _POSITION_BITS
        low, high = np.maximum(goal - slop, begin), np.minimum(goal + slop, end - 1)
        hit = postings[np.minimum(np.searchsorted(postings, term | np.minimum(low, _POSITIONS)), len(postings) - 1)]
        keep = (low <= high) & (hit >= term | low) & (hit <= term | np.maximum(high, 0))
        if slop:
            hit = hit & _POSITIONS
            first, last = np.minimum(first, hit), np.maximum(last, hit)
            own = term | np.clip(goal, begin, end - 1)
            exact &= (goal >= begin) & (goal < end) & (postings[np.minimum(np.searchsorted(postings, own), len(postings) - 1)] == own)
        window, start, begin, end, first, last, exact = (x[keep] for x in (window, start, begin, end, first, last, exact))
    if not slop:
        return wids[alive[window]], start, start + size - 1, exact
    # an exact match covers its own words, another one those that were found first
    return wids[alive[window]], np.where(exact, start, first), np.where(exact, start + size - 1, last), exact


def _matches(queries: _Queries, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray, ends: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """wid, the first token, the last one and whether it is exact, of every match."""
    if not len(terms):
        return
    at = np.searchsorted(terms, queries.vocabulary)
    at = np.minimum(at, len(terms) - 1)
    df = np.where(terms[at] == queries.vocabulary, offsets[at + 1] - offsets[at], 0)
    postings = np.repeat(np.arange(len(terms)), np.diff(offsets)) << _POSITION_BITS | positions
    for size, wids, places in queries.groups:
        yield _intersected(wids, places, df, at, postings, offsets, ends, slop)


def search(index: DataFrame, windows: DataFrame, slop: int = 0, windows_per_search: int = WINDOWS_PER_SEARCH) -> DataFrame:
    """k1, k2, wid, lo, hi (words, end exclusive), exact: every place in the corpus where a window matches."""
    distinct = materialize(windows.select("wid", "terms").dropDuplicates(["wid"]))
    blocks = max(1, -(-distinct.count() // windows_per_search))
    found = None
    for block in range(blocks):
        # a hash deals the windows out, so a block has about as many as allowed
        rows = distinct.where(F.pmod(F.col("wid"), F.lit(blocks)) == block).orderBy("wid").collect()
        queries = _Queries([r["wid"] for r in rows], [r["terms"] for r in rows])

        def look(batches: Iterator[pa.RecordBatch], queries: _Queries = queries) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    k1, k2, first, words, terms, offsets, positions = (
                        batch.column(c)[i].values.to_numpy() for c in ("k1", "k2", "first", "words", "terms", "offsets", "positions")
                    )
                    ends = np.cumsum(words)
                    out: list[list[np.ndarray]] = []
                    for wid, lo, hi, exact in _matches(queries, terms, offsets, positions, ends, slop):
                        piece = np.searchsorted(ends, lo, side="right")
                        shift = first[piece] - (ends - words)[piece]
                        out.append([k1[piece], k2[piece], wid, lo + shift, hi + shift + 1, exact])
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["k1", "k2", "wid", "lo", "hi", "exact"])

        hits = index.select("k1", "k2", "first", "words", "terms", "offsets", "positions").mapInArrow(
            look, "k1 bigint, k2 bigint, wid bigint, lo bigint, hi bigint, exact boolean"
        )
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def _covered(spans: Column) -> Column:
    """Words covered by an array of (lo, hi) spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(a["end"], s["lo"]))).alias("n"), F.greatest(a["end"], s["hi"]).alias("end")
        ),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", segment_bytes: int = SEGMENT_BYTES,
                  windows_per_search: int = WINDOWS_PER_SEARCH) -> DataFrame:
    """doc_id, key (hash of id and text), n_words, n_hit, items (sorted ids), spans (word spans hit), near_items.

    A document word is hit if it is in an occurrence of a test item's window, and the item is among ``items``. ``near_items`` are
    those with a window that occurs with every word at its place or at most ``slop`` words off it: all of ``items``, and
    items with a word put in, left out or moved. (Equal words of a window may stand for each other.)
    Null texts have no words; a null item id counts as an empty one. Every row
    of ``docs`` has a row; rows equal in id and text have equal results. An
    empty table of items hits nothing.
    """
    # small row groups, as a row is a whole segment
    index = materialize(build_index(docs, window + 2 * slop, id_col, text_col, segment_bytes), **{"parquet.block.size": str(16 << 20)})
    windows = materialize(test_windows(items, window, item_col, item_text_col))
    hits = materialize(search(index, windows, slop, windows_per_search))
    # spans and items part ways here, so a window that many items share is no product of both
    spans = hits.where("exact").select("k1", "k2", "lo", "hi").distinct()
    spans = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    by_window = hits.groupBy("k1", "k2", "wid").agg(F.max("exact").alias("exact"))
    by_item = by_window.join(windows.select("wid", "item"), "wid").groupBy("k1", "k2", "item").agg(F.max("exact").alias("exact"))
    items_hit = by_item.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.array_sort(F.collect_list("item")).alias("near_items")
    )
    pieces = index.select(F.explode(F.arrays_zip("doc_id", "k1", "k2", "first", "total")).alias("p")).select("p.*").where("first = 0")
    joined = pieces.join(spans, ["k1", "k2"], "left").join(items_hit, ["k1", "k2"], "left")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return joined.select(
        "doc_id", F.col("k2").alias("key"), F.col("total").alias("n_words"), F.coalesce(_covered(F.col("spans")), F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a test item's window; the others as they are, repeated rows too."""
    hit = contamination(docs, items, window, 0, id_col, text_col, item_col, item_text_col).where("n_hit > 0")
    hit = hit.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")).distinct()
    # the table's columns go into a struct, so none can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    doc_id = F.col(f"_row.`{id_col}`").cast("bigint")
    same = (F.xxhash64(doc_id, F.col(f"_row.`{text_col}`").cast("string")) == F.col("_key")) & doc_id.eqNullSafe(F.col("_id"))
    return rows.join(hit, same, "left_anti").select("_row.*")
