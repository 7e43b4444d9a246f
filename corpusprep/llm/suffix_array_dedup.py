"""Substring deduplication with longest-previous-factor arrays over bytes.

Each shard holds the distinct contexts of its anchors (``repeats``) as bytes. Its
suffixes that start a window are put in suffix order, comparing as many bytes as
a window has; suffixes equal that far follow their place in the corpus. The
longest previous factor of a suffix is its longest match with a suffix that
starts earlier. That one is found at the previous or the next smaller position
in suffix order, and the match is the least common prefix of neighbours on the
way there. Factors are measured up to the bytes of a window: a window whose
factor has them all is a later copy and goes, the first stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusprep.llm.repeats import CONTEXTS_PER_ANCHOR, SHARD_BYTES, keyed, repeated_spans, runs_of, without

MIN_BYTES = 100
#: Bytes of an anchor gram: rarely found twice by chance, yet well below a window.
GRAM_BYTES = 32


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), dtype=np.uint64)
    new[0] = 0
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(new)
    return out


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def _eight_bytes(data: np.ndarray) -> np.ndarray:
    """The next eight bytes of each position as a number, the first byte highest (zeros after the end)."""
    key = data.astype(np.uint64)
    for by in (1, 2, 4):
        key = (key << np.uint64(8 * by)) | _shifted(key, by)
    return key


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """A number for each position that orders them by their next ``length`` bytes (equal: equal bytes).

    Prefix doubling, several ranks at a time. Neighbouring prefixes may overlap: where the first agree, so does the overlap.
    """
    key, done = _eight_bytes(data), min(8, length)
    if done == length:
        return key >> np.uint64(8 * (8 - length))
    # as many ranks as fit 64 bits are compared at once
    bits = max(1, len(data).bit_length())
    while done < length:
        rank = _dense(key)
        key, at = rank, 0
        for _ in range(64 // bits - 1):
            step = min(done, length - done - at)
            at += step
            key = (key << np.uint64(bits)) | _shifted(rank, at)
            if at + done == length:
                break
        done += at
    return key


def _common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to ``length``, in which the suffixes at ``a`` and those at ``b`` agree; each has as many."""
    eight = _eight_bytes(data)
    common, alive = np.full(len(a), length, dtype=np.int32), np.arange(len(a))
    for at in range(0, length, 8):
        apart = eight[a[alive] + at] ^ eight[b[alive] + at]
        if length - at < 8:
            apart >>= np.uint64(8 * (8 - length + at))
            apart <<= np.uint64(8 * (8 - length + at))
        differ = apart != 0
        some = apart[differ]
        common[alive[differ]] = at + sum(((some >> np.uint64(64 - 8 * k)) == 0).astype(np.int32) for k in range(1, 8))
        alive = alive[~differ]
    return common


def _matches_before(place: np.ndarray, common: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``known`` matches, or those with the nearest suffix before, in suffix order, that has a smaller place, where they are longer.

    common: bytes in which each agrees with its neighbour before. The way to the smaller place is gone in steps that
    double until one would pass it and halve from there, over the least place and least prefix of a step: no order of
    places takes more than twice the logarithm of their number. A way ends where its least prefix is no longer than known.
    """
    longest = known.copy()
    near = np.flatnonzero(place[:-1] < place[1:]) + 1
    longest[near] = np.maximum(known[near], common[near])
    todo = np.flatnonzero((common[1:] > known[1:]) & (place[:-1] > place[1:])) + 1
    at, own, least, floor = todo.copy(), place[todo], common[todo], known[todo]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    reach = np.zeros(len(todo), dtype=np.int8)

    def advance(some: np.ndarray, level: int) -> np.ndarray:
        """Those of ``some`` that take the step and go on."""
        to = at[some] - (1 << level)
        inside = to >= 0
        some, to = some[inside], to[inside]
        free = steps[level][0][to] > own[some]
        some, to = some[free], to[free]
        prefix = np.minimum(least[some], steps[level][1][to])
        least[some], at[some] = prefix, to
        ends = prefix <= floor[some]
        reach[some[ends]] = 0
        return some[~ends]

    active, level = np.arange(len(todo)), 0
    while len(active) and 1 << level <= len(place):
        by = 1 << level - 1 if level else 0
        steps.append((np.minimum(steps[-1][0][:-by], steps[-1][0][by:]), np.minimum(steps[-1][1][:-by], steps[-1][1][by:])) if by else (place, common))
        reach[active] = level
        active = advance(active, level)
        level += 1
    reach[active] = level
    for level in range(len(steps) - 1, -1, -1):
        advance(np.flatnonzero(reach > level), level)
    longest[todo] = np.where(at > 0, np.maximum(least, floor), floor)
    return longest


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the suffixes of ``data`` at ``starts`` (ascending, at least ``length`` bytes each): their longest match, up to
    ``length`` bytes, with a suffix earlier in ``starts``."""
    if not len(starts):
        return np.empty(0, dtype=np.int32)
    rank = _dense(suffix_ranks(data, length)[starts])
    suffixes = np.sort(rank << np.uint64(32) | np.arange(len(starts), dtype=np.uint64))
    place = (suffixes & np.uint64(0xFFFFFFFF)).astype(np.int32)
    again = np.zeros(len(place), dtype=bool)
    again[1:] = (suffixes[1:] >> np.uint64(32)) == (suffixes[:-1] >> np.uint64(32))
    factor = np.full(len(place), length, dtype=np.int32)  # that of suffixes equal to the one before, which is their smaller one
    # the first of equal ones has the smallest place of them and stands for all
    place = place[~again]
    common = np.zeros(len(place), dtype=np.int32)
    common[1:] = _common_prefixes(data, starts[place[:-1]], starts[place[1:]], length)
    after = np.append(common[1:], np.int32(0))
    # a neighbour with a smaller place bounds the match from below
    known = np.zeros(len(place), dtype=np.int32)
    known[:-1] = np.where(place[1:] < place[:-1], after[:-1], 0)
    known = _matches_before(place, common, known)
    factor[place] = _matches_before(place[::-1], after[::-1], known[::-1])[::-1]
    return factor


def longest_previous_factor_judge(length: int):
    def judge(units: list[bytes], windows: np.ndarray, n: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        del n
        # in the order of the corpus, so that a window's number is its place (pieces don't share windows)
        turn = np.argsort(order)
        units, many = [units[i] for i in turn], windows[turn].astype(np.int64)
        starts = np.concatenate([[0], np.cumsum([len(u) for u in units])[:-1]]).astype(np.int64)
        first = np.cumsum(many) - many
        inside = np.arange(int(many.sum())) - np.repeat(first, many)
        factors = longest_previous_factors(np.frombuffer(b"".join(units), dtype=np.uint8), np.repeat(starts, many) + inside, length)
        out: list[np.ndarray] = [inside[:0]] * len(units)
        for at, lo, m in zip(turn.tolist(), first.tolist(), many.tolist(), strict=True):
            out[at] = np.flatnonzero(factors[lo : lo + m] >= length)
        return out

    return judge


def remove_later_copies(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM_BYTES, id_col: str = "doc_id",
                        text_col: str = "text", shard_bytes: int = SHARD_BYTES,
                        contexts_per_anchor: int = CONTEXTS_PER_ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes), kept_sha256, spans (byte spans removed).

    A byte goes if a string of ``min_bytes`` bytes around it also starts earlier:
    in a document with a smaller id, or earlier in the same one. A null text is
    empty. Rows with equal id and text count as one document, so neither is the
    other's copy; rows that share an id only are ordered by a hash of their text,
    and a null id by one in place of the id. No row is lost.
    """
    keys = keyed(docs, id_col, text_col)
    spans = repeated_spans(keys, "byte", min_bytes, gram, longest_previous_factor_judge(min_bytes), True, shard_bytes, contexts_per_anchor)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, runs in zip(batch.column("units").to_pylist(), runs_of(batch), strict=True):
                data = text or b""
                kept = b"".join(without(data, runs)) if runs else data
                out.append((len(data), len(data) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest(),
                            [{"lo": a, "hi": b} for a, b in runs]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(cols[i], pa.int64()) for i in range(3)), pa.array(cols[3], pa.binary()),
                 pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"],
            )

    return keys.join(spans, ["k1", "k2"], "left").select("doc_id", "units", "spans").mapInArrow(
        rest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string, "
        "spans array<struct<lo:bigint,hi:bigint>>",
    )
