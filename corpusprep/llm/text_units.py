"""Vectorised word, n-gram and minimizer helpers used inside tasks.

A task sees its documents as Arrow batches. The helpers concatenate documents
into *packs* of some hundred kilobytes (a longer document is cut into overlapping
pieces), so that tokenising and hashing are a handful of numpy passes whatever
the mix of short and long documents, and memory stays bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Arrays of a pack stay in a core's cache.
PACK_BYTES = 1 << 17
#: Positions in a pack take the low bits of a minimizer key; a pack has fewer units than this.
POSITION_BITS = 24

#: ASCII white space: blank and \x09 to \x0D, as ``bytes.split`` splits.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Words of letters, digits and non-ASCII bytes: A-Z become a-z, everything else ASCII a blank.
ALNUM_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the input bits over the high and low ones (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Odd, so powers have inverses modulo 2**64 and a prefix sum hashes any substring.
_RADIX = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_RADIX**i and its inverse powers for i below n, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for radix in (_RADIX, pow(_RADIX, -1, 1 << 64)):
            out = np.ones(size, dtype=np.uint64)
            done, step = 1, radix
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            both.append(out)
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j] - P[i] the (shifted) hash of values[i:j]."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def gram_hashes(prefix: np.ndarray, gram: int) -> np.ndarray:
    """``span_hash`` of every run of ``gram`` units."""
    n = len(prefix) - gram
    return mix((prefix[gram:] - prefix[:n]) * powers(len(prefix))[1][:n])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, by doubling."""
    done, out = 1, keys
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return out if done == width else np.minimum(out[: len(out) - (width - done)], out[width - done :])


class Words(NamedTuple):
    """Words of a pack: byte offsets in it, the document (index in the pack) and a 64-bit hash of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def words_of(buffer: bytes, doc_starts: np.ndarray) -> Words:
    """White-space words of a pack whose documents are parted by at least one blank."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~WHITE[data]
    edge = np.flatnonzero(np.diff(solid))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return Words(start, end, start, np.empty(0, dtype=np.uint64))
    prefix = prefix_hash(_byte_values()[data])
    return Words(start, end, np.searchsorted(doc_starts, start, "right") - 1, span_hash(prefix, start, end))


def byte_prefix(buffer: bytes) -> np.ndarray:
    return prefix_hash(_byte_values()[np.frombuffer(buffer, dtype=np.uint8)])


class Pack(NamedTuple):
    """Documents or pieces of a long one, joined by a blank.

    rows: index of each in what was packed; first: its first unit's position in
    its document; starts: its first byte in the buffer.
    """

    rows: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buffer: bytes


_BLANK = re.compile(rb"[ \t-\r]")


def _word_pieces(text: bytes, window: int, limit: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a long text as (index of the first word, bytes); neighbours share window - 1 words."""
    at, first = 0, 0
    while True:
        size = limit
        while True:
            blank = _BLANK.search(text, at + size)
            if blank is None:
                yield first, text[at:]
                return
            piece = text[at : blank.start()]
            tail = piece.rsplit(None, window - 1)
            if len(tail) == window:
                break
            size *= 2  # fewer words than a window
        yield first, piece
        first += len(tail[0].split())
        at += len(tail[0])


def _byte_pieces(text: bytes, window: int, limit: int) -> Iterator[tuple[int, bytes]]:
    at = 0
    while True:
        yield at, text[at : at + limit + window - 1]
        at += limit
        if at + window - 1 >= len(text):
            return


def packs(texts: Iterable[bytes], unit: str, window: int, limit: int = PACK_BYTES) -> Iterator[Pack]:
    """Documents in packs of about ``limit`` bytes; every window of ``window`` units lies whole in just one piece."""
    rows: list[int] = []
    first: list[int] = []
    parts: list[bytes] = []
    size = 0

    def closed() -> Pack:
        lens = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
        starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]).astype(np.int64)
        return Pack(np.array(rows), np.array(first, dtype=np.int64), starts, starts + lens, b" ".join(parts))

    for i, text in enumerate(texts):
        cut = _word_pieces if unit == "word" else _byte_pieces
        for at, piece in [(0, text)] if len(text) <= 2 * limit else cut(text, window, limit):
            if parts and size + len(piece) > limit:
                yield closed()
                rows, first, parts, size = [], [], [], 0
            rows.append(i)
            first.append(at)
            parts.append(piece)
            size += len(piece) + 1
    if parts:
        yield closed()


class Contexts(NamedTuple):
    """Runs of windows with the same minimizer.

    row: index in what was packed; start: first window's first unit in its
    document; windows: their number; anchor: hash of the minimizer's units;
    context: hash of all units of the run; lo, hi: its bytes in the pack.
    """

    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def contexts(pack: Pack, unit: str, window: int, gram: int) -> Contexts | None:
    """Every window of the pack, in runs that share their minimizer (the least hash among its grams).

    Which gram a window selects depends on its units alone, so equal windows
    have equal anchors, wherever they stand. Each window is in exactly one run.
    """
    if unit == "word":
        words = words_of(pack.buffer, pack.starts)
        doc, prefix, lo, hi = words.doc, prefix_hash(words.hash), words.start, words.end
        n = len(doc)
    else:
        prefix = byte_prefix(pack.buffer)
        n = len(pack.buffer)
        doc = None
    if n < window:
        return None
    assert n < 1 << POSITION_BITS
    grams = gram_hashes(prefix, gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    picked = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    if doc is not None:
        valid = doc[: n - window + 1] == doc[window - 1 :]
        first_unit = np.searchsorted(doc, np.arange(len(pack.rows)))
    else:
        mark = np.zeros(n + 1, dtype=np.int8)
        long = pack.ends - pack.starts >= window
        mark[pack.starts[long]] += 1
        mark[(pack.ends - window + 1)[long]] -= 1
        valid = np.cumsum(mark, dtype=np.int8)[: n - window + 1].astype(bool)
        first_unit = pack.starts
    # windows of two documents are never neighbours, as those across both are not valid
    begin = np.flatnonzero(np.append(True, (picked[1:] != picked[:-1]) | (valid[1:] != valid[:-1])))
    m = np.diff(np.append(begin, len(picked)))
    keep = valid[begin]
    a, m = begin[keep], m[keep]
    if not len(a):
        return None
    where = doc[a] if doc is not None else np.searchsorted(pack.starts, a, "right") - 1
    last = a + m + window - 1
    return Contexts(
        pack.rows[where], pack.first[where] + a - first_unit[where], m, grams[(picked[a] & low).astype(np.int64)], span_hash(prefix, a, last),
        lo[a] if doc is not None else a, hi[last - 1] if doc is not None else last,
    )
