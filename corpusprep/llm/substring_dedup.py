"""Substring deduplication with suffix automata.

Reference shards are the distinct passages of the corpus that may repeat, cut by
anchor (``repeats``). Of each shard a generalised suffix automaton is built over
words, in which every state knows how often its strings occur in the corpus.
The passages stream through it: at each word, the matching statistic is the
length of the longest suffix that occurs twice or more. Where it reaches the
threshold, the words of the match are removed.

An automaton of every shard broadcast to every task would cost shards times
corpus. A shard is sent instead only where it can match, to the task that holds
the passages with its anchors; its size is bounded by ``SHARD_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusprep.llm.repeats import CONTEXTS_PER_ANCHOR, SHARD_BYTES, keyed, repeated_spans, runs_of, without

MIN_WORDS = 35
#: Words of an anchor gram; unique in most of a corpus, yet much shorter than the threshold.
GRAM_WORDS = 8


class SuffixAutomaton:
    """Suffix automaton of several word sequences with occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.count = [0]

    def add(self, words: list[int], times: int) -> None:
        """Insert a sequence that occurs ``times`` times."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                count[last] += times
                continue
            if known is None:
                cur = len(length)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(times)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            else:
                cur = self._clone(last, known, w)
                count[cur] += times
            last = cur

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.count.append(0)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def finish(self) -> None:
        """Occurrences of every state; ``repeated``: longest suffix of the state's strings that occurs twice."""
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for v in reversed(order):
            self.count[self.link[v]] += self.count[v]
        self.repeated = [0] * len(self.len)
        for v in order:
            self.repeated[v] = self.len[v] if self.count[v] > 1 else self.repeated[self.link[v]]

    def matching_statistics(self, words: list[int]) -> list[int]:
        """At each word of an inserted sequence, the length of the longest suffix found twice or more."""
        out, at = [], 0
        for i, w in enumerate(words, 1):
            at = self.next[at][w]
            out.append(min(i, self.repeated[at]))
        return out


def automaton_judge(least: int):
    def judge(units: list[bytes], windows: np.ndarray, n: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        del order
        ids: dict[bytes, int] = {}
        texts = [[ids.setdefault(w, len(ids)) for w in u.split()] for u in units]
        automaton = SuffixAutomaton()
        for words, times in zip(texts, n.tolist(), strict=True):
            automaton.add(words, times)
        automaton.finish()
        flagged = []
        for words, times in zip(texts, n.tolist(), strict=True):
            # of one that is folded from several, all copies go anyway
            matched = automaton.matching_statistics(words) if times == 1 else []
            flagged.append(np.flatnonzero(np.array(matched) >= least) - (least - 1))
        return flagged

    return judge


def remove_repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM_WORDS, id_col: str = "doc_id",
                             text_col: str = "text", shard_bytes: int = SHARD_BYTES,
                             contexts_per_anchor: int = CONTEXTS_PER_ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by a blank), kept_sha256, spans (word spans removed).

    Words are runs of characters other than ASCII white space. A word is removed
    if a sequence of ``min_words`` words around it also starts anywhere else, in
    another document or the same one. A null text has no words. Rows with equal
    id and text are copies of each other like any others, so their repeated
    passages go; a null id is kept and treated alike. No row is lost.
    """
    keys = keyed(docs, id_col, text_col)
    spans = repeated_spans(keys, "word", min_words, gram, automaton_judge(min_words), False, shard_bytes, contexts_per_anchor)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, runs in zip(batch.column("units").to_pylist(), runs_of(batch), strict=True):
                words = (text or b"").split()
                kept = [w for part in without(words, runs) for w in part] if runs else words
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest(),
                            [{"lo": a, "hi": b} for a, b in runs]))
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "spans"],
            )

    return keys.join(spans, ["k1", "k2"], "left").select("doc_id", "units", "spans").mapInArrow(
        rest, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string, spans array<struct<lo:bigint,hi:bigint>>"
    )
