"""State of the streaming conversion: what documents wait for.

A document that refers to local files comes out when they have arrived, or when its wait is over; of documents
with one package name the first to arrive keeps it. Both are questions about a key that may be answered batches
later, so both are kept in a keyed state store: nothing lists the folder, and a batch touches the keys of its own files only.

Rows in: ``key, kind, doc, n, package, media``.

* ``have`` (key: a file's path): the file is there;
* ``want`` (the same key): ``doc`` refers to it;
* ``claim`` (key: a package's name): ``doc`` would have that package.

Rows out: ``doc, n, package, media, status``; a document has ``n`` answers in all: one for its claim (``owner`` or ``loser``,
media null) and one for each file it refers to (``found`` or ``missing``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

EVENTS = "key string, kind string, doc string, n int, package string, media string"
ANSWERS = "doc string, n int, package string, media string, status string"


class Waiting(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.present = handle.getValueState("present", "at bigint")
        self.owner = handle.getValueState("owner", "doc string")
        self.queue = handle.getListState("queue", "doc string, n int, package string, media string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        have, want, claim = False, [], []
        for frame in rows:
            have = have or bool((frame["kind"] == "have").any())
            want += frame[frame["kind"] == "want"][["doc", "n", "package", "media"]].itertuples(index=False, name=None)
            claim += frame[frame["kind"] == "claim"][["doc", "n", "package"]].itertuples(index=False, name=None)
        out = []
        if claim:
            if not self.owner.exists():
                self.owner.update((max(c[0] for c in claim),))
            owner = self.owner.get()[0]
            out += [(doc, int(n), package, None, "owner" if doc == owner else "loser") for doc, n, package in claim]
        if have and not self.present.exists():
            self.present.update((now,))
        if have and self.queue.exists():
            out += [(doc, n, package, media, "found") for doc, n, package, media, _ in self.queue.get()]
            self.queue.clear()
        if want and self.present.exists():
            out += [(doc, int(n), package, media, "found") for doc, n, package, media in want]
        elif want and not self.wait_ms:
            out += [(doc, int(n), package, media, "missing") for doc, n, package, media in want]
        elif want:
            until = now + self.wait_ms
            self.queue.appendList([(doc, int(n), package, media, until) for doc, n, package, media in want])
            self.handle.registerTimer(until)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        queue = list(self.queue.get()) if self.queue.exists() else []
        over = [w for w in queue if w[4] <= now]
        if over:
            rest = [tuple(w) for w in queue if w[4] > now]
            self.queue.clear()
            if rest:
                self.queue.appendList(rest)
            yield _frame([(doc, n, package, media, "missing") for doc, n, package, media, _ in over])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc", "n", "package", "media", "status"]).astype({"n": "int32"})
