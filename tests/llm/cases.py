"""Documents with every awkward case, and plain versions of the operators to compare with."""

import hashlib
import itertools
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, units string, k1 long, size long, key string, part int"


def prose(seed, n, words=60):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rnd.randrange(words)) for _ in range(n))][0]


def awkward_rows():
    """(doc_id, text, lang, source): nulls in every column, empty, blank, one word, long, equal rows, equal ids, equal texts."""
    base, long = prose(1, 200), prose(2, 30_000, 5000)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", "b"), (4, "", "de", "b"), (5, " \t\n ", None, "b"),
        (6, "word", "de", None), (None, prose(3, 80), "en", "a"), (None, None, None, None), (7, long, "en", "c"), (8, long[:-5] + " changed", "en", "c"),
        (9, prose(4, 90) + "\n" + base, "de", "a"), (9, prose(5, 90), "de", "a"), (10, "aaaa " * 300, "de", "a"), (11, "x" * 700, "de", "a"),
        (12, "é" * 300 + "\n" + "ß ö" * 50, "fr", "d"), (13, base.upper(), "en", "a"), (14, base + " " + base, "en", "e"),
    ]
    rnd = random.Random(9)
    for i in range(20, 50):  # near copies of one text
        words = base.split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "a"))
    return rows


def frame(spark, rows):
    """The documents, with columns whose names operators use themselves."""
    full = [(d, t, la, s, None if t is None else len(t), "units", 7, None, "key", 3) for d, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def in_order(rows):
    return sorted(rows, key=str)


def removed_everywhere(rows, window):
    """(doc_id, words, removed, sha256 of the rest) when every repeated window goes."""
    tokens = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in tokens for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, tokens, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        rest = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    return in_order(out)


def removed_later(rows, window):
    """(doc_id, bytes, removed, spans, sha256 of the rest) when windows that start earlier, by (doc_id, place), go."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if data[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(data[i : i + window])
        rest = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), len(data) - len(rest), len(re.findall(b"\1+", gone)), hashlib.sha256(rest).hexdigest()))
    return in_order(out)


def components(nodes, linked):
    """Smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}
