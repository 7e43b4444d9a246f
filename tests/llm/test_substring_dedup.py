import random

import cases
import numpy as np
import pytest

from corpusprep.llm import text_units
from corpusprep.llm.substring_dedup import SuffixAutomaton, remove_repeated_passages
from corpusprep.llm.suffix_array_dedup import longest_previous_factor_judge, longest_previous_factors, remove_later_copies, suffix_ranks

SF = "/root/testdata/sf0.001"


def _words(df):
    return cases.in_order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def _bytes(df):
    return cases.in_order((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeated_passages_match_brute_force(spark, crowd):
    rows = cases.awkward_rows()
    got = remove_repeated_passages(cases.frame(spark, rows), 35, contexts_per_anchor=crowd, shard_bytes=5000)
    assert _words(got) == cases.removed_everywhere([r[:2] for r in rows], 35)


@pytest.mark.parametrize("crowd", [2000, 1])
def test_later_copies_match_brute_force(spark, crowd):
    # rows with a null id, and those that share one, have their order defined by hash: left out here
    rows = [r for r in cases.awkward_rows() if r[0] is not None and r[0] not in (2, 9)] + [(60, cases.prose(4, 90), "de", "a")]
    got = remove_later_copies(cases.frame(spark, rows), 100, contexts_per_anchor=crowd, shard_bytes=20_000)
    assert _bytes(got) == cases.removed_later([r[:2] for r in rows], 100)


def test_repeated_rows_and_null_ids_keep_their_rows(spark):
    rows = cases.awkward_rows()
    out = remove_later_copies(cases.frame(spark, rows)).collect()
    assert len(out) == len(rows)
    twice = [r for r in out if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].kept == b""  # both are copies of document 1


def test_documents_of_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert _words(remove_repeated_passages(docs)) == cases.removed_everywhere(rows, 35)
    assert _bytes(remove_later_copies(docs)) == cases.removed_later(rows, 100)


def test_empty_tables(spark):
    empty = cases.frame(spark, []).limit(0)
    assert remove_repeated_passages(empty).collect() == [] and remove_later_copies(empty).collect() == []


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_long_texts_are_cut_without_losing_a_window(unit):
    text = cases.prose(6, 3000).encode()
    size = len(text.split()) if unit == "word" else len(text)
    starts = []
    for pack in text_units.packs([b"a b", text, b""], unit, 20, 700):
        found = text_units.contexts(pack, unit, 20, 5)
        if found is not None:
            starts += [s + i for r, s, m in zip(found.row, found.start, found.windows, strict=True) if r == 1 for i in range(m)]
    assert sorted(starts) == list(range(size - 19))


def test_equal_windows_have_equal_anchors():
    passage = cases.prose(7, 60)
    texts = [f"{cases.prose(i, 40 + i)} {passage} {cases.prose(50 + i, 30)}".encode() for i in range(4)]
    anchors = []
    for text in texts:
        (pack,) = text_units.packs([text], "word", 35, 1 << 20)
        found = text_units.contexts(pack, "word", 35, 8)
        words = text.split()
        by_window = {}
        for s, m, a in zip(found.start, found.windows, found.anchor, strict=True):
            by_window.update({tuple(words[s + i : s + i + 35]): a for i in range(m)})
        anchors.append(by_window)
    shared = set.intersection(*map(set, anchors))
    assert len(shared) >= 26 and all(len({a[w] for a in anchors}) == 1 for w in shared)


def test_automaton_counts_and_matching_statistics():
    rnd = random.Random(3)
    texts = [([rnd.randrange(3) for _ in range(rnd.randrange(1, 30))], rnd.choice([1, 1, 2])) for _ in range(12)]
    automaton = SuffixAutomaton()
    for words, times in texts:
        automaton.add(words, times)
    automaton.finish()
    seen = {}
    for words, times in texts:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                seen[tuple(words[i:j])] = seen.get(tuple(words[i:j]), 0) + times
    for words, _ in texts:
        want = [max((j - i for i in range(j) if seen[tuple(words[i:j])] > 1), default=0) for j in range(1, len(words) + 1)]
        assert automaton.matching_statistics(words) == want


@pytest.mark.parametrize("length", [1, 5, 8, 13, 100])
def test_suffix_ranks_sort_by_bytes(length):
    rnd = random.Random(length)
    data = bytes(rnd.choice(b"ab\xff\x00") for _ in range(400))
    rank = suffix_ranks(np.frombuffer(data, dtype=np.uint8), length)
    some = range(400 - length)
    want = sorted(some, key=lambda i: (data[i : i + length], i))
    assert sorted(some, key=lambda i: (rank[i], i)) == want
    assert all((rank[i] == rank[j]) == (data[i : i + length] == data[j : j + length]) for i, j in zip(want, want[1:], strict=False))


def test_longest_previous_factors_follow_the_order_of_the_corpus():
    judge = longest_previous_factor_judge(4)
    flagged = judge([b"abcdef", b"xabcde"], np.array([3, 3]), np.array([1, 1]), np.array([1, 0]))
    assert [f.tolist() for f in flagged] == [[0, 1], []]


def _plain_factors(data, starts, length):
    def match(a, b):
        return next((k for k in range(length) if data[a + k] != data[b + k]), length)

    return [max([match(s, t) for t in starts[:i]], default=0) for i, s in enumerate(starts)]


@pytest.mark.parametrize("length", [1, 7, 8, 9, 20, 100])
def test_longest_previous_factors(length):
    rng = np.random.default_rng(length)
    for letters in (1, 2, 4):
        for n in (0, 1, 2, 65, 150):
            data = rng.integers(0, letters, n + length).astype(np.uint8)
            data[n // 2 : n // 2 + n // 3] = data[: n // 3]
            for starts in (np.arange(n), np.flatnonzero(rng.integers(0, 2, n))):
                assert longest_previous_factors(data, starts, length).tolist() == _plain_factors(data, starts.tolist(), length)


def test_longest_previous_factors_of_any_order_of_places():
    # numbers in order, backwards and repeated: the smaller position is far away
    for numbers in (range(3000), range(2999, -1, -1), [*range(1500), *range(1500)]):
        data = np.frombuffer(b" ".join(b"%06d" % i for i in numbers), dtype=np.uint8)
        starts = np.arange(0, len(data) - 12)
        got = longest_previous_factors(data, starts, 12).tolist()
        some = range(0, len(starts), 997)
        at = {}
        for i in range(len(starts)):  # longest prefix seen before
            piece = bytes(data[i : i + 12])
            if i in some:
                assert got[i] == next((k for k in range(12, 0, -1) if piece[:k] in at), 0)
            at.update((piece[:k], i) for k in range(1, 13))
