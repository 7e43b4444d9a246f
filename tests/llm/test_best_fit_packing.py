import random
import zlib
from array import array

import cases
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusprep.llm import best_fit_packing as b

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def _ids(data):
    out = array("I")
    out.frombytes(data)
    return out.tolist()


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_ids_are_those_of_the_tokenizer(tokenizer, vocabulary):
    texts = [r[1] or "" for r in cases.awkward_rows()[:16]] + ["<|endoftext|> it's we'LL  \n\n x", "a" * 5000, " " * 5000 + "x", "é\x1c\x85  漢字\U0001f600 ½²"]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}" for c in [*range(1, 0x2100), *range(0x3000, 0x3100)]]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert _ids(b.token_ids(text, vocabulary)) == [*e.ids, 2], text[:40]
    assert _ids(b.token_ids(None, vocabulary)) == [2]


def test_long_texts_are_encoded_in_stretches_as_they_are_whole(tokenizer):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["word", " two", "  ", "\n", "\n\n x", "'s", "\x1c", "é", " ", "9", "!"]) for _ in range(20_000))
    parts = list(b.stretches(text, 300))
    assert "".join(parts) == text and len(parts) > 50
    joined = [i for e in tokenizer.encode_batch(parts, add_special_tokens=False) for i in e.ids]
    assert joined == tokenizer.encode(text, add_special_tokens=False).ids
    assert list(b.stretches("x" * 5000, 300)) == ["x" * 5000]


def _best_fit(lengths, size):
    """Sequences that best fit by falling length takes, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


def test_plan_over_counts_is_best_fit_piece_by_piece():
    rnd = random.Random(3)
    for size in (10, 64, 200):
        for _ in range(60):
            counts = {n: rnd.choice([1, 2, 7, 40]) for n in rnd.sample(range(1, size + 1), rnd.randrange(1, min(size, 30)))}
            plan, n = b.plan_slots(counts, size)
            lengths = [x for x, k in counts.items() for _ in range(k)]
            assert n == _best_fit(lengths, size)
            filled, ranks = {}, {}
            for length, first, k, sequence, each, offset in plan:
                for i in range(k):
                    filled.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
                    ranks.setdefault(length, []).append(first + i)
            assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(k)) for x, k in counts.items()}
            assert sorted(filled) == list(range(n))
            for pieces in filled.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                assert at <= size


def test_plan_does_not_grow_with_the_corpus():
    rnd = random.Random(4)
    sizes = {f: len(b.plan_slots({n: rnd.randrange(1, f) for n in range(1, 1025)})[0]) for f in (1000, 10**9)}
    assert sizes[10**9] < 20_000


def _check(rows, got, tokenizer):
    """The contract, from the rows: pieces by document, sequences without gaps."""
    want, tokens = [], 0
    for doc, *_, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        tokens += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(doc, i, lo, hi - lo, zlib.crc32(array("I", ids[lo:hi]).tobytes())) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert cases.in_order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == cases.in_order(want)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return len(filled), -(-tokens // 1024)


def test_awkward_rows(spark, tokenizer):
    rows = [(r[0], r[1]) for r in cases.awkward_rows()] + [(None, None)] * 50
    docs = cases.frame(spark, [(d, t, "en", "a") for d, t in rows])
    got = b.pack(b.document_pieces(docs, PATH)).collect()
    used, least = _check(rows, got, tokenizer)
    assert used <= least + 1
    assert b.pack(b.document_pieces(cases.frame(spark, []).limit(0), PATH)).collect() == []


def test_whole_table_and_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = b.pack(b.document_pieces(docs, PATH, keep_ids=True))
    got = packed.collect()
    used, least = _check([(r.doc_id, r.text) for r in docs.collect()], got, tokenizer)
    assert used <= least * 1.01 + 1
    sequences = {r.sequence_id: r for r in b.packed_sequences(packed).collect()}
    assert len(sequences) == used and sum(r.n_pieces for r in sequences.values()) == len(got)
    for r in got:
        whole = bytes(sequences[r.sequence_id].ids)
        assert whole[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
        assert len(whole) == 4 * sequences[r.sequence_id].n_tokens
