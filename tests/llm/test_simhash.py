import random

import cases
import numpy as np
import pytest
import xxhash

from corpusprep.llm import simhash_dedup as d

SF = "/root/testdata/sf0.01"


def _plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def _check(rows, out):
    prints = {}
    for doc, text in rows:
        prints.setdefault(_plain(text), []).append(doc)
    root = cases.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for f, docs in prints.items():
        known = [x for x in docs if x is not None]
        least.setdefault(root[f], []).extend(known)
    want = [(doc, f"{f:016x}", min(least[root[f]], default=None)) for f, docs in prints.items() for doc in docs]
    assert cases.in_order((r.doc_id, r.fingerprint, r.component_id) for r in out) == cases.in_order(want)


def test_awkward_rows(spark):
    rows = cases.awkward_rows()
    _check([r[:2] for r in rows], d.near_duplicate_groups(cases.frame(spark, rows)).collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _check([(r.doc_id, r.text) for r in docs.collect()], d.near_duplicate_groups(docs).collect())


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_join_what_all_pairs_join(spark, radius):
    rnd = random.Random(radius)
    centres = [rnd.getrandbits(64) for _ in range(8)]
    prints = set(centres)
    for _ in range(150):  # chains and clusters
        f = rnd.choice(sorted(prints))
        for _ in range(rnd.randrange(1, radius + 2)):
            f ^= 1 << rnd.randrange(64)
        prints.add(f)
    signed = [int(np.uint64(f).astype(np.int64)) for f in sorted(prints)]
    table = spark.createDataFrame([(f,) for f in signed], "fingerprint long").repartition(5)
    roots = {r.node: r.root for r in d.components(d.links(d.variants(table, radius), radius)).collect()}
    want = cases.components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius)
    groups = {}
    for n in signed:
        groups.setdefault(roots.get(n, n), set()).add(n)
    expected = {}
    for n, r in want.items():
        expected.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001 + i) for i in range(300)] + [(2000, 2000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in d.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1301)}


def test_half_ball_sizes():
    assert [len(f) for _, f in d.ball(3, 4)] == [49] * 4 and [len(f) for _, f in d.ball(2, 4)] == [65]
    assert [len(f) for _, f in d.ball(4, 4)] == [1 + 64 + 64 * 63 // 2]


def test_one_of_each_group_stays(spark):
    rows = cases.awkward_rows()
    docs = cases.frame(spark, rows)
    groups = d.near_duplicate_groups(docs).collect()
    out = d.keep_first(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == len({(r.component_id, r.key) for r in groups if r["first"]})
    # two documents with the id 9 are firsts of their groups
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([9, *{r.component_id for r in groups if r.component_id is not None}])
    assert {r.doc_id: r.text for r in kept}[1] == rows[0][1]


def test_empty_table(spark):
    empty = cases.frame(spark, []).limit(0)
    assert d.near_duplicate_groups(empty).collect() == [] and d.keep_first(empty).collect() == []
