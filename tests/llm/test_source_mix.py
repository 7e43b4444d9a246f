import random
from fractions import Fraction

import cases
from pyspark.sql import functions as F

from corpusprep.llm import source_mix as m

SF = "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\x0c\r"


def _targets(sizes, weights=(5, 2, 1), most=3):
    """Shares given out round by round; a source that would go above its cap gets the cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, given, open_ = Fraction(sum(sizes.values())), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if most * sizes[s] < level * weight[s]}
        if not over:
            given |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            given[s] = Fraction(most * sizes[s])
            left -= given[s]
        open_ -= over
    return {s: float(x) for s, x in given.items()}


def _size(text):
    return len("".join(" " if c in BLANK else c for c in text or "").split(" ")) - "".join(" " if c in BLANK else c for c in text or "").split(" ").count("")


def _check(rows, out):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + _size(t)
    want = _targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert any(r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-9 * max(1, want[s]) for s in sizes)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert sum(r.size for r in out) == sum(_size(r[1]) for r in rows)


def test_awkward_rows(spark):
    rows = cases.awkward_rows()
    out = m.mixed_sizes(cases.frame(spark, rows)).collect()
    _check(rows, out)
    assert cases.in_order(map(tuple, out)) == cases.in_order(map(tuple, m.mixed_sizes(cases.frame(spark, rows).repartition(5)).collect()))


def test_targets_stop_at_three_times_the_source(spark):
    rnd = random.Random(2)
    for trial in range(4):
        sizes = {f"s{i}": rnd.choice([0, 1, 7, 50, 400, 3000]) for i in range(rnd.randrange(1, 14))} | ({None: 40} if trial % 2 else {})
        table = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
        got = {r.source: r.target for r in m.source_targets(table).collect()}
        want = _targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_sources_rank_by_code_points(spark):
    names = ["b", "B", "ä", "", "a", "aa", "z\U0001f600", "", None]
    table = spark.createDataFrame([(n, 100) for n in names], "source string, source_size long").repartition(4)
    ranks = {r.source: r["rank"] for r in m._ranked(table).collect()}
    want = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert [n for n, _ in sorted(ranks.items(), key=lambda x: x[1])] == want and sorted(ranks.values()) == list(range(9))


def test_whole_table_comes_near_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = m.mixed_sizes(docs).collect()
    _check([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], out)
    taken, target, variance = {}, {}, {}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in out:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
        part = r.target / r.source_size % 1
        variance[source[r.doc_id]] = variance.get(source[r.doc_id], 0) + r.size**2 * part * (1 - part)
    assert all(abs(taken[s] - target[s]) <= 4 * variance[s] ** 0.5 for s in target)
    assert abs(sum(taken.values()) - sum(target.values())) <= 3 * sum(variance.values()) ** 0.5


def test_mix_emits_the_copies(spark):
    rows = cases.awkward_rows()
    docs = cases.frame(spark, rows)
    copies = {}
    for r in m.mixed_sizes(docs).select("doc_id", "size", "copies").collect():
        copies[r.doc_id, r["size"]] = copies.get((r.doc_id, r["size"]), 0) + r.copies
    out = m.mix(docs)
    assert out.columns == [*docs.columns, "copy"]
    got = {}
    for r in out.collect():
        got[r.doc_id, _size(r.text)] = got.get((r.doc_id, _size(r.text)), 0) + 1
    assert got == {k: v for k, v in copies.items() if v}


def test_empty_tables(spark):
    empty = cases.frame(spark, []).limit(0)
    assert m.mixed_sizes(empty).collect() == [] and m.mix(empty).collect() == []
    blank = m.mixed_sizes(cases.frame(spark, [(1, None, None, None), (2, " ", "en", "a")])).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0), (0, 0.0)]


def test_a_column_named_copy_stays(spark):
    docs = cases.frame(spark, cases.awkward_rows()).withColumn("Copy", F.lit("own"))
    out = m.mix(docs)
    assert out.columns == [*docs.columns, "_copy"] and {r["Copy"] for r in out.collect()} == {"own"}
