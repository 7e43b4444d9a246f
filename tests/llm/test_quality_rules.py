import math
from collections import Counter, defaultdict

import cases

from corpusprep.llm import quality_rules as q

SF = "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\x0c\r"


def _plain(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    seen, dup, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if line.strip(BLANK):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(c not in BLANK for c in text or ""), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), lines


def test_measures():
    for text in [None, "", "a", "a b c", "a b c a b c", "x # y\nx # y\n \n\nx # y", "é é é é é é", "a\x1cb\x85c d", *(r[1] for r in cases.awkward_rows()[:20])]:
        assert q.measured(text) == _plain(text)


def _decile(values, k):
    """Bucketed decile of the plain values."""
    buckets = sorted(0 if v < 1e-4 else math.ceil(math.log(v / 1e-4) / math.log(q.GAMMA)) + 1 for v in values)
    b = next(b for i, b in enumerate(buckets, 1) if 10 * i >= k * len(buckets))
    return 0.0 if b == 0 else 1e-4 * q.GAMMA ** (b - 1) * 2 / (1 + q.GAMMA)


#: Allowance of a document of one unit, and the place of the units among the counts.
ALLOWED = {"symbols": (1.0, 0), "repeated_words": (2.0, 0), "repeated_lines": (0.6, 5), "word_length": (2.0, 0)}


def _check(docs, min_rejected):
    rows = {r.doc_id: (r, _plain(r.text)) for r in docs.collect()}
    value = {d: {"symbols": m[2] / max(m[0], 1), "repeated_words": m[4] / max(m[0], 1), "repeated_lines": m[3] / max(m[5], 1), "word_length": m[1] / max(m[0], 1)} for d, (_, m) in rows.items()}
    failed = {d: m[0] < 50 or 100 * m[4] > 50 * m[0] for d, (_, m) in rows.items()}
    groups = defaultdict(list)
    for d, (r, _) in rows.items():
        if not failed[d]:
            for g in ((r.lang, r.source), (r.lang,), ()):
                groups[g].append(d)
    got = {r.doc_id: r for r in q.apply_quality_rules(docs).collect()}
    assert set(got) == set(rows)
    limits = {}
    rejected = Counter()
    for d, (r, m) in rows.items():
        g = next(g for g in ((r.lang, r.source), (r.lang,), ()) if len(groups[g]) >= q.MIN_DOCS or not g)
        bad = []
        for k, (allowance, units) in ALLOWED.items():
            if (g, k) not in limits:
                limits[g, k] = [_decile([value[x][k] for x in groups[g]], i) for i in (1, 5, 9)]
            q1, q5, q9 = limits[g, k]
            room = allowance / math.sqrt(max(m[units], 1))
            if value[d][k] > q5 + q.FENCE * (q9 - q5) + room or k == "word_length" and value[d][k] < q5 - q.FENCE * (q5 - q1) - room:
                bad.append(k)
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == m[:5]
        assert (got[d].base_failed, got[d].kept, got[d].failed) == (failed[d], not failed[d] and not bad, bad), d
        rejected.update(bad if not failed[d] else [])
    assert all(rejected[k] >= n for k, n in min_rejected.items()), rejected
    return rows, got, limits


def test_whole_table_matches_brute_force(spark):
    _check(spark.read.parquet(f"{SF}/documents.parquet"), {"symbols": 1, "word_length": 1})


def test_every_measure_rejects_something_and_good_documents_stay(spark):
    folder = "/root/testdata/sf0.1"
    rows, got, limits = _check(spark.read.parquet(f"{folder}/documents.parquet"), dict.fromkeys(ALLOWED, 1))
    # limits follow their group
    assert len({round(v[2], 6) for (_, k), v in limits.items() if k == "word_length"}) > 3
    assert len({round(v[2], 6) for (_, k), v in limits.items() if k == "repeated_words"}) > 3
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    judged = [(r.quality, got[r.doc_id].kept) for r in labels if r.doc_id in got and not got[r.doc_id].base_failed]
    assert sum(kept for quality, kept in judged if quality == 1) >= 0.99 * sum(quality == 1 for quality, _ in judged)
    assert sum(kept for quality, kept in judged if quality == 0) <= 0.1 * sum(quality == 0 for quality, _ in judged)


def test_awkward_rows(spark):
    rows = cases.awkward_rows()
    got = q.apply_quality_rules(cases.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert q.apply_quality_rules(cases.frame(spark, []).limit(0)).collect() == []


def test_no_document_passes_the_base_rules(spark):
    got = q.apply_quality_rules(cases.frame(spark, [(1, "a b", "en", "a"), (2, None, None, None)])).collect()
    assert [r.kept for r in got] == [False, False]


def test_merged_sketches_equal_one_sketch(spark):
    docs = cases.frame(spark, cases.awkward_rows())
    rows = q.text_measures(docs)
    one = {tuple(r) for r in q.sketches(rows.coalesce(1)).collect()}
    assert one == {tuple(r) for r in q.sketches(rows.repartition(7)).collect()}
