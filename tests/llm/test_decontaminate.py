import hashlib
import re

import cases

from corpusprep.llm.decontaminate import build_index, contamination, search, test_windows

SF = "/root/testdata/sf0.01"


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def _plain(rows, items, window=10):
    by_window = {}
    for item, text in items:
        w = _words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            by_window.setdefault(tuple(w[i : i + size]), set()).add(str(item) if item is not None else "")
    sizes = {len(k) for k in by_window}
    out = []
    for doc, text in rows:
        w, hit, found = _words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                own = by_window.get(tuple(w[i : i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return cases.in_order(out)


def _digest(df):
    return cases.in_order((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in df.collect())


def test_awkward_rows(spark):
    rows, passage = cases.awkward_rows(), cases.prose(30, 40)
    rows += [(70, f"x {passage} y {passage}", "en", "a"), (71, passage.replace(" ", ", ").upper(), "en", "a"), (72, "one Two; three", "en", "a")]
    items = [(1, passage), (10, passage), (2, passage + " more"), (3, "two three"), (4, None), (5, ""), (None, "delta1 never seen"), (6, "?!"), (3, "two three"), (7, rows[9][1][:900])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = _plain([r[:2] for r in rows], items)
    assert sum(w[2] > 0 for w in want) >= 4
    for segment, block in ((1 << 20, 200_000), (300, 3)):  # whole; cut into pieces and searched in blocks
        assert _digest(contamination(cases.frame(spark, rows), table, segment_bytes=segment, windows_per_search=block)) == want
    assert all(r[2] == 0 for r in _digest(contamination(cases.frame(spark, rows), table.limit(0))))
    assert contamination(cases.frame(spark, []).limit(0), table).collect() == []


def test_whole_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = _plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sum(w[2] > 0 for w in want) > 0
    assert _digest(contamination(docs, items)) == want


def test_spans_are_places_of_whole_windows(spark):
    rows = [(1, "a b c d e f g h i j k", "en", "a")]
    table = spark.createDataFrame([(1, "c d e f g h i j k l"), (2, "B C D E F G H I J K")], "item_id long, text string")
    (r,) = contamination(cases.frame(spark, rows), table).collect()
    assert [tuple(s) for s in r.spans] == [(1, 11)] and r["items"] == ["2"]


def test_proximity(spark):
    docs = cases.frame(spark, [(1, "x one two three y", "en", "a"), (2, "one q two z three", "en", "a"), (3, "three two one", "en", "a"), (4, "one two", "en", "a")])
    windows = test_windows(spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    index = build_index(docs)
    assert {(r.k1, r.lo, r.hi, r.exact) for r in search(index, windows, 0).collect()} == {(1, 1, 4, True)}
    near = {(r.k1, r.lo, r.hi, r.exact) for r in search(index, windows, 2).collect()}
    assert (1, 1, 4, True) in near and (2, 0, 5, False) in near and not {4} & {k for k, *_ in near}


def _near(rows, items, window=10, slop=1):
    """Ids of the items with a window whose words all stand at most ``slop`` off their places."""
    out = []
    for doc, text in rows:
        w, found = _words(text), set()
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, set()).add(p)
        for item, other in items:
            v = _words(other)
            size = min(window, len(v))
            for j in range(len(v) - size + 1 if v else 0):
                win = v[j : j + size]
                starts = {p - d for p in at.get(win[0], ()) for d in range(-slop, slop + 1)}
                if any(all(any(s + i + d in at.get(x, ()) for d in range(-slop, slop + 1)) for i, x in enumerate(win)) for s in starts):
                    found.add(str(item) if item is not None else "")
                    break
        out.append((doc, sorted(found)))
    return cases.in_order(out)


def test_near_items(spark):
    passage = cases.prose(30, 40)
    w = passage.split()
    rows = cases.awkward_rows() + [
        (70, passage, "en", "a"), (71, " ".join([*w[:14], "extra", *w[14:]]), "en", "a"), (72, " ".join([*w[:6], *w[7:18]]), "en", "a"),
        (73, " ".join([*w[:5], w[6], w[5], *w[7:16]]), "en", "a"), (74, " ".join(reversed(w)), "en", "a"), (75, " ".join(x + " so on" for x in w), "en", "a"),
    ]
    items = [(1, passage), (2, " ".join(w[:12])), (3, "two three"), (4, None), (None, rows[9][1][:900]), (6, "?!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for segment, block in ((1 << 20, 200_000), (300, 3)):
        got = contamination(cases.frame(spark, rows), table, slop=1, segment_bytes=segment, windows_per_search=block).collect()
        assert cases.in_order((r.doc_id, list(r.near_items)) for r in got) == _near([r[:2] for r in rows], items)
        assert all(set(r["items"]) <= set(r.near_items) for r in got)
        # exact results don't depend on it
        exact = contamination(cases.frame(spark, rows), table, segment_bytes=segment)
        assert cases.in_order((r.doc_id, r.n_hit, r["items"]) for r in got) == cases.in_order((r.doc_id, r.n_hit, r["items"]) for r in exact.collect())
    by_doc = {r.doc_id: r for r in got}
    assert "2" not in by_doc[73]["items"] and "2" in by_doc[73].near_items
    assert by_doc[74].near_items == [] and by_doc[75].near_items == []


def test_index_holds_every_token(spark):
    rows = cases.awkward_rows()
    index = build_index(cases.frame(spark, rows), segment_bytes=400).collect()
    for seg in index:
        assert list(seg.terms) == sorted(set(seg.terms)) and sorted(seg.positions) == list(range(len(seg.positions)))
        assert seg.offsets[-1] == len(seg.positions) == sum(seg.words)
    firsts = [(d, t) for seg in index for d, f, t in zip(seg.doc_id, seg.first, seg.total, strict=True) if f == 0]
    assert cases.in_order(firsts) == cases.in_order((r[0], len(_words(r[1]))) for r in rows)
