import hashlib
import zlib

import cases
import duckdb
import pytest
from pyspark.sql import functions as F

from corpusprep.llm import merkle_manifest as m

SF = "/root/testdata/sf0.01"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [_h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _path(levels, at):
    """(side, sibling) on every level below the top."""
    out = []
    for level in levels[:-1]:
        beside = at ^ 1
        out.append(("l", level[beside]) if at & 1 else ("r", level[beside]) if beside < len(level) else ("-", ""))
        at >>= 1
    return out


def _plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc, text, lang, source, n in rows:
        leaf = _h(*map(_field, (doc, source, lang, n, text)))
        claimed = _h(*map(_field, (doc, source, lang, n + 1, text))) if doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0 else leaf
        groups.setdefault(lang, []).append((doc is not None, doc or 0, leaf, doc, claimed))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: _levels([x[2] for x in sorted(groups[k])]) for k in langs}
    top = _levels([trees[k][-1][0] for k in langs])
    out = []
    for i, k in enumerate(langs):
        for at, (_, _, leaf, doc, node) in enumerate(sorted(groups[k])):
            path = _path(trees[k], at) + _path(top, i)
            for side, beside in path:
                node = _h(beside, node) if side == "l" else _h(node, beside)
            out.append((doc, leaf, trees[k][-1][0], top[-1][0], _h(*(b for _, b in path)), node, node == top[-1][0]))
    return cases.in_order(out)


def _rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]


def _got(docs):
    out = m.audit(docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return cases.in_order(map(tuple, out.collect()))


def test_awkward_rows(spark):
    docs = cases.frame(spark, cases.awkward_rows())
    assert _got(docs) == _plain(_rows(docs))
    assert _got(cases.frame(spark, []).limit(0)) == []


def test_nulls_and_the_largest_numbers(spark):
    big = 2**63 - 1
    rows = [(1, "a", None, None, None), (2, "b", None, "s", big), (14, "c", "", "s", big), (big, None, "é", None, 3), (-big - 1, "", "é", "x", -1)]
    rows += [(i, "t", "z", "s", big) for i in range(20)]  # some of them tampered with
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = _got(docs)
    assert got == _plain(rows) and not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 65, 127, 129, 700, 4097])
def test_trees_of_all_shapes(spark, n):
    """One language of n leaves, and as many languages as there are others."""
    rows = [(i, f"t{i}", "en", "s", i) for i in range(n)] + [(10**6 + i, "t", f"l{i}", "s", 1) for i in range(n % 131)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert _got(docs) == _plain(rows)


def test_proofs_stand_alone(spark):
    """A row, its proof and a published root are enough; another leaf, another sibling or another place fails."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    proofs = m.manifest(m.document_leaves(docs).drop("claimed"))
    root = proofs.first().root
    other = proofs.withColumn("leaf", F.sha2("leaf", 256))
    moved = proofs.withColumn("sides", F.translate("sides", "lr", "rl"))
    forged = proofs.withColumn("siblings", F.reverse("siblings"))
    assert [p.where(m.verified("leaf", root)).count() for p in (proofs, other, moved, forged)] == [1000, 0, 0, 0]


def test_whole_table_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = _got(docs)
    assert got == _plain(_rows(docs)) and 0 < sum(not r[-1] for r in got) < 250
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert cases.in_order(db.execute(m.ORACLE).fetchall()) == got


def test_sql_on_awkward_rows(spark):
    docs = cases.frame(spark, cases.awkward_rows())
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", _rows(docs))
    assert cases.in_order(db.execute(m.ORACLE).fetchall()) == _plain(_rows(docs))
