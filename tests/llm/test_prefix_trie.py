import hashlib
import random
import zlib

import duckdb

from corpusprep.llm import prefix_trie as p

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, conv long, at int, digest string, number int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(3)


def _digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def _plain(rows):
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, _digest(role or "", text or ""), role or "", text or ""))
    said = {c: [x[3:] for x in sorted(v)] for c, v in said.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in said}
    base = {c: c - (c % 20 if c >= 0 else -(-c % 20)) for c in said}
    rebuilt = {c: tuple(said.get(base[c], [])[: h[c]] + v[h[c] :]) for c, v in said.items()}
    members = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if rebuilt[c] == node).encode()).hexdigest(),
    ) for node, m in members.items())


def _got(df):
    order = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert df.columns == list(order)
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def _same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


ROWS = (
    [(c, i, "user" if i % 2 == 0 else "assistant", f"turn {i} of  many") for c in (0, 1, 2, 3, 20, 21) for i in range(c % 5 + 1)]
    + [(c, i, "user", "one first turn" if i == 0 else f"own {c} {i}") for c in range(100, 160) for i in range(3)]
    + [(c, i, "user", f"the same {i}") for c in range(205, 400) for i in range(4)]
    + [(401, None, "user", "no number"), (401, None, "user", "none, too"), (401, 0, None, None), (401, 0, "", ""), (401, 5, "user", "x"), (401, 5, "user", "x")]
    + [(None, 0, "user", "no id"), (None, None, None, None), (-5, 0, "user", "below zero"), (-5, 1, "user", "zero"), (-25, 0, "user", "one first turn")]
    + [(500, i, "user", f"long {i % 7}") for i in range(1300)] + [(501, i, "user", f"long {i % 7}") for i in range(1300)] + [(502, i, "user", f"long {i % 7}") for i in range(700)]
    + [(600 + i, 0, "user", "short") for i in range(12)] + [(700, 3, "assistant", "é " * 5000)]
)


def test_awkward_rows(spark):
    want = _plain(ROWS)
    assert any(r[1] == 0 and r[2] is None for r in want) and any(r[3] > 100 and r[1] == 4 for r in want)
    _same(_got(p.trie_digest(_frame(spark, ROWS))), want)


def test_end_lists_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(p, "RUN", 7)
    _same(_got(p.trie_digest(_frame(spark, ROWS))), _plain(ROWS))


def test_random_conversations(spark):
    rnd = random.Random(5)
    rows = [(c, i, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b b", ""])) for c in range(300) for i in range(rnd.randrange(1, 7))]
    _same(_got(p.trie_digest(_frame(spark, rows))), _plain(rows))


def test_general_trie_and_end_lists(spark):
    turns = [(c, n, x, 2 if n else 0) for c, s in ((7, "ab"), (3, "ab"), (5, "abc"), (9, "")) for n, x in enumerate(["", *s])]
    nodes, ends = p.prefix_trie(spark.createDataFrame(turns, "conv long, number long, digest string, words long"))
    got = {r.depth: r for r in nodes.collect()}
    assert {d: (r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for d, r in got.items()} == {
        0: (3, 4, 1, 1, 8), 1: (3, 3, 1, 1, 8), 2: (3, 3, 1, 1, 4), 3: (5, 1, 0, 1, 0)}
    assert sorted((r.depth, r.conv) for r in ends.collect()) == [(0, 9), (2, 3), (2, 7), (3, 5)]


def test_empty_table(spark):
    assert p.trie_digest(_frame(spark, []).limit(0)).collect() == []
    assert p.trie_digest(_frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_whole_table_and_sql(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = _got(p.trie_digest(table))
    _same(got, _plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    _same(got, db.execute(p.ORACLE).fetchall())


def test_sql_on_awkward_rows(spark):
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [r for r in ROWS if r[0] is None or r[0] < 300 or r[0] == 401]
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    _same(db.execute(p.ORACLE).fetchall(), _plain(rows))


