import re

import duckdb

from corpusprep.llm import chat_format as c

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, conv long, block long, number int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def _plain(rows):
    """(conv_id, part, turns, copies, text), conversations compared as lists."""
    convs = {}
    for conv, turn, role, text in set((a, b, r or "", t or "") for a, b, r, t in rows):
        convs.setdefault(conv, []).append((turn is None, turn or 0, role, text))
    said = {k: [(r, t) for *_, r, t in sorted(v)] for k, v in convs.items()}
    out = []
    for k in said:
        same = sorted((x for x in said if said[x] == said[k]), key=lambda x: (x is None, x or 0))
        longer = any(len(v) > len(said[k]) and v[: len(said[k])] == said[k] for v in said.values())
        if same[0] != k or longer:
            continue
        blocks = {}
        for none, turn, r, t in sorted(convs[k]):
            blocks.setdefault((none, turn >> c.BLOCK_BITS), []).append(f"<|im_start|>{r}\n{t}<|im_end|>\n")
        out += [(k, i, len(said[k]), len(same), "".join(blocks[b])) for i, b in enumerate(sorted(blocks))]
    return sorted(out, key=str)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


ROWS = (
    [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(4)]
    + [(2, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(6)]  # longer
    + [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(6)]  # equal to 2
    + [(4, 0, "user", "t0"), (4, 0, "user", "t0")]  # a repeated row, prefix of the others
    + [(5, i + 10, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3)]  # other turn numbers
    + [(6, 0, "user", "t0"), (6, 1, "user", "t1")]  # another role
    + [(7, 0, None, None), (7, None, "user", "late"), (7, None, "user", "later"), (8, 0, "", ""), (None, 0, "user", "no id"), (None, 1, "user", "more")]
    + [(9, i, "user", f"long {i % 7}") for i in range(1300)]  # over several blocks
    + [(10, i, "user", f"long {i % 7}") for i in range(1100)]  # prefix of it
    + [(11, 0, "user", "tie b"), (11, 0, "user", "tie a"), (12, 0, "user", "tie a"), (12, -3, "user", "before")]
)


def test_awkward_rows(spark):
    got = _rows(c.format_conversations(_frame(spark, ROWS)))
    assert got == _plain(ROWS)
    assert {r[0] for r in got} == {2, 6, 7, 9, 11, 12, None}
    assert len([r for r in got if r[0] == 9]) == 3


def test_blocks_are_bounded_when_turn_numbers_are_null_or_tied(spark):
    rows = (
        [(None, i % 3, "user", f"no id {i}") for i in range(1700)]
        + [(1, None, "user", f"no turn {i}") for i in range(1300)]
        + [(2, 5, "user", f"tied {i}") for i in range(1100)] + [(2, 600, "user", "last")]
    )
    got = c.format_conversations(_frame(spark, rows)).collect()
    assert max(r.rendered.count("<|im_start|>") for r in got) <= c.BLOCK_ROWS
    assert {k: sum(r.conv_id == k for r in got) for k in (None, 1, 2)} == {None: 4, 1: 3, 2: 4}
    said = {}
    for r in sorted(got, key=lambda r: r.part):
        said.setdefault(r.conv_id, []).append(r)
    for k, parts in said.items():
        mine = sorted(((t is None, t or 0, role, text) for x, t, role, text in rows if x == k))
        assert [r.part for r in parts] == list(range(len(parts))) and {r.n_turns for r in parts} == {len(mine)}
        assert "".join(r.rendered for r in parts) == "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for *_, role, text in mine)
    numbered = c.numbered_turns(_frame(spark, rows)).groupBy("conv", "block").count().collect()
    assert max(r["count"] for r in numbered) <= c.BLOCK_ROWS


def test_empty_table(spark):
    assert c.format_conversations(_frame(spark, []).limit(0)).collect() == []


def test_whole_table_and_sql(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = _rows(c.format_conversations(table))
    assert got == _plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == sorted(db.execute(c.ORACLE).fetchall(), key=str)


def test_prefix_hashes_do_not_depend_on_blocks(spark):
    rows = c.numbered_turns(_frame(spark, ROWS)).where("conv in (9, 10)").collect()
    at = {(r.conv, r.number): (r.h1, r.h2) for r in rows}
    assert all(at[9, n] == at[10, n] for n in range(1, 1101)) and len(set(at.values())) == 1300


def test_no_python_in_the_plan(spark):
    plan = c.format_conversations(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
