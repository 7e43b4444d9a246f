from pyspark.sql import functions as F

from corpusprep.functions.text import clean_cell, clean_column_name, decode_text, detect_encoding, json_valid
from corpusprep.operators.text import render_simple


def _one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).collect()[0].o


def test_json_pretty(spark):
    df = spark.createDataFrame([("/x/stock.json", '{"shelf": "B", "left": 40}')], "path string, text string")
    r = render_simple(df).collect()[0]
    assert r.parser == "json_simple"
    assert r.markdown == '```json\n{\n  "shelf": "B",\n  "left": 40\n}\n```'
    assert r.error is None


def test_bad_and_empty_json(spark):
    df = spark.createDataFrame([("/x/bad.json", '{"shelf": "B" "left"}'), ("/x/empty.json", "")], "path string, text string")
    rows = {r.path: r for r in render_simple(df).collect()}
    assert rows["/x/bad.json"].markdown == '```\n{"shelf": "B" "left"}\n```'
    assert rows["/x/bad.json"].error is not None
    assert rows["/x/empty.json"].markdown == "```\n\n```"
    assert rows["/x/empty.json"].error is not None


def test_code_fences(spark):
    exts = [".py", ".js", ".java", ".cs", ".c", ".cpp", ".go", ".rb", ".php", ".rs", ".kt", ".swift"]
    df = spark.createDataFrame([(f"/x/code{e}", "total = price * 2") for e in exts], "path string, text string")
    for r in render_simple(df).collect():
        lang = r.path.rsplit(".", 1)[1]
        assert r.parser == "code_simple" and r.language == lang
        assert r.markdown == f"```{lang}\ntotal = price * 2\n```"


def test_text_and_unknown(spark):
    df = spark.createDataFrame([("/x/a.txt", "hello"), ("/x/notes.xyz", "plain"), ("/x/e.txt", "")], "path string, text string")
    rows = {r.path: r for r in render_simple(df).collect()}
    assert rows["/x/a.txt"].markdown == "hello" and rows["/x/a.txt"].parser == "txt_simple"
    assert rows["/x/notes.xyz"].markdown == "plain" and rows["/x/notes.xyz"].parser == "txt_simple"
    assert rows["/x/e.txt"].markdown == ""


def test_decode_drops_bad_bytes_and_normalises_newlines(spark):
    raw = bytes([0x61, 0xFF, 0x62, 0x0D, 0x0A, 0x63, 0x0D, 0x64])
    assert _one(spark, decode_text(F.col("v")), raw, "v binary") == "ab\nc\nd"
    assert _one(spark, decode_text(F.col("v")), "x�y".encode(), "v binary") == "x�y"
    assert _one(spark, detect_encoding(F.col("v")), "é".encode("latin-1"), "v binary") == "latin-1"
    assert _one(spark, detect_encoding(F.col("v")), "é".encode(), "v binary") == "utf-8"


def test_clean_cell(spark):
    assert _one(spark, clean_cell(F.col("v")), "  a |b\n [c]  ") == "a \\|b \\[c\\]"
    assert _one(spark, clean_cell(F.col("v")), "NaN") == ""
    assert _one(spark, clean_cell(F.col("v")), "a  b") == "a b"
    assert _one(spark, clean_cell(F.col("v")), "x" * 600) == "x" * 600
    long = _one(spark, clean_cell(F.col("v"), max_chars=500), "x" * 600)
    assert len(long) == 500 and long.endswith("...")
    assert _one(spark, clean_cell(F.col("v"), 2), "a|b") == "a\\\\|b"


def test_clean_column_name(spark):
    assert _one(spark, clean_column_name(F.col("v")), " nan ") == "Unnamed_Column"
    assert _one(spark, clean_column_name(F.col("v")), "a|b\nc") == "a_b c"
    assert _one(spark, clean_column_name(F.col("v")), "y" * 60) == "y" * 60
    assert _one(spark, clean_column_name(F.col("v"), 50), "y" * 60) == "y" * 47 + "..."


def test_json_valid_is_strict(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1},',), ("",), ("[1, 2]",)], "v string")
    assert [r.o for r in df.select(json_valid(F.col("v")).alias("o")).collect()] == [True, False, False, True]


def test_json_of_any_size_repeated_keys_and_nan(spark):
    big = "[" + ", ".join(["1234567890"] * 2_000_000) + "]"  # 24 MB
    df = spark.createDataFrame([(1, big), (2, '{"a": 1, "a": 2}'), (3, '{"a": NaN}'), (4, "[" * 100_000)], "i int, v string")
    assert {r.i: r.o for r in df.select("i", json_valid(F.col("v")).alias("o")).collect()} == {1: True, 2: True, 3: True, 4: False}
