from pyspark.sql import functions as F

from corpusprep.config import Settings
from corpusprep.operators import tables


def _lines(spark, files):
    rows = []
    for path, text in files.items():
        for i, line in enumerate(text.split("\n")):
            rows.append((path, i, line))
    return spark.createDataFrame(rows, "path string, ord long, line string")


def _dialects(spark, files):
    lines = _lines(spark, files)
    return lines, tables.pick_csv_dialect(tables.score_csv_dialects(lines))


def test_separator_detection(spark):
    _, d = _dialects(spark, {"semi.csv": "a;b\n1;2\n", "comma.csv": "a,b\n1,2\n", "one.csv": "a\n1\n"})
    got = {r.path: r.separator for r in d.collect()}
    assert got == {"semi.csv": ";", "comma.csv": ",", "one.csv": ";"}


def test_empty_and_header_only(spark):
    files = {"empty.csv": "", "head.csv": "a;b\n"}
    lines, d = _dialects(spark, files)
    rows, headers = tables.parse_csv_lines(lines, d)
    prof = tables.table_profile(rows, headers, d)
    docs = tables.render_table_document(prof, tables.csv_tables(rows, headers)).unionByName(tables.unreadable_documents(lines, headers), allowMissingColumns=True)
    got = {r.path: r for r in docs.collect()}
    assert got["empty.csv"].markdown is None and "Unable to parse CSV" in got["empty.csv"].error
    assert got["head.csv"].markdown.startswith("# Empty CSV File")


def test_bad_lines_skipped_and_document(spark):
    files = {"x.csv": 'a,b\n1,"q, r"\n2,3,4\n\n5,6\n'}
    lines, d = _dialects(spark, files)
    rows, headers = tables.parse_csv_lines(lines, d)
    prof = tables.table_profile(rows, headers, d).collect()[0]
    assert (prof.total_rows, prof.total_columns, prof.strategy) == (2, 2, "skip_bad_lines")
    doc = tables.render_table_document(tables.table_profile(rows, headers, d), tables.csv_tables(rows, headers)).collect()[0]
    assert "**Separator:** ','" in doc.markdown
    assert "| a | b |\n| --- | --- |\n| 1 | q, r |\n| 5 | 6 |" in doc.markdown
    assert "**Note:** Some malformed lines were skipped" in doc.markdown


def test_row_cap_is_window_limit(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    capped = tables.truncate_rows(df, 10, ["id"], ["g"])
    assert capped.count() == 30
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bundle(spark):
    files = {"b.csv": 'bundle,"key",en,pl\nshop,"OPEN","Open now","Otwarte"\nshop\n'}
    lines = _lines(spark, files)
    first = lines.groupBy("path").agg(F.min_by("line", "ord").alias("first_line"))
    assert first.select(tables.is_bundle("first_line")).collect()[0][0] is True
    d = first.select("path", F.lit(",").alias("separator"))
    rows, headers = tables.parse_csv_lines(lines, d, skip_initial_space=True)
    stats = tables.bundle_stats(rows, headers)
    doc = tables.render_bundle_document(stats, tables.bundle_tables(rows, headers)).collect()[0].markdown
    assert "**Languages:** en, pl" in doc
    assert "| bundle | key | en | pl |" in doc
    assert "| shop | OPEN | Open now | Otwarte |\n| shop |  |  |  |" in doc
    assert "- **PL Translations:** 2" in doc


def test_frame_table_and_workbook(spark):
    df = spark.createDataFrame([(1, 3), (2, 4)], "a long, b long")
    t = tables.frame_markdown_table(df, ["a"]).collect()[0].table
    assert t == "| a | b |\n| --- | --- |\n| 1 | 3 |\n| 2 | 4 |"
    sheets = spark.createDataFrame(
        [("w.xlsx", 0, "Sheet1", 0, 2, 2, 2, 2, t, None), ("w.xlsx", 1, "Empty", 0, 0, 0, 0, 0, None, None)],
        "workbook string, sheet_idx int, sheet_name string, part_no long, row_count long, column_count int, shown_rows long, shown_columns int, table string, error string",
    )
    wb, rest = sorted(tables.assemble_workbook(sheets).collect(), key=lambda r: r.part_no)
    assert wb.sheet_count == 2 and wb.total_rows == 2 and wb.max_columns == 2
    assert {k: tuple(v) for k, v in wb.sheets_data.items()} == {"Sheet1": (2, 2, None)} and wb.sheet_names == ["Sheet1", "Empty"]
    assert "**Sheet Names:** Sheet1, Empty" in wb.markdown and "*No data found in this sheet*" in rest.markdown


def test_workbook_parts_are_numbered_over_sheets(spark):
    rows = [("w", s, f"S{s}", p, 9, 1, 9, 1, f"t{s}.{p}", None, ["c"]) for s, n in ((3, 2), (1, 3), (2, 1)) for p in range(n)]
    sheets = spark.createDataFrame(rows, "workbook string, sheet_idx int, sheet_name string, part_no long, row_count long, column_count int,"
                                   " shown_rows long, shown_columns int, table string, error string, column_names array<string>").repartition(4)
    got = sorted(tables.assemble_workbook(sheets).collect(), key=lambda r: r.part_no)
    assert [r.part_no for r in got] == list(range(6))
    assert [next(t for t in ("t1.0", "t1.1", "t1.2", "t2.0", "t3.0", "t3.1") if t in r.markdown) for r in got] == ["t1.0", "t1.1", "t1.2", "t2.0", "t3.0", "t3.1"]
    assert got[0].sheets_data["S1"].column_names == ["c"] and got[0].file_type == "Excel"


def test_pandas_header_names(spark):
    df = spark.createDataFrame([(["a", "", "a", "b", "a"],)], "n array<string>")
    assert df.select(tables.header_names("n")).collect()[0][0] == ["a", "Unnamed: 1", "a.1", "b", "a.2"]


def _split(spark, line, sep, **kw):
    return spark.createDataFrame([(line,)], "v string").select(tables.split_fields("v", sep, **kw).alias("o")).collect()[0].o


def test_quotes_inside_fields_are_text(spark):
    assert _split(spark, 'a;5" pipe;c', ";") == ["a", '5" pipe', "c"]
    assert _split(spark, 'k;it"s;v', ";") == ["k", 'it"s', "v"]
    assert _split(spark, 'a;"x;y"z;c', ";") == ["a", "x;yz", "c"]
    assert _split(spark, '"a ""b"" c","",d,', ",") == ['a "b" c', "", "d", ""]
    assert _split(spark, '1,"open, to the end', ",") == ["1", "open, to the end"]
    assert _split(spark, 'a, "b, c",  d', ",", skip_initial_space=True) == ["a", "b, c", "d"]
    assert _split(spark, "", ";") == [""]


def test_records_span_lines_inside_quotes(spark):
    text = 'n;text\n1;"two\nlines; and ""more"""\n2;it"s\n\n3;plain'
    files = spark.createDataFrame([("f.csv", text)], "path string, text string")
    d = spark.createDataFrame([("f.csv", ";")], "path string, separator string")
    rows, headers = tables.parse_csv_lines(tables.csv_records(files, d), d)
    got = [r.fields for r in rows.orderBy("ord").collect()]
    assert got == [["1", 'two\nlines; and "more"'], ["2", 'it"s'], ["3", "plain"]]
    assert headers.collect()[0].names == ["n", "text"]


def test_no_limit_on_blank_lines_columns_and_cells(spark):
    wide = ",".join(f"c{i}" for i in range(70))
    files = {"blank.csv": "a,b" + "\n" * 140 + "1,2", "wide.csv": wide + "\n" + ",".join(str(i) for i in range(70)) + "\n", "long.csv": "a,b\n" + "x" * 900 + ",y"}
    lines, d = _dialects(spark, files)
    assert {r.separator for r in d.collect()} == {","}
    docs = {r.path: r.markdown for r in tables.csv_documents(lines).collect()}
    assert "| 1 | 2 |" in docs["blank.csv"] and "| 68 | 69 |" in docs["wide.csv"] and "c69 |" in docs["wide.csv"] and "x" * 900 in docs["long.csv"]


def test_tables_come_in_parts(spark):
    text = "n;v\n" + "\n".join(f"{i};v{i}" for i in range(1, 26))
    lines = _lines(spark, {"f.csv": text})
    parts = sorted(tables.csv_documents(lines, Settings(part_rows=10)).collect(), key=lambda r: r.part_no)
    assert [p.part_no for p in parts] == [0, 1, 2]
    body = "\n".join(p.markdown for p in parts)
    assert body.endswith("\n".join(f"| {i} | v{i} |" for i in range(1, 26))) and "**Dimensions:** 25 rows" in parts[0].markdown
    limited = tables.csv_documents(lines, Settings(max_rows_display=3)).collect()[0].markdown
    assert limited.endswith("| 3 | v3 |") and "Data truncated for display (showing 3 rows" in limited


def test_frame_tables_sort_by_raw_values(spark):
    df = spark.createDataFrame([("[b",), ("a",), ("|c",), (None,)], "t string")
    (r,) = tables.frame_markdown_table(df, ["t"]).collect()
    assert r.table.split("\n")[2:] == ["|  |", "| \\[b |", "| a |", "| \\|c |"]


def test_bundle_without_rows_or_languages(spark):
    files = {"head.csv": 'bundle,"key",en\n', "bare.csv": 'bundle,"key"\nshop,"OPEN"\n'}
    docs = {r.path: r.markdown for r in tables.bundle_documents(_lines(spark, files)).collect()}
    assert "*No translation data found*" in docs["head.csv"] and "**Total Entries:** 0" in docs["head.csv"]
    assert "| shop | OPEN |" in docs["bare.csv"] and "**Total Languages:** 0" in docs["bare.csv"]


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_parts_are_joined_from_sorted_lines(spark):
    """No aggregate's lists, which held the lines of all parts that a task sees; the text is as before, ties by line."""
    lines = spark.createDataFrame([("a", 2, "x"), ("a", 0, "z"), ("a", 0, "y"), ("a", 5, "w"), ("b", 1, "v")], "path string, ord long, _line string")
    heads = spark.createDataFrame([("a", ["n", "m"]), ("b", ["k"]), ("c", ["j"])], "path string, names array<string>")
    out = tables.join_parts(lines.repartition(3), heads, ["path"], "ord", settings=Settings(part_rows=2))
    assert "collect_list" not in _plan(out)
    got = {(r.path, r.part_no): (r.names, r.table) for r in out.collect()}
    assert got == {
        ("a", 0): (["n", "m"], "| n | m |\n| --- | --- |\ny\nz"), ("a", 1): (None, "x"), ("a", 2): (None, "w"),
        ("b", 0): (["k"], "| k |\n| --- |\nv"), ("c", 0): (["j"], "*No data to display*"),
    }


def test_lines_are_not_shuffled_by_file(spark):
    """One file's lines stay where they are: the row of its header is broadcast, also to the statistics of a bundle."""
    lines = _lines(spark, {"b.csv": 'bundle,"key",en\n' + "\n".join(f'shop,"K{i}",text' for i in range(50))})
    dialects = spark.createDataFrame([("b.csv", ",")], "path string, separator string")
    rows, headers = tables.parse_csv_lines(lines, dialects, skip_initial_space=True)
    assert "BroadcastHashJoin" in _plan(rows) and "SortMergeJoin" not in _plan(rows)
    assert "SortMergeJoin" not in _plan(tables.bundle_cells(rows, headers))
