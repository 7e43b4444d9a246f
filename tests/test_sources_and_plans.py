import os
import random

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import tables
from corpusprep.operators.records import record_lines
from corpusprep.operators.types import typed_frame, typed_rows
from corpusprep.sources.csv import read_bundle, read_csv_corpus, read_tsv, read_tsv_corpus
from corpusprep.sources.folder import read_lines, scan_folder, text_lines


def _write(folder, name, text, enc="utf-8"):
    p = os.path.join(folder, name)
    with open(p, "w", encoding=enc, newline="") as f:
        f.write(text)
    return p


def test_read_csv_corpus_by_dialect(spark, tmp_dir):
    wide = ",".join(f"c{i}" for i in range(70))
    _write(tmp_dir, "a.csv", 'x;y\n1;"two\nlines"\n\n3;4;5\n')
    _write(tmp_dir, "b.csv", "p,q\nä,2\n", enc="latin-1")
    _write(tmp_dir, "wide.csv", wide + "\r\n" + wide.replace("c", "") + "\r\n")
    name = F.substring_index("path", "/", -1)
    dialects = scan_folder(spark, tmp_dir).select(
        "path", F.when(name == "a.csv", ";").otherwise(",").alias("separator"), F.when(name == "b.csv", "latin-1").otherwise("utf-8").alias("encoding")
    )
    by_file = {}
    for r in read_csv_corpus(spark, tmp_dir, dialects).orderBy("path", "row_id").collect():
        by_file.setdefault(os.path.basename(r.path), []).append(r.cells)
    # the third record of a has more fields than its header: a bad line
    assert by_file["a.csv"] == [["x", "y"], ["1", "two\nlines"], ["3", "4", "5"]]
    assert by_file["b.csv"] == [["p", "q"], ["ä", "2"]]
    assert by_file["wide.csv"] == [wide.split(","), [str(i) for i in range(70)]]


def test_read_tsv_and_bundle(spark, tmp_dir):
    t = _write(tmp_dir, "t.tsv", "a\tb\n1\t2\n")
    df = read_tsv(spark, t)
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [(1, 2)]
    b = _write(tmp_dir, "b.csv", 'bundle,"key",en,pl\nshop, "OPEN", "Open now", "Otwarte"\n')
    rows = read_bundle(spark, b).collect()
    assert rows[0].asDict() == {"bundle": "shop", "key": "OPEN", "en": "Open now", "pl": "Otwarte"}


@pytest.fixture
def small_splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda size: [spark.conf.set(k, size) for k in keys]
    for k, v in before.items():
        spark.conf.set(k, v)


def test_every_tsv_file_has_its_own_types(spark, tmp_dir, small_splits):
    _write(tmp_dir, "a.tsv", "id\tprice\tok\n007\t1.50\tTRUE\n+8\t2\tfalse\n\t\t\n")
    _write(tmp_dir, "b.tsv", 'price\tnote\tnone\n12\t"two\nlines"\t\nx\t3\tNA\n')
    small_splits("16")
    rows, types = read_tsv_corpus(spark, tmp_dir, "*.tsv")
    got = {(os.path.basename(r.path), r.name): r.type for r in types.collect()}
    assert got == {("a.tsv", "id"): "bigint", ("a.tsv", "price"): "double", ("a.tsv", "ok"): "boolean",
                   ("b.tsv", "price"): "string", ("b.tsv", "note"): "string", ("b.tsv", "none"): "string"}
    frame = typed_frame(rows, types, types.where("path LIKE '%a.tsv'").first().path)
    assert frame.dtypes == [("id", "bigint"), ("price", "double"), ("ok", "boolean")]
    assert sorted(map(tuple, frame.collect()), key=str) == sorted([(7, 1.5, True), (8, 2.0, False), (None, None, None)], key=str)
    typed = {(os.path.basename(r.path), r.ord): r.fields for r in typed_rows(rows, types).collect()}
    assert typed["a.tsv", 1] == ["7", "1.5", "True"] and typed["a.tsv", 2] == ["8", "2.0", "False"] and typed["b.tsv", 1] == ["12", "two\nlines", ""]
    document = tables.csv_documents(read_lines(spark, tmp_dir, "a.tsv"), kind="TSV", quoted_breaks=True).collect()[0]
    assert document.markdown.endswith("| 7 | 1.5 | True |\n| 8 | 2.0 | False |\n|  |  |  |")


def test_read_lines_keeps_order_across_splits(spark, tmp_dir, small_splits):
    body = "h1,h2\n" + "".join(f"{i},{i * 2}\r\n" for i in range(20000))
    _write(tmp_dir, "big +1%.csv", body)
    _write(tmp_dir, "other.csv", "ä,b\n\nc,d", "latin-1")
    small_splits("16k")
    got = {}
    for r in read_lines(spark, tmp_dir, "*.csv").orderBy("path", "ord").collect():
        got.setdefault((os.path.basename(r.path), r.encoding), []).append((r.ord, r.line))
    assert got["big +1%.csv", "utf-8"] == list(enumerate(body.replace("\r", "").rstrip("\n").split("\n")))
    assert got["other.csv", "latin-1"] == [(0, "ä,b"), (1, ""), (2, "c,d")]


def _quoted_rows(n, seed):
    """Rows whose fields hold quotes, separators and line breaks, and their text."""
    rnd = random.Random(seed)
    pieces = ["plain", "", 'say "hi"', "two\nlines", 'a\n\n"b"\n', ",", '",', "it's", "x;y\tz", '""', "\n"]
    rows = [[f"r{i}", *("".join(rnd.choices(pieces, k=rnd.randrange(4))) for _ in range(2))] for i in range(n)]
    text = "".join(",".join([r[0], *('"' + v.replace('"', '""') + '"' for v in r[1:])]) + "\n" for r in rows)
    return rows, "id,first,second\n" + text


def test_quoted_breaks_across_splits_make_the_same_records_as_one_read(spark, tmp_dir, small_splits):
    rows, text = _quoted_rows(150, 3)
    _write(tmp_dir, "q.csv", text)
    odd = 'a,b\n1,x"y"z\n2,"open\nclosed",5" pipe"\n3,"never closed\n4,x""y\n\n5,y\n'
    _write(tmp_dir, "odd.csv", odd)
    _write(tmp_dir, "plain.csv", "a;b\n1;2\n")
    whole = scan_folder(spark, tmp_dir).select("path", F.col("content").cast("string").alias("text"))
    small_splits("256")
    lines = read_lines(spark, tmp_dir)
    dialects = tables.pick_csv_dialect(tables.score_csv_dialects(lines))
    dialects = dialects.withColumn("separator", F.when(F.col("path").contains("plain"), ";").otherwise(","))
    found, expected = {}, {}
    for out, df in ((found, record_lines(lines, dialects, tables.SEPARATORS)), (expected, tables.csv_records(whole, dialects))):
        for r in df.where("line != ''").orderBy("path", "ord").collect():
            out.setdefault(os.path.basename(r.path), []).append(r.line)
    assert found == expected
    assert found["odd.csv"] == ["a,b", '1,x"y"z', '2,"open\nclosed",5" pipe"', '3,"never closed', '4,x""y', "5,y"]
    parsed, _ = tables.parse_csv_lines(record_lines(lines.where(F.col("path").contains("/q.csv")), dialects, tables.SEPARATORS), dialects)
    assert [r.fields for r in parsed.orderBy("ord").collect()] == rows


def test_documents_of_many_splits_equal_those_of_one_read(spark, tmp_dir, small_splits):
    _, text = _quoted_rows(120, 5)
    _write(tmp_dir, "q.csv", text)
    _write(tmp_dir, "b.csv", 'bundle,"key",en\nshop,"OPEN","Open\nnow"\n')
    whole = scan_folder(spark, tmp_dir).select("path", F.col("content").cast("string").alias("text"))
    plain, bundle = (lambda d: d.where("path LIKE '%q.csv'")), (lambda d: d.where("path LIKE '%b.csv'"))
    one = [r.markdown for f, pick in ((tables.csv_documents, plain), (tables.bundle_documents, bundle)) for r in f(text_lines(pick(whole)), texts=pick(whole)).collect()]
    small_splits("256")
    lines = read_lines(spark, tmp_dir)
    many = [r.markdown for f, pick in ((tables.csv_documents, plain), (tables.bundle_documents, bundle)) for r in f(pick(lines), quoted_breaks=True).collect()]
    assert many == one and len(one) == 2 and "120 rows" in one[0] and "Open now" in one[1]


def test_empty_folder_of_lines(spark, tmp_dir):
    _write(tmp_dir, "e.csv", "")
    lines = read_lines(spark, tmp_dir)
    dialects = spark.createDataFrame([], "path string, separator string")
    assert record_lines(lines, dialects, tables.SEPARATORS).collect() == []


def test_scan_folder_lists_files_only(spark, tmp_dir):
    _write(tmp_dir, "a.txt", "x")
    os.makedirs(os.path.join(tmp_dir, "sub"))
    _write(os.path.join(tmp_dir, "sub"), "b.txt", "y")
    names = sorted(os.path.basename(r.path) for r in scan_folder(spark, tmp_dir).collect())
    assert names == ["a.txt"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_python_steps(spark):
    from corpusprep.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    # pages are converted, JSON is printed, and JPEG and TIFF headers are walked, in Arrow batches
    arrow = {"text_documents", "json_documents", "metadata_documents", "file_outcomes", "batch_report", "batch_progress", "corpus_documents",
             "image_sizes", "image_resize_plan", "image_decisions", "image_decorative", "pdf_documents", "image_summary",
             "html_markdown", "html_toc"}
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, sf))
        assert "BatchEvalPython" not in plan, name
        assert name in arrow or "ArrowEvalPython" not in plan, name


def test_package_collisions_have_rows(spark):
    from corpusprep.plans.queries import QUERIES

    rows = QUERIES["package_collisions"](spark, "/root/testdata/sf0.01").collect()
    assert rows and sum(r.survivor for r in rows) == len({r.package for r in rows})


def test_records_over_several_blocks_are_joined_from_pieces(spark, monkeypatch):
    """Blocks of four lines: records end in their block, in the next or some blocks later; lines are shuffled by block only."""
    from corpusprep.operators import records

    monkeypatch.setattr(records, "BLOCK_BITS", 2)
    texts = ['h,t', '1,"a\nb"', '2,"' + "\n".join("cdefghijklm") + '"', "3,x", '4,"' + "\n" * 7 + '"', '5,"y"', '6,"p\nq\nr"']
    rows = [("f.csv", i, line) for i, line in enumerate("\n".join(texts).split("\n"))] + [("f.csv", None, "no place"), (None, 3, "no file")]
    lines = spark.createDataFrame(rows, "path string, ord long, line string").repartition(3)
    dialects = spark.createDataFrame([("f.csv", ",")], "path string, separator string")
    out = record_lines(lines, dialects, tables.SEPARATORS)
    assert "LeftAnti" not in out._jdf.queryExecution().sparkPlan().toString()
    got = out.collect()
    assert [r.line for r in sorted((r for r in got if r.path and r.ord is not None), key=lambda r: r.ord)] == texts
    assert sorted(r.line for r in got if not r.path or r.ord is None) == ["no file", "no place"]
