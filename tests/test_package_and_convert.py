import json
import time
import os
import zipfile

from pyspark.sql import functions as F

from corpusprep.operators import package
from corpusprep.plans.convert import convert_folder
from corpusprep.sinks.markdown_files import write_markdown
from corpusprep.sinks.zip_packages import write_packages
from corpusprep.streaming.folder import stream_folder


def test_nested_media_flattened(spark):
    e = spark.createDataFrame([("p", "media/media/test_image.jpg", b"1"), ("p", "media/a.png", b"top"), ("p", "media/media/a.png", b"low")],
                              "package string, entry string, bytes binary")
    got = {r.entry: bytes(r.bytes) for r in package.flatten_nested_media(e).collect()}
    assert got == {"media/test_image.jpg": b"1", "media/a.png": b"top"}


def test_zip_packages(spark, tmp_dir):
    docs = spark.createDataFrame([("doc", "doc.txt", "txt_simple", "# hi"), ("none", "none.txt", "txt_simple", "")],
                                 "package string, source_filename string, parser string, markdown string")
    docs = package.metadata_json(docs)
    media = spark.createDataFrame([("doc", "image.jpg", b"jpg"), ("none", "x.png", b"x")], "package string, name string, bytes binary")
    out = os.path.join(tmp_dir, "out")
    os.makedirs(out)
    with open(os.path.join(out, "doc.zip"), "wb") as f:
        f.write(b"old")
    write_packages(package.package_entries(docs, media), out)
    assert sorted(os.listdir(out)) == ["doc.zip"]
    with zipfile.ZipFile(os.path.join(out, "doc.zip")) as z:
        assert z.namelist() == ["doc.md", "metadata.json", "media/image.jpg"]
        assert json.loads(z.read("metadata.json")) == {"source_filename": "doc.txt", "parser": "txt_simple"}
        assert z.read("metadata.json").decode().startswith('{\n    "source_filename"')


def _make_folder(root):
    os.makedirs(os.path.join(root, "img"))
    files = {
        "a.txt": "hello", "b.json": '{"k": 1}', "c.md": "![x](./img/p.png) ![y](./img/missing.png)",
        "d.csv": "a;b\n1;2\n", "e.html": "<html><head><title>T</title></head><body><h1>H</h1><p>para</p></body></html>",
        "f.bin": "zz", "~$g.txt": "temp", "h.pdf": "%PDF",
    }
    for name, text in files.items():
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    with open(os.path.join(root, "img", "p.png"), "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n")


def test_convert_folder(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    os.makedirs(src)
    _make_folder(src)
    outs = {os.path.basename(r.path): (r.status, r.parser) for r in convert_folder(spark, src, out, suffix="rag").collect()}
    assert outs["a.txt"] == ("ok", "txt_simple") and outs["b.json"] == ("ok", "json_simple")
    assert outs["c.md"] == ("ok", "md_custom") and outs["d.csv"] == ("ok", "pandas_csv") and outs["e.html"] == ("ok", "pandoc")
    assert outs["f.bin"][0] == "skipped" and outs["~$g.txt"][0] == "skipped" and outs["h.pdf"][0] == "failed"
    zips = sorted(os.listdir(out))
    assert zips == ["a_rag.zip", "b_rag.zip", "c_rag.zip", "d_rag.zip", "e_rag.zip"]
    with zipfile.ZipFile(os.path.join(out, "c_rag.zip")) as z:
        assert z.read("c_rag.md").decode() == "![x](media/img_p.png) ![y](./img/missing.png)"
        assert "media/img_p.png" in z.namelist()
    with zipfile.ZipFile(os.path.join(out, "e_rag.zip")) as z:
        assert z.read("e_rag.md").decode() == "---\ntitle: T\n---\n\n# H\n\npara"


def _zip(out, name):
    with zipfile.ZipFile(os.path.join(out, f"{name}.zip")) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_convert_folder_tables(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    os.makedirs(src)
    files = {
        "same.csv": b"a;b\n1;2\n", "same.txt": b"the text", "latin.csv": "name;town\nJos\u00e9;K\u00f6ln\n".encode("latin-1"),
        "quoted.csv": b'n;t\n1;"two\nlines"\n2;5" pipe\n', "words.csv": 'bundle,"key",en,pl\nshop, "OPEN", "Open now", "Otwarte"\n'.encode(),
        "tabs.tsv": b"a|b\t\n1\t2\n", "empty.csv": b"\n\n",
        "doc.md": b"![a](pic.weird) ![b](sub/../pic.weird) ![c](plain)", "pic.weird": b"W", "plain": b"P",
    }
    for name, data in files.items():
        with open(os.path.join(src, name), "wb") as f:
            f.write(data)
    outs = {os.path.basename(r.path): r.status for r in convert_folder(spark, src, out).collect()}
    assert outs["same.csv"] == "skipped" and outs["same.txt"] == "ok"  # one of them keeps the package
    assert _zip(out, "same")["same.md"] == b"the text" and len(_zip(out, "same")) == 2
    latin = _zip(out, "latin")
    assert "| Jos\u00e9 | K\u00f6ln |" in latin["latin.md"].decode() and "**Encoding:** latin-1" in latin["latin.md"].decode()
    meta = json.loads(latin["metadata.json"])
    assert (meta["encoding"], meta["separator"], meta["parsing_strategy"], meta["total_rows"], meta["total_columns"]) == ("latin-1", ";", "strict", 1, 2)
    assert (meta["file_type"], meta["displayed_rows"], meta["column_names"], meta["had_parsing_issues"]) == ("CSV", 1, ["name", "town"], False)
    assert meta["detection_score"] > 0
    quoted = _zip(out, "quoted")["quoted.md"].decode()
    assert "| 1 | two lines |\n| 2 | 5\" pipe |" in quoted and "2 rows" in quoted
    words = _zip(out, "words")
    assert "Translation Bundle" in words["words.md"].decode() and "| shop | OPEN | Open now | Otwarte |" in words["words.md"].decode()
    meta = json.loads(words["metadata.json"])
    assert meta["languages"] == ["en", "pl"] and meta["column_names"] == ["bundle", "key", "en", "pl"] and meta["total_languages"] == 2
    meta = json.loads(_zip(out, "tabs")["metadata.json"])
    assert meta["file_type"] == "TSV" and meta["column_names"] == ["a_b", "Unnamed: 1"] and "encoding" not in meta
    assert outs["empty.csv"] == "failed" and "empty.zip" not in os.listdir(out)
    doc = _zip(out, "doc")
    assert doc["doc.md"].count(b"media/") == 3 and doc["media/pic.weird"] == b"W"
    assert [v for k, v in doc.items() if k.startswith("media/plain")] == [b"P"]


def test_statuses_without_documents_equal_those_of_documents(spark):
    from corpusprep.operators import report
    from corpusprep.plans.convert import convert_texts, file_statuses, route_files

    texts = ["", "x", "{}", "{bad", "\n\r\n", "<p></p>", "<title>t</title>", "a;b\n1;2", 'bundle,"key",en\ns,"K","v"', None]
    names = [".txt", ".json", ".py", ".md", ".csv", ".tsv", ".html", ".pdf", ".zip", ".docx"]
    rows = [(f"/in/f{i}{'' if e != '.md' else 'm'}_{j}{e}", t) for i, t in enumerate(texts) for j, e in enumerate(names)]
    routed = route_files(spark.createDataFrame(rows, "path string, text string"))
    want = report.outcomes(routed, convert_texts(routed))
    key = lambda r: (r.path, r.parser, r.status, r.message)
    texted = {p for p, t in rows if t is not None}
    assert sorted(key(r) for r in file_statuses(routed).collect() if r.path in texted) == sorted(key(r) for r in want.collect() if r.path in texted)


def test_write_markdown(spark, tmp_dir):
    docs = spark.createDataFrame([("a", "a.txt", "txt_simple", "x", "{}", None)],
                                 "package string, source_filename string, parser string, markdown string, metadata string, error string")
    write_markdown(docs, os.path.join(tmp_dir, "md"))
    assert os.path.isdir(os.path.join(tmp_dir, "md", "parser=txt_simple"))


def test_stream_folder(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("hello")
    q = stream_folder(spark, src, out, ck)
    q.awaitTermination(120)
    assert os.listdir(out) == ["a.zip"]
    os.makedirs(os.path.join(src, "img"))
    for name, text in (("b.py", "print(1)"), ("c.md", "![x](img/p.png)"), ("img/p.png", "P")):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    report = os.path.join(tmp_dir, "report")
    q = stream_folder(spark, src, out, ck, report_table=report)
    q.awaitTermination(120)
    assert sorted(os.listdir(out)) == ["a.zip", "b.zip", "c.zip"]
    assert _zip(out, "c")["c.md"] == b"![x](media/img_p.png)" and _zip(out, "c")["media/img_p.png"] == b"P"
    assert {(os.path.basename(r.path), r.status) for r in spark.read.parquet(report).collect()} == {("b.py", "ok"), ("c.md", "ok")}
    with zipfile.ZipFile(os.path.join(out, "b.zip")) as z:
        assert z.read("b.md").decode() == "```py\nprint(1)\n```"


def _write(folder, name, text):
    os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_a_document_waits_for_a_late_image(spark, tmp_dir):
    src, out, ck, report = (os.path.join(tmp_dir, d) for d in ("in", "out", "ck", "report"))
    _write(src, "doc.md", "![x](img/late[1].png) ![y](img/p.png)")
    _write(src, "img/p.png", "P")
    run = lambda **kw: stream_folder(spark, src, out, ck, report_table=report, **kw).awaitTermination(240)
    run(wait_seconds=3600)
    assert not os.path.isdir(out) or os.listdir(out) == []  # still waiting, over the end of the query
    _write(src, "img/late[1].png", "L")
    _write(src, "other.txt", "t")
    run(wait_seconds=3600)
    assert sorted(os.listdir(out)) == ["doc.zip", "other.zip"]
    doc = _zip(out, "doc")
    assert doc["media/img_p.png"] == b"P" and b"![y](media/img_p.png)" in doc["doc.md"]
    assert {(os.path.basename(r.path), r.status) for r in spark.read.parquet(report).collect()} == {("doc.md", "ok"), ("other.txt", "ok")}


def test_a_wait_ends_and_package_names_collide_across_batches(spark, tmp_dir):
    src, out, ck, report = (os.path.join(tmp_dir, d) for d in ("in", "out", "ck", "report"))
    run = lambda **kw: stream_folder(spark, src, out, ck, report_table=report, **kw).awaitTermination(240)
    _write(src, "same.txt", "the first")
    _write(src, "doc.md", "![x](img/never.png)")
    run(wait_seconds=1)
    assert os.listdir(out) == ["same.zip"]
    time.sleep(1.5)
    _write(src, "same.py", "print()")  # comes later: the package has its document
    run(wait_seconds=1)
    assert _zip(out, "doc")["doc.md"] == b"![x](img/never.png)"
    assert _zip(out, "same")["same.md"] == b"the first"
    got = {(os.path.basename(r.path), r.status) for r in spark.read.parquet(report).collect()}
    assert got == {("same.txt", "ok"), ("doc.md", "ok"), ("same.py", "skipped")}


def test_custom_processor(spark, tmp_dir):
    from corpusprep.operators import routing
    from corpusprep.plans.convert import convert_files
    from corpusprep.sources.folder import scan_folder

    with open(os.path.join(tmp_dir, "notes.log"), "w") as f:
        f.write("line one\nline two")
    reg = routing.register(routing.extension_registry(spark), ".log", "logfile")

    def logs(df):
        return df.withColumn("parser", F.lit("log_custom")).withColumn(
            "markdown", F.concat(F.lit("# Log\n\n"), F.regexp_replace("text", "(?m)^", "- "))
        ).withColumn("error", F.lit(None).cast("string"))

    files = scan_folder(spark, tmp_dir).withColumn("path", F.regexp_replace("path", "^file:", ""))
    docs, outs = convert_files(files, registry=reg, custom={"logfile": logs})
    d = docs.collect()[0]
    assert (d.parser, d.markdown) == ("log_custom", "# Log\n\n- line one\n- line two")
    assert outs.collect()[0].status == "ok"


def test_image_sizes_by_path(spark, tmp_dir):
    import base64

    from corpusprep.sources.folder import read_image_sizes

    png = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mP8z8BQDwAEhQGAhKmMIQAAAABJRU5ErkJggg==")
    with open(os.path.join(tmp_dir, "a.png"), "wb") as f:
        f.write(png)
    with open(os.path.join(tmp_dir, "bad.png"), "wb") as f:
        f.write(b"not an image")
    got = {os.path.basename(r.path): (r.width, r.height) for r in read_image_sizes(spark, tmp_dir).collect()}
    assert got["a.png"] == (1, 1) and got["bad.png"] == (-1, -1)
