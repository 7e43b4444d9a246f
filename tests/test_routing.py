from pyspark.sql import functions as F

from corpusprep.config import Settings
from corpusprep.functions.paths import basename, extension, is_temp_file, package_name
from corpusprep.operators import routing


def _files(spark, names):
    return spark.createDataFrame([(f"/in/{n}",) for n in names], "path string")


def test_temp_names(spark):
    names = ["~$file.docx", ".~lock", "note.tmp", "backup.bak", "Thumbs.db", "desktop.ini", ".DS_Store", "regular.txt"]
    got = {r.n: r.t for r in _files(spark, names).select(basename("path").alias("n"), is_temp_file(F.col("path")).alias("t")).collect()}
    assert got == {n: n != "regular.txt" for n in names}


def test_extension_rules(spark):
    rows = _files(spark, ["FILE.XYZ", "a.tar.gz", ".bashrc", "noext", "x."]).select(extension("path").alias("e")).collect()
    assert [r.e for r in rows] == [".xyz", ".gz", "", "", "."]


def test_routing_table(spark):
    names = ["document.pdf", "document.docx", "document.txt", "archive.zip", "deck.PPT", "data.opml", "sheet.csv"]
    got = {r.path.split("/")[-1]: (r.processor, r.supported) for r in routing.route(_files(spark, names)).collect()}
    assert got["document.pdf"] == ("pdf", True)
    assert got["document.docx"] == ("converter", True)
    assert got["document.txt"] == ("simple", True)
    assert got["archive.zip"] == ("simple", False)
    assert got["deck.PPT"] == ("slides", True)
    assert got["data.opml"] == ("converter", True)
    assert got["sheet.csv"] == ("tabular", True)
    off = routing.route(_files(spark, ["data.opml"]), settings=Settings(converter_formats=False)).collect()[0]
    assert (off.processor, off.supported) == ("simple", False)


def test_registration_last_wins(spark):
    reg = routing.register(routing.extension_registry(spark), ".abc", "markdown")
    reg = routing.register(reg, ".ABC", "simple")
    got = routing.route(_files(spark, ["file.abc", "~$temp.abc"]), reg).collect()
    assert {r.processor for r in got} == {"simple"}
    kept = routing.can_process(_files(spark, ["file.abc", "~$temp.abc", "file.unsupported"]), reg).collect()
    assert [r.path for r in kept] == ["/in/file.abc"]


def test_discovery_split(spark):
    sup, skipped = routing.split_supported(_files(spark, ["a.txt", "b.docx", "c.bin"]))
    assert sorted(r.path for r in sup.collect()) == ["/in/a.txt", "/in/b.docx"]
    assert [r.reason for r in skipped.collect()] == ["unsupported extension: .bin"]


def test_output_names_and_collisions(spark):
    named = routing.output_names(_files(spark, ["a.csv", "a.txt", "b.md"]), suffix="_rag")
    got = sorted((r.package, r.zip_name) for r in named.collect())
    assert got == [("a__rag", "a__rag.zip"), ("a__rag", "a__rag.zip"), ("b__rag", "b__rag.zip")]
    col = routing.name_collisions(routing.output_names(_files(spark, ["a.csv", "a.txt", "b.md"])))
    rows = sorted((r.path, r.sources, r.survivor) for r in col.collect())
    assert rows == [("/in/a.csv", 2, False), ("/in/a.txt", 2, True)]


def test_package_name_without_suffix(spark):
    r = _files(spark, ["report.final.pdf"]).select(package_name(F.col("path")).alias("p")).collect()[0]
    assert r.p == "report.final"


def test_registry_is_broadcast(spark):
    plan = routing.route(_files(spark, ["a.txt"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
