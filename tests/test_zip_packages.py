import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusprep.sinks import zip_packages as z

SCHEMA = z.ENTRY_SCHEMA


def _entries(spark, sizes):
    rows = [(n, e, k, b"x" * (size if k == "media" else 2)) for n, size in sizes.items() for e, k in ((f"{n}.md", "markdown"), ("metadata.json", "metadata"), ("media/a.png", "media"))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _names(folder):
    return sorted(os.listdir(folder))


@pytest.mark.parametrize("address", ["{}", "file://{}", "file:{}"])
def test_packages_by_path_and_address(spark, tmp_dir, address):
    out = os.path.join(tmp_dir, "out dir")
    entries = _entries(spark, {"a": 5, "b é": 7})
    where = address.format(out.replace(" ", "%20") if "//" in address else out)
    if address == "file:{}":
        where = address.format(out.replace(" ", "%20"))
    assert z.write_packages(entries, where) == 2
    assert _names(out) == ["a.zip", "b é.zip"]
    with zipfile.ZipFile(f"{out}/b é.zip") as f:
        assert f.namelist() == ["b é.md", "metadata.json", "media/a.png"] and f.read("media/a.png") == b"x" * 7
    assert z.write_packages(_entries(spark, {"a": 9}), where) == 1  # over the older one
    with zipfile.ZipFile(f"{out}/a.zip") as f:
        assert len(f.read("media/a.png")) == 9


def test_a_job_that_fails_in_its_last_task_publishes_nothing(spark, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    assert z.write_packages(_entries(spark, {"a": 1, "b": 2}), out) == 2
    before = {n: open(f"{out}/{n}", "rb").read() for n in _names(out)}
    rows = _entries(spark, {f"p{i}": i for i in range(20)} | {"a": 50})
    bad = F.udf(lambda b: None if False else (_ for _ in ()).throw(ValueError("no bytes")), "binary")
    failing = rows.withColumn("bytes", F.when((F.col("package") == "p19") & (F.col("kind") == "media"), bad("bytes")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="no bytes"):
        z.write_packages(failing, out, sizes=z.package_sizes(rows))
    assert {n: open(f"{out}/{n}", "rb").read() for n in _names(out)} == before


def test_a_committed_job_can_be_finished_later(spark, tmp_dir, monkeypatch):
    out = os.path.join(tmp_dir, "out")
    with monkeypatch.context() as m:
        m.setattr(z, "finish", lambda *a: 0)  # the driver stops between the phases
        z.write_packages(_entries(spark, {"a": 1, "b": 2}), out)
    assert _names(out) == ["_temporary"]
    (job,) = z.unfinished(out)
    manifests = [x for x in os.listdir(f"{out}/_temporary/{job}") if x.endswith(".json")]
    moved = f"{out}/_temporary/{job}/{manifests[0].removesuffix('.json')}"
    name = os.listdir(moved)[0]
    os.rename(f"{moved}/{name}", f"{out}/{name}")  # one was published before the executor was lost
    assert z.finish(spark, out, job) == 2 and _names(out) == ["a.zip", "b.zip"] and z.unfinished(out) == []


def test_an_uncommitted_job_is_cleared_away(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/_temporary/j/0-0-0")
    open(f"{tmp_dir}/_temporary/j/0-0-0/x.zip", "w").close()
    assert z.finish(spark, tmp_dir, "j") == 0 and _names(tmp_dir) == []


def test_large_packages_have_their_own_task(spark):
    sizes = {"huge": 400_000, "big": 120_000} | {f"s{i}": 500 + i for i in range(300)}
    entries = _entries(spark, sizes)
    dealt = z.dealt_by_size(entries, z.package_sizes(entries), task_bytes=100_000)
    by_task = dealt.groupBy(F.spark_partition_id().alias("t")).agg(F.sum(F.length("bytes")).alias("n"), F.collect_set("package").alias("p")).collect()
    alone = [r for r in by_task if set(r.p) & {"huge", "big"}]
    assert sorted(len(r.p) for r in alone) == [1, 1]
    rest = [r.n for r in by_task if r not in alone]
    assert max(rest) <= 100_000 and sum(len(r.p) for r in by_task) == len(sizes)


def test_no_entries(spark, tmp_dir):
    assert z.write_packages(spark.createDataFrame([], SCHEMA), f"{tmp_dir}/out") == 0 and _names(f"{tmp_dir}/out") == []
