import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from corpusprep.session import checkpoint_dir, drop_tables, materialize
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
assert checkpoint_dir(spark) == checkpoint_dir(spark)
assert materialize(spark.range(3)).count() == 3
drop_tables(spark)
print("folder", checkpoint_dir(spark))
"""


def test_local_session_without_a_folder_gets_its_own(tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path)}  # without the machine's defaults
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert f"folder {tmp_path}/corpusprep-ckpt-" in run.stdout


def test_scratch_releases_what_it_does_not_keep(spark):
    from corpusprep.session import materialize, scratch

    before = materialize(spark.range(2))
    with scratch(spark) as tables:
        inner = materialize(spark.range(3))
        out = tables.keep(materialize(inner.selectExpr("id + 1 AS id")))
    there = lambda t: os.path.isdir(t._materialized.removeprefix("file:"))
    assert there(before) and there(out) and not there(inner)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]
