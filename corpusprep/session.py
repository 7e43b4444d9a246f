"""Session helpers: a local session for tests and benches, checkpoint folder lookup."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusprep") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSPREP_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster has to name one, as its executors share no local folder. Only a
    local session without one (tests, trial runs) gets a folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    app = spark.sparkContext.applicationId
    if app not in _own_folders:  # a core setting, which a running session can't be given
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_folders[app] = tempfile.mkdtemp(prefix="corpusprep-ckpt-")
    return _own_folders[app]


#: Folders of local sessions, by application.
_own_folders: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session, where they can't import it otherwise.

    A cluster has it installed or gets it by ``--py-files``; a driver that found it by ``sys.path`` alone calls this.
    """
    sc, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = {os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if root in found or sc.applicationId in _shipped:
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="corpusprep-"), "corpusprep"), "zip", root, "corpusprep")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared checkpoint folder and read it back.

    options: those of the Parquet writer.

    Used where an expensive intermediate feeds several branches that would
    otherwise each recompute it, and to cut lineage: the table is on shared
    storage, so losing an executor afterwards costs nothing. The shuffle files
    of the job that wrote it are removed when it ends. ``release`` removes a
    table that is used up, ``drop_tables`` all that are left.
    """
    spark = df.sparkSession
    folder = f"{_tables(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(folder)
    table._materialized = folder
    for scope in _scopes:
        scope.made.append(table)
    return table


class Scratch:
    """Tables materialized within a ``scratch`` block."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table)
        return table


_scopes: list[Scratch] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Release, at the end of the block, the tables that were materialized in it, but for those kept.

    What is kept must be written, not a plan that still reads the others.
    """
    scope = Scratch()
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        kept = {t._materialized for t in scope.kept}
        release(*(t for t in scope.made if t._materialized not in kept))


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: what was made of them is written, too."""
    for table in tables:
        _delete(table.sparkSession, table._materialized)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _tables(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete this application's materialized tables, once nothing reads them any more."""
    _delete(spark, _tables(spark))
