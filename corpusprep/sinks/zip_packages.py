"""Sink: one ZIP per package, written on the executors and published in two phases.

A Python data source (``mdzip``) writes ZIPs through ``pyarrow.fs``, so the folder may be a local or mounted path or the
address of an object store (``file://``, ``s3://``, ``gs://``, ``hdfs://`` ...).

1. Tasks write their packages below ``<out>/_temporary/<job>/<attempt>/`` with a manifest that names them. The driver's commit,
   when every task has succeeded, records which attempts count. If a task fails for good, or the driver stops before, nothing
   has been published and the folder is as it was.
2. A job of one task for each manifest moves the packages into place, over older ones. Moving a package twice
   is harmless, so a lost executor only repeats it, and ``finish`` completes what a stopped driver has left.

Nothing about packages comes to the driver but a manifest's path for each task.

Tasks are balanced by bytes: a package of ``task_bytes`` or more has a task of its own, the others are dealt by hash.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusprep.session import materialize

ENTRY_SCHEMA = "package string, entry string, kind string, bytes binary"
TASK_BYTES = 256 << 20
#: Packages with a task of their own that may be broadcast; beyond that, a shuffled join.
BROADCAST_PACKAGES = 100_000
COMMITTED = "_committed"


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _remove(fs: pafs.FileSystem, folder: str) -> None:
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)


def _temporary(out_dir: str, job: str) -> str:
    return f"{out_dir.rstrip('/')}/_temporary/{job}"


@dataclass
class TaskDone(WriterCommitMessage):
    manifest: str | None = None


class ZipPackageWriter(DataSourceWriter):
    def __init__(self, options):
        self.out, self.job = options.get("path"), options.get("job")

    def write(self, iterator):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        tag = f"{ctx.partitionId()}-{ctx.attemptNumber()}-{ctx.taskAttemptId()}" if ctx else "local"
        fs, out = _located(self.out)
        folder = f"{_temporary(out, self.job)}/{tag}"
        names, current, stream, zf = [], None, None, None
        try:
            for row in iterator:
                if row.package != current:
                    if zf is not None:
                        zf.close()
                        stream.close()
                    elif not names:
                        fs.create_dir(folder, recursive=True)
                    current = row.package
                    path = f"{folder}/{current}.zip"
                    if "/" in current:
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(path)
                    zf = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    names.append(current)
                data = bytes(row.bytes) if row.bytes is not None else b""
                if row.kind == "metadata":
                    try:
                        data = json.dumps(json.loads(data.decode("utf-8")), indent=4).encode("utf-8")
                    except ValueError:
                        pass
                zf.writestr(row.entry, data)
            if zf is None:
                return TaskDone()
            zf.close()
            stream.close()
        except Exception:
            _remove(fs, folder)
            raise
        manifest = f"{folder}.json"
        with fs.open_output_stream(manifest) as f:
            f.write("".join(json.dumps(n) + "\n" for n in names).encode("utf-8"))
        return TaskDone(manifest)

    def commit(self, messages):
        fs, out = _located(self.out)
        manifests = [m.manifest for m in messages if m is not None and m.manifest]
        folder = _temporary(out, self.job)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{COMMITTED}") as f:
            f.write("\n".join(manifests).encode("utf-8"))

    def abort(self, messages):
        fs, out = _located(self.out)
        _remove(fs, _temporary(out, self.job))


class ZipPackageSource(DataSource):
    @classmethod
    def name(cls):
        return "mdzip"

    def schema(self):
        return ENTRY_SCHEMA

    def writer(self, schema, overwrite):
        return ZipPackageWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipPackageSource)


def package_sizes(entries: DataFrame) -> DataFrame:
    """``(package, size)`` in bytes."""
    return entries.groupBy("package").agg(F.sum(F.length("bytes")).alias("size"))


def dealt_by_size(entries: DataFrame, sizes: DataFrame, task_bytes: int = TASK_BYTES, partitions: int | None = None) -> DataFrame:
    """``entries`` dealt to tasks, all of a package in one, in the order in which they are packed.

    A package of ``task_bytes`` or more has its own task; the others are dealt by hash to as many as their bytes fill.
    """
    sizes = materialize(sizes)
    small = F.col("size") < task_bytes
    total = sizes.agg(F.sum(F.when(small, F.col("size"))).alias("bytes"), F.count_if(small).alias("n"), F.count_if(~small).alias("large")).first()
    spread = partitions or max(1, min(total["n"], -(-2 * (total["bytes"] or 0) // task_bytes), 10_000))
    spread = max(spread, min(total["n"], entries.sparkSession.sparkContext.defaultParallelism))
    numbers = sizes.where(~small).select(F.col("package").alias("_own"), F.monotonically_increasing_id().alias("_key"))
    # positions of the large ones, from the partitions' counts
    numbers = materialize(numbers.withColumn("_part", F.shiftright("_key", 33)).withColumn("_place", F.col("_key").bitwiseAND(F.lit((1 << 33) - 1))))
    before, first = 0, F.lit(0)
    for r in numbers.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        first = F.when(F.col("_part") == r["_part"], before).otherwise(first)
        before += r["count"]
    numbers = numbers.select("_own", (F.col("_place") + first + spread).alias("_task"))
    if total["large"] <= BROADCAST_PACKAGES:
        numbers = F.broadcast(numbers)
    task = F.coalesce(F.col("_task"), F.pmod(F.xxhash64("package"), F.lit(spread))).cast("int")
    kind = F.when(F.col("kind") == "markdown", 0).when(F.col("kind") == "metadata", 1).otherwise(2)
    joined = entries.select("package", "entry", "kind", "bytes").join(numbers, F.col("package") == F.col("_own"), "left")
    dealt = joined.withColumn("_task", task).repartitionById(int(spread + total["large"]), F.col("_task"))
    return dealt.sortWithinPartitions("package", kind, "entry").select("package", "entry", "kind", "bytes")


def _published(out_dir: str):
    """Moves the packages of manifests into place."""
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, out = _located(out_dir)
        for batch in batches:
            for manifest in batch.column(0).to_pylist():
                with fs.open_input_stream(manifest) as f:
                    names = [json.loads(x) for x in f.read().decode("utf-8").splitlines()]
                for name in names:
                    source, target = f"{manifest.removesuffix('.json')}/{name}.zip", f"{out}/{name}.zip"
                    if fs.get_file_info(source).type == pafs.FileType.NotFound:
                        continue  # an attempt before this one has moved it
                    if "/" in name:
                        fs.create_dir(target.rpartition("/")[0], recursive=True)
                    fs.move(source, target)
                yield pa.record_batch([pa.array([manifest]), pa.array([len(names)], pa.int64())], names=["manifest", "packages"])

    return move


def finish(spark: SparkSession, out_dir: str, job: str) -> int:
    """Publish a job's packages if it was committed, and remove its temporary folder; the number of packages published."""
    fs, out = _located(out_dir)
    folder = _temporary(out, job)
    published = 0
    if fs.get_file_info(f"{folder}/{COMMITTED}").type != pafs.FileType.NotFound:
        with fs.open_input_stream(f"{folder}/{COMMITTED}") as f:
            manifests = f.read().decode("utf-8").splitlines()
        if manifests:  # a row for each task of the job
            rows = spark.createDataFrame([(m,) for m in manifests], "manifest string").repartition(min(len(manifests), 1000))
            done = rows.mapInArrow(_published(out_dir), "manifest string, packages bigint")
            published = done.agg(F.sum("packages")).first()[0] or 0
    _remove(fs, folder)
    above = folder.rpartition("/")[0]
    if fs.get_file_info(above).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(above)):
        fs.delete_dir(above)  # stays while another job writes
    return published


def unfinished(out_dir: str) -> list[str]:
    """Jobs whose temporary folders are there: ``finish`` publishes those that were committed and clears the others away."""
    fs, out = _located(out_dir)
    found = fs.get_file_info(pafs.FileSelector(f"{out}/_temporary", allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == pafs.FileType.Directory)


def write_packages(entries: DataFrame, out_dir: str, partitions: int | None = None, sizes: DataFrame | None = None,
                   task_bytes: int = TASK_BYTES) -> int:
    """Write ``(package, entry, kind, bytes)`` rows as ``<out_dir>/<package>.zip``; the number of packages.

    sizes: ``(package, size)`` where they are known without reading the entries; computed from them otherwise.
    """
    spark = entries.sparkSession
    register(spark)
    fs, out = _located(out_dir)
    fs.create_dir(out, recursive=True)
    job = uuid.uuid4().hex
    laid = dealt_by_size(entries, sizes if sizes is not None else package_sizes(entries), task_bytes, partitions)
    laid.write.format("mdzip").mode("append").option("job", job).save(out_dir)
    return finish(spark, out_dir, job)
