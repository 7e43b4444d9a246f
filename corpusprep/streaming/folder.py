"""Files as they arrive: documents are converted once what they refer to has arrived, too.

Two file streams feed one keyed state (:mod:`corpusprep.streaming.waiting`): the names of all new files, and the text
of new Markdown files, for what they refer to. A document's answers may come in different micro-batches; those of
documents that still lack some are a small table in the checkpoint folder, one version a batch, so a batch that is run again
reads what it read before. Complete documents are read, converted and packed in ``foreachBatch``.

Beyond the listing by which Spark's file source finds new files (``clean_source`` keeps that short), nothing lists the
folder: media are read by the names that the state has found.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.config import DEFAULT, Settings
from corpusprep.functions.text import decode_text
from corpusprep.operators import links, package, report
from corpusprep.plans.convert import convert_files, media_entries, route_files, text_globs
from corpusprep.session import materialize, scratch
from corpusprep.sinks.zip_packages import write_packages
from corpusprep.streaming.waiting import ANSWERS, Waiting

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Documents and files they refer to that are read by name at a time.
CHUNK = 2000

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches without new files, for waits that are over; a query that takes what is there and stops would never end with them.
_IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str):
    """Settings of a query, which keeps those it starts with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _stream(spark: SparkSession, folder: str, max_files: int, clean_source: str, archive: str | None, glob: str | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("maxFilesPerTrigger", max_files).option("cleanSource", clean_source)
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).withColumn("path", F.regexp_replace("path", "^file:", ""))


def file_events(names: DataFrame, texts: DataFrame, in_dir: str, settings: Settings = DEFAULT, suffix: str = "") -> DataFrame:
    """Events of new files. names: ``path`` of all files; texts: ``path, content`` of the Markdown files of the folder itself.

    Every file is there for documents that refer to it; every supported file of the folder itself claims its package, and wants
    the local files it refers to.
    """
    folder = in_dir.removeprefix("file:").rstrip("/")
    nothing = F.lit(None).cast("string")
    have = names.select(links.normalize_path("path").alias("key"), F.lit("have").alias("kind"), nothing.alias("doc"), F.lit(None).cast("int").alias("n"),
                        nothing.alias("package"), nothing.alias("media"))
    todo = route_files(names.where(links.dirname("path") == folder).select("path"), settings, suffix).where(~F.col("_skip"))
    claim = lambda n: [F.col("package").alias("key"), F.lit("claim").alias("kind"), F.col("path").alias("doc"), n.cast("int").alias("n"), "package", nothing.alias("media")]
    others = todo.where(F.col("processor") != "markdown").select(*claim(F.lit(1)))
    md = route_files(texts, settings, suffix).where(~F.col("_skip") & (F.col("processor") == "markdown"))
    refs = F.array_union(
        F.regexp_extract_all("text", F.lit(links.MD_IMAGE), 2), F.regexp_extract_all("text", F.lit(links.HTML_IMAGE), 2)
    )
    local = F.filter(refs, lambda r: links.classify_ref(r) == "local")
    place = F.transform(local, lambda r: links.normalize_path(F.concat(links.dirname("path"), F.lit("/"), r)))
    md = md.withColumn("text", decode_text(F.col("content"))).withColumn("wanted", F.array_distinct(place)).select("path", "package", "wanted")
    n = F.size("wanted") + 1
    want = md.select("package", "path", n.cast("int").alias("n"), F.explode("wanted").alias("media")).select(
        F.col("media").alias("key"), F.lit("want").alias("kind"), F.col("path").alias("doc"), "n", "package", "media"
    )
    return have.unionByName(others).unionByName(md.select(*claim(n))).unionByName(want)


def _escaped(path: str) -> str:
    """A path that a reader takes as it is, not as a pattern."""
    return "".join("\\" + c if c in "\\[]{}*?" else c for c in path)


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of files by name; those that are gone by now are left out."""
    if not paths:
        return spark.createDataFrame([], BINARY_FILE_SCHEMA).select("path", "content")
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    return reader.load([_escaped(p) for p in paths]).select(F.regexp_replace("path", "^file:", "").alias("path"), "content")


class _Pending:
    """Answers of documents that lack some, a table for each batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self.fs = path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _epochs(self) -> list[int]:
        if not self.fs.exists(self.path(self.folder)):
            return []
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in self.fs.listStatus(self.path(self.folder)))

    def before(self, epoch: int) -> DataFrame:
        last = [e for e in self._epochs() if e < epoch]
        return self.spark.read.schema(ANSWERS).parquet(f"{self.folder}/epoch={last[-1]}") if last else self.spark.createDataFrame([], ANSWERS)

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def forget(self, epoch: int) -> None:
        """Tables that no batch reads again."""
        for old in [e for e in self._epochs() if e < epoch - 1][:-1]:
            self.fs.delete(self.path(f"{self.folder}/epoch={old}"), True)


def stream_folder(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, suffix: str = "",
                  settings: Settings = DEFAULT, available_now: bool = True, report_table: str | None = None,
                  max_files_per_trigger: int = 1000, wait_seconds: float | None = None, clean_source: str = "off", archive: str | None = None,
                  trigger: str = "30 seconds"):
    """Start the streaming conversion; returns the ``StreamingQuery``.

    ``checkpoint`` must be a shared, durable folder on a cluster. With ``available_now`` the query converts what is
    there and stops. A document waits ``wait_seconds`` for the local files it refers to (default: 5 minutes, and not at all
    with ``available_now``); one that still waits when a query stops is taken up by the next on the same checkpoint, when it has new files. Of
    files with one package name, the first to arrive keeps it (in one batch the greatest path, as in a batch conversion);
    the others are reported as skipped. ``clean_source``, ``archive``: what Spark's file source does with files it has handed over
    (only for folders whose files nothing refers to later).
    """
    wait_ms = int(1000 * (wait_seconds if wait_seconds is not None else 0 if available_now else 300))
    names = _stream(spark, in_dir, max_files_per_trigger, clean_source, archive, recursive=True).select("path")
    texts = _stream(spark, in_dir, max_files_per_trigger, clean_source, archive, glob=text_globs(spark, "markdown")).select("path", "content")
    events = file_events(names, texts, in_dir, settings, suffix)
    answers = events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Waiting(wait_ms), outputStructType=ANSWERS, outputMode="append", timeMode="processingTime"
    )
    pending = _Pending(spark, f"{checkpoint.rstrip('/')}/pending")

    def batch(new: DataFrame, epoch: int) -> None:
        with scratch(spark):
            known = materialize(pending.before(epoch).unionByName(new).distinct())
            whole = known.groupBy("doc").agg(F.count_distinct("media", "status").alias("_m"), F.max("n").alias("n"), F.count("*").alias("answers"))
            done = materialize(whole.where("answers >= n").select("doc", "n"))
            pending.write(known.join(done.select("doc"), "doc", "left_anti").select(*new.columns), epoch)
            mine = materialize(known.join(done.select("doc"), "doc", "left_semi"))
            outcomes = None
            for chunk in _chunks(done.orderBy("doc").toLocalIterator()):
                outs = _convert(spark, mine, chunk, out_dir, suffix, settings)
                outcomes = outs if outcomes is None else outcomes.unionByName(outs)
            if report_table and outcomes is not None:  # a batch that is run again writes its own folder again
                outcomes.write.mode("overwrite").parquet(f"{report_table.rstrip('/')}/epoch={epoch}")
        pending.forget(epoch)

    writer = answers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    with _settings(spark, **{_STATE_STORE: _ROCKS, _IDLE_BATCHES: str(not available_now).lower()}):
        return writer.start()


def _chunks(rows):
    """Runs of documents that have ``CHUNK`` answers or so."""
    size = 0
    chunk: list[str] = []
    for r in rows:
        chunk.append(r["doc"])
        size += r["n"]
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _convert(spark: SparkSession, answers: DataFrame, docs: list[str], out_dir: str, suffix: str, settings: Settings) -> DataFrame:
    """Packages of complete documents, from the files by name; their outcomes."""
    mine = answers.where(F.col("doc").isin(docs)).select("doc", "media", "status").collect()  # bounded by CHUNK, or one document's links
    owners = sorted({r["doc"] for r in mine if r["status"] == "owner"})
    losers = sorted(set(docs) - set(owners))
    found = sorted({r["media"] for r in mine if r["status"] == "found"})
    files = _read(spark, owners)
    listing = spark.createDataFrame([(p,) for p in found], "path string")
    converted, outs = convert_files(files, settings, suffix, media=listing)
    converted = materialize(converted)
    md = route_files(files, settings, suffix).where(~F.col("_skip") & (F.col("processor") == "markdown"))
    md = md.withColumn("text", decode_text(F.col("content"))).select("path", "package", "text")
    entries = package.package_entries(converted).unionByName(media_entries(md, converted, listing, media=_read(spark, found)))
    write_packages(entries, out_dir)
    skipped = route_files(spark.createDataFrame([(p,) for p in losers], "path string"), settings, suffix).withColumn("_skip", F.lit(True))
    nothing = converted.select("path", "part_no", "parser", "markdown", "error").limit(0)
    return materialize(outs.unionByName(report.outcomes(skipped, nothing)))
