"""Whole conversions: files -> documents -> packages, batch and table forms.

One lazy plan per document kind, joined by ``unionByName``. Binary formats
whose parsers are outside this library (PDF, slide decks, workbooks, office
documents) come out as failed rows with a clear message; their already
extracted forms go through :mod:`corpusprep.operators.slides`,
:mod:`corpusprep.operators.images` and :mod:`corpusprep.operators.tables`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.config import DEFAULT, Settings
from corpusprep.functions.html import html_title, html_to_markdown, with_front_matter, fix_media_paths, fix_table_captions
from corpusprep.functions.paths import basename, extension, is_temp_file
from corpusprep.functions.text import decode_detected, decode_text, detect_encoding, normalize_newlines
from corpusprep.operators import links, package, report, routing, tables
from corpusprep.operators.html import with_toc
from corpusprep.operators.text import CODE_EXTS, render_simple
from corpusprep.session import materialize
from corpusprep.sources.folder import read_lines, scan_folder, text_lines

NOT_BUILT = "no parser for this binary format in this build"


def route_files(files: DataFrame, settings: Settings = DEFAULT, suffix: str = "", registry: DataFrame | None = None) -> DataFrame:
    """Routing, skip flag and output names for a listing with ``path``."""
    routed = routing.route(files, registry, settings=settings)
    skip = ~F.col("supported")
    if settings.skip_temp_files:
        skip = skip | is_temp_file(F.col("path"))
    return routing.output_names(routed.withColumn("_skip", skip), suffix).withColumn("source_filename", basename("path"))


def _meta(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return package.metadata_json(df, extra)


def _table_docs(docs: DataFrame, facts: list[str], key: str) -> DataFrame:
    """Documents keyed by ``_tkey`` with their file's key and path again, and metadata of the parser."""
    back = docs.withColumn("path", F.get_json_object("_tkey", "$.path"))
    if key != "path":
        back = back.withColumn(key, F.get_json_object("_tkey", f"$.{key}").cast("bigint"))
    return _meta(back.withColumn("source_filename", basename("path")), [*facts, "error"])


# Fields of the metadata of delimited files and translation bundles.
TABLE_FACTS = ["file_type", "encoding", "separator", "parsing_strategy", "detection_score", "total_rows", "total_columns", "displayed_rows",
               "displayed_columns", "column_names", "had_parsing_issues"]
BUNDLE_FACTS = ["file_type", "encoding", "separator", "languages", "total_entries", "total_languages", "unique_bundles", "displayed_entries", "column_names"]


def _table_parts(plain: DataFrame, bundles: DataFrame, settings: Settings, plain_texts: DataFrame | None = None,
                 bundle_texts: DataFrame | None = None) -> list[tuple[DataFrame, list[str]]]:
    """Documents, and the fields of their metadata, of lines ``(_tkey, ord, line)``; with whole texts, records are found in those."""
    shown = {"name": F.get_json_object(F.col("_tkey"), "$.path"), "encoding": F.get_json_object(F.col("_tkey"), "$.encoding")}
    by_line = plain_texts is None
    docs = tables.csv_documents(plain, settings, path="_tkey", texts=plain_texts, is_tsv=extension(shown["name"]) == ".tsv", quoted_breaks=by_line, **shown)
    words = tables.bundle_documents(bundles, settings, path="_tkey", texts=bundle_texts, quoted_breaks=by_line, **shown)
    return [(docs, TABLE_FACTS), (words, BUNDLE_FACTS)]


def convert_texts(routed: DataFrame, media: DataFrame | None = None, settings: Settings = DEFAULT,
                  key: str = "path", custom: dict | None = None, kind_col: str = "processor", delimited: DataFrame | None = None) -> DataFrame:
    """Documents from routed files that carry decoded ``text``:
    ``(key, path, part_no, parser, markdown, error, metadata)``; one branch per
    kind. Tables come in parts from 0, everything else as part 0. ``key`` is what
    identifies a file. ``encoding``, where the files have it, is named in the
    documents of tables.

    ``custom`` maps a processor name (registered with
    :func:`corpusprep.operators.routing.register`) to a DataFrame function: it
    gets the files routed to that processor (``key, path, source_filename,
    text``) and returns them with ``parser``, ``markdown`` and ``error``.

    ``kind_col`` selects the branch of a row. When it is a literal per union
    input (as in :func:`convert_folder`), Catalyst prunes every other input
    from each branch, so each file is read by one branch only.

    ``delimited``: lines ``(path, ord, line, encoding)`` of delimited files
    (:func:`corpusprep.sources.folder.read_lines`), which are then not looked for in ``routed``.
    """
    DOC_COLS = list(dict.fromkeys([key, "path", "part_no", "parser", "markdown", "error", "metadata"]))
    first_part = F.lit(0).cast("bigint")
    custom = custom or {}
    todo = routed.where(~F.col("_skip"))
    proc = F.col(kind_col)
    ext = extension("path")
    out = []
    for name, fn in custom.items():
        mine = todo.where(proc == name).select(*list(dict.fromkeys([key, "path", "source_filename", "text"])))
        out.append(_meta(fn(mine)).withColumn("part_no", first_part).select(*DOC_COLS))
    todo = todo.where(~proc.isin(*custom)) if custom else todo

    simple = render_simple(todo.where(proc == "simple"))
    out.append(_meta(simple, ["language", "error"]).withColumn("part_no", first_part).select(*DOC_COLS))

    md = todo.where(proc == "markdown").withColumn("parser", F.lit("md_custom")).withColumn("markdown", F.col("text"))
    if media is not None:
        md_docs = md.withColumnRenamed("path", "doc_key").withColumn("path", F.col("doc_key"))
        refs = links.distinct_refs(links.image_refs(md_docs))
        res = links.resolve_local_refs(refs, md_docs, media)
        md = links.rewrite_links(md_docs, res).drop("path").withColumnRenamed("doc_key", "path")
    md = md.withColumn("error", F.lit(None).cast("string"))
    out.append(_meta(md).withColumn("part_no", first_part).select(*DOC_COLS))

    html = todo.where((proc == "converter") & ext.isin(".html", ".htm"))
    body = html_to_markdown(F.col("text"))
    html = html.withColumn("title", html_title(F.col("text"))).withColumn(
        "markdown", fix_table_captions(fix_media_paths(with_front_matter(body, F.col("title"))))
    )
    if settings.pandoc_toc:
        html = with_toc(html)
    html = html.withColumn("parser", F.lit("pandoc")).withColumn("error", F.lit(None).cast("string"))
    out.append(_meta(html, ["title"]).withColumn("part_no", first_part).select(*DOC_COLS))

    if delimited is None:
        encoding = F.col("encoding") if "encoding" in todo.columns else F.lit("utf-8")
        tab = todo.where((proc == "tabular") & ext.isin(".csv", ".tsv")).select(*dict.fromkeys([key, "path"]), "text", encoding.alias("encoding"))
        bundle = tables.is_bundle(F.substring_index("text", "\n", 1)) & (ext == ".csv")
        keyed = tab.withColumn("_bundle", bundle).withColumn("_tkey", F.to_json(F.struct(key, "path", "encoding")))
        plain, bundles = keyed.where(~F.col("_bundle")), keyed.where(F.col("_bundle"))
        found = _table_parts(text_lines(plain, path="_tkey"), text_lines(bundles, path="_tkey"), settings, plain, bundles)
    else:
        keyed = delimited.withColumn("_tkey", F.to_json(F.struct("path", "encoding")))
        first = keyed.groupBy("path", "_tkey").agg(F.min_by("line", "ord").alias("_first"))
        words = first.where(tables.is_bundle("_first") & (extension("path") == ".csv")).select("_tkey")
        found = _table_parts(keyed.join(words, "_tkey", "left_anti"), keyed.join(words, "_tkey", "left_semi"), settings)
    for docs, facts in found:
        out.append(_table_docs(docs, facts, key).select(*DOC_COLS))

    if kind_col == "processor":  # with a literal kind column the caller reports unread kinds itself
        rest = todo.where(
            ~proc.isin("simple", "markdown")
            & ~((proc == "converter") & ext.isin(".html", ".htm"))
            & ~((proc == "tabular") & ext.isin(".csv", ".tsv"))
        )
        rest = rest.select(
            *list(dict.fromkeys([key, "path"])), first_part.alias("part_no"), F.col("processor").alias("parser"), F.lit(None).cast("string").alias("markdown"),
            F.lit(NOT_BUILT).alias("error"), F.to_json(F.struct(F.col("source_filename"), F.col("processor").alias("parser"))).alias("metadata"),
        )
        out.append(rest)

    docs = out[0]
    for d in out[1:]:
        docs = docs.unionByName(d)
    return docs


def convert_files(files: DataFrame, settings: Settings = DEFAULT, suffix: str = "", media: DataFrame | None = None,
                  registry: DataFrame | None = None, custom: dict | None = None):
    """(docs, outcomes) for a ``binaryFile`` listing. ``content`` is decoded in the projection that
    routes, and no join or shuffle sees it. Of files that would have the same package, one keeps
    its document (:func:`resolve_collisions`)."""
    routed = resolve_collisions(route_files(files.select("path"), settings, suffix, registry))
    textual = _decoded(route_files(files.select("path", "content"), settings, suffix, registry))
    docs = materialize(convert_texts(textual, media, settings, custom=custom))  # read for the documents and their outcomes
    kept = routed.where(~F.col("_skip")).select("path", "package", "source_filename")
    return docs.join(kept, "path"), report.outcomes(routed, docs)


def file_statuses(routed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(path, parser, status, message)`` of routed files that carry ``text``, as :func:`report.outcomes` of their documents.

    No document is built for it, nor any row moved: a text or Markdown file comes out unless it is empty, code and JSON files always do
    (invalid JSON as text), a delimited file if it has a line that isn't blank, and only HTML pages are converted to see.
    """
    ext, proc, text = extension("path"), F.col("processor"), F.col("text")
    is_html = (proc == "converter") & ext.isin(".html", ".htm")
    is_table = (proc == "tabular") & ext.isin(".csv", ".tsv")
    page = F.when(is_html & ~F.col("_skip"), text)
    fenced = ext.isin(".json", *CODE_EXTS)
    produced = (
        F.when(proc == "simple", fenced | (F.length(text) > 0)).when(proc == "markdown", F.length(text) > 0)
        .when(is_html, html_title(page).isNotNull() | (F.length(html_to_markdown(page)) > 0)).when(is_table, text.rlike(r"[^\r\n]")).otherwise(False)
    )
    simple = F.when(ext == ".json", "json_simple").when(ext.isin(*CODE_EXTS), "code_simple").otherwise("txt_simple")
    bundle = tables.is_bundle(F.substring_index("text", "\n", 1))
    parser = (
        F.when(F.col("_skip"), proc).when(proc == "simple", simple).when(proc == "markdown", "md_custom").when(is_html, "pandoc")
        .when(is_table & (ext == ".tsv"), "pandas_tsv").when(is_table & bundle, "pandas_bundle_csv").when(is_table, "pandas_csv").otherwise(proc)
    )
    reason = F.when(is_table, tables.UNREADABLE).when(proc.isin("simple", "markdown") | is_html, report.FAILED).otherwise(NOT_BUILT)
    status, message = report.status_of(F.col("_skip"), F.coalesce(produced, F.lit(False)), reason)
    return routed.select(*keep, "path", parser.alias("parser"), status.alias("status"), message.alias("message"))


def _losers(routed: DataFrame) -> DataFrame:
    named = routed.where(~F.col("_skip")).select("path", "package")
    return routing.name_collisions(named).where(~F.col("survivor")).select("path").distinct()


def resolve_collisions(routed: DataFrame) -> DataFrame:
    """Files that lose their package's name to another (:func:`routing.name_collisions`) are skipped."""
    losers = _losers(routed).withColumn("_lost", F.lit(True))
    return routed.join(losers, "path", "left").withColumn("_skip", F.col("_skip") | F.coalesce("_lost", F.lit(False))).drop("_lost")


def _decoded(files: DataFrame) -> DataFrame:
    """``text`` and ``encoding`` of ``content``: tables by the encodings tried in turn, other files as UTF-8."""
    tabular = extension("path").isin(".csv", ".tsv")
    content = F.col("content")
    text = F.when(tabular, normalize_newlines(decode_detected(content))).otherwise(decode_text(content))
    return files.withColumn("text", text).withColumn("encoding", detect_encoding(content)).drop("content")


# Extensions of media looked for where no document refers to any.
MEDIA_EXTS = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp", ".tif", ".tiff", ".ico"]
#: Extensions that a glob of files to read names at most.
MOST_KINDS = 100
TEXT_KINDS = {"simple": None, "markdown": None, "converter": [".html", ".htm"], "tabular": [".csv", ".tsv"]}


def media_entries(md_files: DataFrame, docs: DataFrame, listing: DataFrame, folder: str | None = None, losers: DataFrame | None = None,
                  media: DataFrame | None = None) -> DataFrame:
    """Package entries ``(package, entry, kind, bytes)`` of the files below ``folder`` that Markdown files refer to.

    ``md_files``: ``path, package, text``, of the original text; ``docs``: what the files became (those without
    Markdown have no package); ``listing``: ``path`` of all files; ``losers``: ``path`` of files that have no package of
    their own; ``media``: ``path, content`` of the files referred to, where they are known. Otherwise bytes are read of the
    kinds of files referred to.
    """
    spark = md_files.sparkSession
    src = md_files.select(F.col("path").alias("doc_key"), "path", "package", F.col("text").alias("markdown"))
    found = links.resolve_local_refs(links.distinct_refs(links.image_refs(src)), src, listing).where("exists")
    if losers is not None:
        found = found.join(losers.select(F.col("path").alias("doc_key")), "doc_key", "left_anti")
    refs = materialize(found.join(src.select("doc_key", "package"), "doc_key").select("package", "media_name", "resolved", "syntax", "pos"))
    # of refs that come to one media name, the last counts; whatever its extension is, the file is read
    last = refs.groupBy("package", "media_name").agg(F.max_by("resolved", F.struct("syntax", "pos")).alias("resolved"))
    if media is None:
        media = _media_files(spark, refs, folder)
    rows = last.join(media.select(F.regexp_replace("path", "^file:", "").alias("resolved"), F.col("content").alias("bytes")), "resolved")
    ok = docs.where(F.col("markdown").isNotNull() & (F.length("markdown") > 0)).select("package").distinct()
    return rows.join(ok, "package", "left_semi").select(
        "package", F.concat(F.lit("media/"), F.col("media_name")).alias("entry"), F.lit("media").alias("kind"), "bytes"
    )


def _media_files(spark: SparkSession, refs: DataFrame, folder: str) -> DataFrame:
    """Files of the kinds that are referred to: of a few kinds by name, else all; the result is the same."""
    exts = [r[0] for r in refs.select(extension("resolved")).distinct().limit(MOST_KINDS + 1).collect()]
    return scan_folder(spark, folder, recursive=True, glob=None if "" in exts or len(exts) > MOST_KINDS else _glob(exts or MEDIA_EXTS))


def _glob(exts: list[str]) -> str:
    """Case-insensitive glob for file extensions: ``*.{[tT][xX][tT],...}``."""
    def ci(e: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))

    return "*.{" + ",".join(ci(e) for e in exts) + "}"


def text_globs(spark: SparkSession, kind: str) -> str:
    """Glob of the files of a kind."""
    return _glob([r.ext for r in routing.resolve_registry(routing.extension_registry(spark)).where(F.col("processor") == kind).collect()])


def _text_kinds(spark: SparkSession, registry: DataFrame | None, settings: Settings, custom: dict) -> dict[str, list[str]]:
    """Extensions read as text, per kind, from the (fixed-size) registry."""
    reg = routing.resolve_registry(registry if registry is not None else routing.extension_registry(spark)).collect()
    by_kind: dict[str, list[str]] = {}
    for r in reg:
        by_kind.setdefault(r.processor, []).append(r.ext)
    if settings.converter_formats:
        known = {r.ext for r in reg}
        by_kind.setdefault("converter", []).extend(e for e in routing.CONVERTER_FORMATS if e not in known)
    out = {}
    for kind, only in {**TEXT_KINDS, **{k: None for k in custom}}.items():
        exts = [e for e in by_kind.get(kind, []) if only is None or e in only]
        if exts:
            out[kind] = exts
    return out


def convert_folder(spark: SparkSession, in_dir: str, out_dir: str, suffix: str = "", settings: Settings = DEFAULT,
                   registry: DataFrame | None = None, custom: dict | None = None):
    """Convert every supported file of ``in_dir`` into ``<out_dir>/<package>.zip``.

    Returns the outcomes DataFrame (path, parser, status, message). Routing
    reads the listing only. File bytes are read per kind through a
    ``pathGlobFilter`` (each file once, only kinds handled as text); binary
    kinds fail from the listing without being read. Local images referenced by
    Markdown files are looked up in ``in_dir`` and below and packed under ``media/``.
    """
    from corpusprep.sinks.zip_packages import write_packages

    custom = custom or {}
    strip = F.regexp_replace("path", "^file:", "")
    listing = scan_folder(spark, in_dir).select(strip.alias("path"))
    found = materialize(route_files(listing, settings, suffix, registry))
    losers = materialize(_losers(found))
    routed = materialize(resolve_collisions(found))

    kinds = _text_kinds(spark, registry, settings, custom)
    parts = [
        scan_folder(spark, in_dir, glob=_glob(exts)).select(strip.alias("path"), "content", F.lit(kind).alias("_kind"))
        for kind, exts in kinds.items() if kind != "tabular"
    ]
    contents = parts[0]
    for p_ in parts[1:]:
        contents = contents.unionByName(p_)
    textual = _decoded(route_files(contents, settings, suffix, registry))
    delimited = None
    if "tabular" in kinds:  # of any size, line by line
        lines = read_lines(spark, in_dir, _glob(kinds["tabular"])).withColumn("path", strip)
        delimited = lines.where(~is_temp_file(F.col("path"))) if settings.skip_temp_files else lines
    # the listing holds no bytes; those of the files referred to are read below
    listing_below = scan_folder(spark, in_dir, recursive=True).select(strip.alias("path"))
    converted = convert_texts(textual, listing_below, settings, custom=custom, kind_col="_kind", delimited=delimited)
    docs = materialize(converted.join(losers, "path", "left_anti"))
    handled = F.lit(False)
    for kind, exts in kinds.items():
        handled = handled | ((F.col("processor") == kind) & extension("path").isin(*exts))
    unread = routed.where(~F.col("_skip") & ~handled).select(
        "path", F.lit(0).cast("bigint").alias("part_no"), F.col("processor").alias("parser"), F.lit(None).cast("string").alias("markdown"),
        F.lit(NOT_BUILT).alias("error"),
        F.to_json(F.struct(F.col("source_filename"), F.col("processor").alias("parser"))).alias("metadata"),
    )
    docs = docs.unionByName(unread)
    if delimited is not None:  # files without a line
        blank = routed.where(~F.col("_skip") & (F.col("processor") == "tabular") & extension("path").isin(*kinds["tabular"]))
        blank = blank.join(docs.select("path").distinct(), "path", "left_anti")
        kind = F.when(extension("path") == ".tsv", "pandas_tsv").otherwise("pandas_csv")
        docs = docs.unionByName(_meta(tables.unreadable_documents(blank, docs.limit(0), parser=kind).withColumn("source_filename", basename("path")), ["error"]).select(*docs.columns))
    docs = docs.join(routed.select("path", "package"), "path")
    outs = report.outcomes(routed, docs)
    entries = package.package_entries(docs)

    md_src = textual.where(~F.col("_skip") & (F.col("_kind") == "markdown"))
    media = media_entries(md_src, docs, listing_below, in_dir, losers)
    write_packages(entries.unionByName(media), out_dir)
    return outs


def convert_tables(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> DataFrame:
    """Table form of the batch: ``documents`` as files plus ``pages`` as HTML files."""
    from corpusprep.plans.standins import doc_files
    from corpusprep.sources.tables import table

    files = doc_files(spark, sf_dir).select("doc_id", "path", "text")
    # pages are keyed below zero, apart from documents
    pages = table(spark, sf_dir, "pages").select(
        (-1 - F.col("page_id")).cast("bigint").alias("doc_id"),
        F.concat(F.lit("/corpus/in/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text")
    )
    routed = route_files(files.unionByName(pages), settings)
    return convert_texts(routed, None, settings, key="doc_id")
