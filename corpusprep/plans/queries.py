"""Registered queries: each reads whole benchmark tables and runs operators on them.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the SQL oracle in :mod:`corpusprep.plans.oracles`.
Integers are returned as BIGINT so both sides agree on types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions.common import col_of
from corpusprep.functions.html import (
    fix_media_paths,
    fix_pdf_quotes,
    fix_table_captions,
    front_matter_title,
    html_links,
    table_of_contents,
)
from corpusprep.functions.paths import basename, is_temp_file
from corpusprep.functions.text import clean_cell, clean_column_name, decode_detected, decode_text, detect_encoding, json_valid
from corpusprep.operators import html as html_ops
from corpusprep.operators import links
from corpusprep.config import Settings
from corpusprep.functions.images import image_format, sniff_image_type
from corpusprep.operators import images as images_ops
from corpusprep.operators import package as package_ops
from corpusprep.operators import report as report_ops
from corpusprep.operators import routing
from corpusprep.operators import slides as slides_ops
from corpusprep.operators import tables
from corpusprep.operators import text as text_ops
from corpusprep.operators.records import record_lines
from corpusprep.plans import convert
from corpusprep.plans.standins import (
    package_docs,
    package_media,
    bundle_lines,
    csv_lines,
    quoted_csv_lines,
    doc_files,
    img_pages,
    md_docs,
    media_listing,
    part_images,
    pdf_docs,
    slides,
)
from corpusprep.session import materialize
from corpusprep.sources.tables import table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _long(c):
    return col_of(c).cast("bigint")


# ---------------------------------------------------------------- HTML


@query
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every page converted to Markdown with its title."""
    docs = html_ops.html_documents(table(spark, sf_dir, "pages"))
    return docs.select("page_id", "title", "markdown")


@query
def html_link_list(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(html_links(F.col("html"))).alias("pos", "href")).select(
        "page_id", _long("pos").alias("pos"), "href"
    )


@query
def html_toc(spark, sf_dir):
    docs = html_ops.html_documents(table(spark, sf_dir, "pages"))
    return docs.select("page_id", table_of_contents(F.col("markdown")).alias("toc"))


@query
def html_external_images(spark, sf_dir):
    refs = html_ops.external_images(img_pages(spark, sf_dir))
    return refs.select("page_id", _long("pos").alias("pos"), "url", html_ops.external_image_name("url").alias("local_name"))


@query
def html_fetch_plan(spark, sf_dir):
    pages = img_pages(spark, sf_dir)
    refs = html_ops.external_images(pages)
    # media already present: the images named after the first seven banner URLs
    existing = spark.range(0, 7).select(
        html_ops.external_image_name(
            F.concat(F.lit("https://cdn.example.org/"), F.col("id").cast("string"), F.lit("/banner"))
        ).alias("name")
    ).where(F.col("id") % 2 == 0)
    return html_ops.fetch_plan(refs, existing).select("url", "local_name", "local_path")


@query
def html_localized(spark, sf_dir):
    pages = img_pages(spark, sf_dir)
    plan = html_ops.fetch_plan(html_ops.external_images(pages))
    out = html_ops.localize_images(pages, plan)
    return out.select("page_id", "html")


@query
def html_image_report(spark, sf_dir):
    rep = html_ops.external_image_report(img_pages(spark, sf_dir))
    return rep.select("page_id", _long("total_images").alias("total_images"), _long("unique_images").alias("unique_images"), "notice")


@query
def converter_fixes(spark, sf_dir):
    """Caption, media-path, front-matter title and PDF quote fixes on documents."""
    d = table(spark, sf_dir, "documents")
    md = F.concat(
        F.lit("---\ntitle: "), F.col("source"), F.lit(" \n---\n"), F.col("text"),
        F.lit("\n\n: []{#tbl-"), F.col("doc_id").cast("string"), F.lit("}Tabela "), F.col("lang"),
        F.lit("\n![x](media/media/img"), F.col("doc_id").cast("string"), F.lit('.png) " **;**'),
    )
    fixed = fix_pdf_quotes(fix_media_paths(fix_table_captions(md)))
    return d.select("doc_id", front_matter_title(md).alias("title"), fixed.alias("markdown"))


# ---------------------------------------------------------------- routing


@query
def file_routing(spark, sf_dir):
    routed = routing.route(doc_files(spark, sf_dir))
    return routed.select("doc_id", "path", "ext", "processor", "supported")


@query
def temp_file_flags(spark, sf_dir):
    f = doc_files(spark, sf_dir)
    return f.select("doc_id", basename("path").alias("name"), is_temp_file(F.col("path")).alias("is_temp"))


@query
def processable_files(spark, sf_dir):
    return routing.can_process(doc_files(spark, sf_dir)).select("doc_id", "path")


@query
def supported_files(spark, sf_dir):
    sup, _ = routing.split_supported(doc_files(spark, sf_dir))
    return sup.select("doc_id", "path", "processor")


@query
def skipped_files(spark, sf_dir):
    _, skipped = routing.split_supported(doc_files(spark, sf_dir))
    return skipped.select("doc_id", "path", "reason")


@query
def package_names(spark, sf_dir):
    named = routing.output_names(doc_files(spark, sf_dir), suffix="rag")
    return named.select("doc_id", "package", "md_name", "zip_name")


@query
def package_collisions(spark, sf_dir):
    sup, _ = routing.split_supported(doc_files(spark, sf_dir))
    named = routing.output_names(sup)
    return routing.name_collisions(named).select("package", "path", _long("sources").alias("sources"), "survivor")


# ---------------------------------------------------------------- text columns


@query
def decoded_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.encode(F.concat(F.regexp_replace("text", "\n", "\r\n"), F.lit("\rend")), "UTF-8")
    return d.select("doc_id", decode_text(raw).alias("text"))


@query
def detected_encoding(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", detect_encoding(raw).alias("encoding"), decode_detected(raw).alias("text"))


@query
def cleaned_cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        clean_cell(F.col("text")).alias("cell"),
        clean_column_name(F.col("text")).alias("column_name"),
        clean_column_name(F.col("source")).alias("source_name"),
    )


@query
def text_documents(spark, sf_dir):
    docs = text_ops.render_simple(doc_files(spark, sf_dir))
    return docs.select("doc_id", "parser", "language", "markdown")


@query
def json_documents(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    props = F.when(F.col("event_id") % 7 == 0, F.concat(F.col("props"), F.lit(","))).otherwise(F.col("props"))
    files = e.select("event_id", F.concat(F.lit("/corpus/in/event_"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), props.alias("text"))
    docs = text_ops.render_simple(files)
    return docs.select("event_id", json_valid(F.col("text")).alias("valid"), "markdown", "error")


# ---------------------------------------------------------------- Markdown links


def _resolved(spark, sf_dir):
    docs = md_docs(spark, sf_dir)
    refs = links.distinct_refs(links.image_refs(docs))
    return docs, links.resolve_local_refs(refs, docs, media_listing(spark, sf_dir))


@query
def md_image_refs(spark, sf_dir):
    refs = links.image_refs(md_docs(spark, sf_dir))
    return refs.select("doc_key", _long("syntax").alias("syntax"), _long("pos").alias("pos"), "ref")


@query
def md_distinct_refs(spark, sf_dir):
    refs = links.distinct_refs(links.image_refs(md_docs(spark, sf_dir)))
    return refs.select("doc_key", "ref", _long("syntax").alias("syntax"), _long("pos").alias("pos"),
                       links.classify_ref("ref").alias("kind"))


@query
def md_resolved_refs(spark, sf_dir):
    _, res = _resolved(spark, sf_dir)
    return res.select("doc_key", "ref", "resolved", "exists", "media_name", "new_ref")


@query
def md_missing_refs(spark, sf_dir):
    _, res = _resolved(spark, sf_dir)
    return links.missing_refs(res).select("doc_key", "ref", "resolved")


@query
def md_name_clashes(spark, sf_dir):
    _, res = _resolved(spark, sf_dir)
    return links.media_name_clashes(res).select("doc_key", "media_name", _long("refs").alias("refs"))


@query
def md_rewritten(spark, sf_dir):
    docs, res = _resolved(spark, sf_dir)
    return links.rewrite_links(docs, res).select("doc_key", "markdown")


# ---------------------------------------------------------------- tables


def _csv(spark, sf_dir):
    lines = csv_lines(spark, sf_dir)
    scores = materialize(tables.score_csv_dialects(lines))
    dialects = materialize(tables.pick_csv_dialect(scores))
    rows, headers = tables.parse_csv_lines(lines, dialects)
    return lines, scores, dialects, materialize(rows), headers


@query
def csv_dialect_scores(spark, sf_dir):
    scores = tables.score_csv_dialects(csv_lines(spark, sf_dir))
    return scores.select("path", "separator", _long("score").alias("score"))


@query
def csv_dialects(spark, sf_dir):
    dialects = tables.pick_csv_dialect(tables.score_csv_dialects(csv_lines(spark, sf_dir)))
    return dialects.select("path", "separator", _long("score").alias("score"))


@query
def csv_profiles(spark, sf_dir):
    _, _, dialects, rows, headers = _csv(spark, sf_dir)
    prof = tables.table_profile(rows, headers, dialects)
    return prof.select("path", "total_rows", "total_columns", "displayed_rows", "displayed_columns",
                       "separator", _long("score").alias("score"), "strategy", "had_parsing_issues",
                       F.array_join("column_names", "|").alias("column_names"))


@query
def csv_documents(spark, sf_dir):
    docs = tables.csv_documents(csv_lines(spark, sf_dir))
    return docs.select("path", "part_no", "parser", "markdown", "error")


@query
def csv_quoted_records(spark, sf_dir):
    """Records with quoted line breaks, found from their lines: as many files as sources, texts as quoted fields."""
    lines = quoted_csv_lines(spark, sf_dir)
    dialects = materialize(lines.select("path").distinct().withColumn("separator", F.lit(",")).withColumn("score", F.lit(0)))
    rows, _ = tables.parse_csv_lines(record_lines(lines, dialects, tables.SEPARATORS), dialects)
    cell = lambda i: F.try_element_at(F.col("fields"), F.lit(i))
    return rows.select("path", cell(1).alias("doc_id"), F.sha2(cell(2), 256).alias("text_sha256"), cell(3).alias("lang"), _long("n_fields").alias("n_fields"), "bad")


@query
def table_row_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    cells = F.array(*[F.col(c).cast("string") for c in n.columns])
    return n.select(_long("n_nationkey").alias("n_nationkey"), tables.markdown_line(cells).alias("line"))


@query
def orders_first_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return tables.truncate_rows(o, 1000, ["o_orderkey"], ["o_orderstatus"]).select("o_orderstatus", "o_orderkey")


@query
def orders_status_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority")
    return tables.frame_markdown_table(o, ["o_orderkey"], group_cols=["o_orderstatus"]).select("o_orderstatus", "part_no", "table")


@query
def lineitem_first_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    first = li.columns[:5]  # the column cap (op 25) on a known schema is a projection
    line = tables.markdown_line_of([F.col(c).cast("string") for c in first])
    return li.select("l_orderkey", _long("l_linenumber").alias("l_linenumber"), line.alias("line"))


@query
def customer_sanitized(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return tables.sanitize_table(c).select("c_custkey", "c_name", _long("c_nationkey").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


def _bundle(spark, sf_dir):
    lines = bundle_lines(spark, sf_dir)
    first = lines.groupBy("path").agg(F.min_by("line", "ord").alias("first_line"))
    dialects = first.where(tables.is_bundle("first_line")).select("path", F.lit(",").alias("separator"))
    rows, headers = tables.parse_csv_lines(lines, dialects, skip_initial_space=True)
    return lines, first, materialize(rows), headers


@query
def bundle_flags(spark, sf_dir):
    lines = bundle_lines(spark, sf_dir).unionByName(csv_lines(spark, sf_dir))
    first = lines.groupBy("path").agg(F.min_by("line", "ord").alias("first_line"))
    return first.select("path", tables.is_bundle("first_line").alias("is_bundle"))


@query
def bundle_language_stats(spark, sf_dir):
    _, _, rows, headers = _bundle(spark, sf_dir)
    stats = tables.bundle_stats(rows, headers)
    return stats.select("path", "lang", *[_long(c).alias(c) for c in
                        ("total_entries", "displayed_entries", "unique_bundles", "translations", "non_empty")])


@query
def bundle_documents(spark, sf_dir):
    docs = tables.bundle_documents(bundle_lines(spark, sf_dir))
    return docs.select("path", "part_no", "parser", "markdown")


@query
def workbook_documents(spark, sf_dir):
    sheets = None
    for idx, name, order in ((0, "region", "r_regionkey"), (1, "nation", "n_nationkey"), (2, "supplier", "s_suppkey")):
        t = table(spark, sf_dir, name)
        tab = tables.frame_markdown_table(t, [order]).select("part_no", "table")
        facts = t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(idx).alias("sheet_idx"), "row_count")
        sheet = tab.withColumn("sheet_idx", F.lit(idx)).join(facts, "sheet_idx").select(
            F.lit("/corpus/xlsx/tables.xlsx").alias("workbook"), "sheet_idx", F.lit(name).alias("sheet_name"), "part_no",
            F.array(*map(F.lit, t.columns)).alias("column_names"),
            "row_count", F.lit(len(t.columns)).alias("column_count"), F.col("row_count").alias("shown_rows"),
            F.lit(len(t.columns)).alias("shown_columns"), "table", F.lit(None).cast("string").alias("error"),
        )
        sheets = sheet if sheets is None else sheets.unionByName(sheet)
    docs = tables.assemble_workbook(sheets)
    return docs.select("workbook", "part_no", "parser", "markdown", "sheet_count", "total_rows", "max_columns",
                       F.to_json("sheets_data").alias("sheets_data"))


# ---------------------------------------------------------------- slides


@query
def slide_decks(spark, sf_dir):
    decks = slides_ops.legacy_notice(slides_ops.assemble_deck(slides(spark, sf_dir)))
    return decks.select("deck", "parser", "markdown", "slide_count", "image_count", "title")


@query
def slide_deck_parts(spark, sf_dir):
    decks = slides_ops.legacy_notice(slides_ops.deck_parts(slides(spark, sf_dir)))
    return decks.select("deck", "part_no", "parser", "markdown", "slide_count", "image_count", "title")


@query
def slide_image_names(spark, sf_dir):
    imgs = slides_ops.slide_images(slides(spark, sf_dir), with_bytes=False)
    return imgs.select("deck", _long("slide_idx").alias("slide_idx"), "image_no", "name", "alt")


@query
def slide_sections(spark, sf_dir):
    s = slides(spark, sf_dir)
    sec = slides_ops.slide_sections(s, slides_ops.slide_images(s, with_bytes=False))
    return sec.select("deck", _long("slide_idx").alias("slide_idx"), "title", "section")


# ---------------------------------------------------------------- images

TRIAGE = Settings(exclude_decorative=True, decorative_threshold_px=50, embed_small_images=True, small_image_threshold_kb=5)


@query
def image_types(spark, sf_dir):
    im = part_images(spark, sf_dir)
    return im.select("p_partkey", sniff_image_type(F.col("bytes")).alias("ext"))


@query
def image_sizes(spark, sf_dir):
    im = images_ops.with_size(part_images(spark, sf_dir))
    return im.select("p_partkey", "width", "height", "decodable")


@query
def image_resize_plan(spark, sf_dir):
    im = images_ops.resize_plan(images_ops.with_size(part_images(spark, sf_dir)), 100)
    return im.select("p_partkey", "target_width", "target_height")


@query
def image_decisions(spark, sf_dir):
    d = images_ops.triage_images(part_images(spark, sf_dir), TRIAGE)
    return d.select("p_partkey", "action", "format", "data_uri", "new_path")


@query
def image_decorative(spark, sf_dir):
    im = images_ops.drop_decorative(images_ops.with_size(part_images(spark, sf_dir)), 50)
    return im.select("p_partkey", "width", "height")


@query
def image_embedded(spark, sf_dir):
    im = part_images(spark, sf_dir).withColumn("format", image_format(images_ops.final_name("filename")))
    return images_ops.embed_small(im, 5).select("p_partkey", "data_uri")


@query
def pdf_documents(spark, sf_dir):
    d = images_ops.triage_images(part_images(spark, sf_dir), TRIAGE)
    docs = images_ops.apply_image_decisions(pdf_docs(spark, sf_dir), d)
    return docs.select("doc_key", fix_pdf_quotes(F.col("markdown")).alias("markdown"))


@query
def image_summary(spark, sf_dir):
    d = images_ops.triage_images(part_images(spark, sf_dir), TRIAGE)
    s = images_ops.image_summary(d)
    return s.select("doc_key", "action", _long("images").alias("images"), _long("bytes").alias("bytes"))


# ---------------------------------------------------------------- packages and report


@query
def metadata_documents(spark, sf_dir):
    routed = convert.route_files(doc_files(spark, sf_dir))
    docs = text_ops.render_simple(routed.where(~F.col("_skip") & (F.col("processor") == "simple")))
    return package_ops.metadata_json(docs, ["language", "error"]).select("doc_id", "metadata")


@query
def metadata_merged(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("parser"), F.lit("custom"),
                        F.lit("n_chars"), F.col("n_chars").cast("string"))
    base = F.create_map(F.lit("source_filename"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")),
                        F.lit("parser"), F.lit("txt_simple"))
    m = package_ops.normalize_metadata(meta, base)
    return d.select("doc_id", m["parser"].alias("parser"), _long(F.size(m)).alias("n_keys"), m["lang"].alias("lang"),
                    m["source_filename"].alias("source_filename"))


@query
def media_flattened(spark, sf_dir):
    flat = package_ops.flatten_nested_media(package_media(spark, sf_dir))
    return flat.select("package", "entry", "source_entry", F.md5("bytes").alias("digest"))


@query
def package_entry_list(spark, sf_dir):
    docs = package_ops.metadata_json(package_docs(spark, sf_dir))
    media = package_ops.flatten_nested_media(package_media(spark, sf_dir)).select("package", F.regexp_replace("entry", "^media/", "").alias("name"), "bytes")
    e = package_ops.package_entries(docs, media)
    return e.select("package", "entry", "kind", _long(F.length("bytes")).alias("size"), F.md5("bytes").alias("digest"))


def _table_outcomes(spark, sf_dir):
    return convert.file_statuses(convert.route_files(doc_files(spark, sf_dir)), keep=("doc_id",))


@query
def file_outcomes(spark, sf_dir):
    return _table_outcomes(spark, sf_dir).select("doc_id", "path", "parser", "status", "message")


@query
def batch_report(spark, sf_dir):
    rep = report_ops.batch_report(_table_outcomes(spark, sf_dir))
    return rep.select("parser", _long("found").alias("found"), _long("ok").alias("ok"), _long("failed").alias("failed"))


@query
def batch_progress(spark, sf_dir):
    return report_ops.progress(_table_outcomes(spark, sf_dir), ["path", "doc_id"]).select("doc_id", "percent")


@query
def corpus_documents(spark, sf_dir):
    docs = convert.convert_tables(spark, sf_dir)
    return docs.select("doc_id", "path", "part_no", "parser", "markdown", "error")
