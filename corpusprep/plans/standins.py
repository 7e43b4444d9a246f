"""Stand-in inputs derived from the benchmark tables, in Spark and in SQL.

The reference works on folders of files; the benchmark gives tables. Each
function here derives a corpus-shaped DataFrame from whole tables (every row
takes part), and the matching ``*_SQL`` constant builds the same rows for the
DuckDB oracle. Names and sizes are synthesised from keys (``doc_id % n`` picks
an extension, it filters nothing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions.text import normalize_newlines
from corpusprep.operators.ordered import group_index
from corpusprep.sources.tables import table

# Extensions cycled over documents to make file names.
DOC_EXTS = [
    ".txt", ".json", ".py", ".md", ".csv", ".html", ".pdf", ".pptx", ".ppt", ".docx",
    ".xml", ".zip", ".tsv", ".xlsx", ".bin", ".go", ".opml", ".htm", ".rs", ".TXT",
]
# File-name prefixes cycled over documents (temp and system names among them).
DOC_PREFIXES = ["doc_", "~$doc_", ".~lock.doc_", "Doc_", "report_", "notes_"]
# Names that replace the generated one for some documents.
SPECIAL_NAMES = ["Thumbs.db", "desktop.ini", ".DS_Store", "draft.tmp", "old.bak"]


def _sql_array(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: ``doc_id, path, text`` (path under ``/corpus/in/``).

    Paths are unique. One in twelve has the name of the file six ids before with
    another extension, so that packages collide.
    """
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in DOC_EXTS]), (F.col("doc_id") % len(DOC_EXTS) + 1).cast("int"))
    prefix = F.element_at(F.array(*[F.lit(p) for p in DOC_PREFIXES]), (F.col("doc_id") % len(DOC_PREFIXES) + 1).cast("int"))
    special = F.element_at(F.array(*[F.lit(p) for p in SPECIAL_NAMES]), (F.col("doc_id") % len(SPECIAL_NAMES) + 1).cast("int"))
    number = F.when(F.col("doc_id") % 12 == 9, F.col("doc_id") - 6).otherwise(F.col("doc_id")).cast("string")
    name = F.when(F.col("doc_id") % 37 == 5, F.concat(F.col("doc_id").cast("string"), F.lit("/"), special)).otherwise(
        F.concat(prefix, number, ext)
    )
    return d.select("doc_id", F.concat(F.lit("/corpus/in/"), name).alias("path"), "text", "lang", "source")


DOC_FILES_SQL = f"""
doc_files AS (
  SELECT doc_id,
         '/corpus/in/' || CASE WHEN doc_id % 37 = 5
              THEN CAST(doc_id AS VARCHAR) || '/' || {_sql_array(SPECIAL_NAMES)}[doc_id % {len(SPECIAL_NAMES)} + 1]
              ELSE {_sql_array(DOC_PREFIXES)}[doc_id % {len(DOC_PREFIXES)} + 1]
                   || CAST(CASE WHEN doc_id % 12 = 9 THEN doc_id - 6 ELSE doc_id END AS VARCHAR)
                   || {_sql_array(DOC_EXTS)}[doc_id % {len(DOC_EXTS)} + 1] END AS path,
         text, lang, source
  FROM documents)"""


def img_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with external and local ``<img>`` tags appended (one URL used twice)."""
    p = table(spark, sf_dir, "pages")
    site = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    u1 = F.concat(site, F.lit("/logo.png"))
    u2 = F.concat(F.lit("https://cdn.example.org/"), (F.col("page_id") % 7).cast("string"), F.lit("/banner"))
    tags = F.concat(
        F.lit('<img src="'), u1, F.lit('" alt="logo">'),
        F.lit('<p><img src="'), u2, F.lit('"></p>'),
        F.lit('<img class="x" src="'), u1, F.lit('">'),
        F.lit('<img src="/static/local.png">'),
    )
    return p.select("page_id", "url", F.concat(F.col("html"), tags).alias("html"))


IMG_PAGES_SQL = """
img_pages AS (
  SELECT page_id, url,
         html || '<img src="' || regexp_replace(url, '[?#].*$', '') || '/logo.png" alt="logo">'
              || '<p><img src="https://cdn.example.org/' || CAST(page_id % 7 AS VARCHAR) || '/banner"></p>'
              || '<img class="x" src="' || regexp_replace(url, '[?#].*$', '') || '/logo.png">'
              || '<img src="/static/local.png">' AS html
  FROM pages)"""


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as Markdown files with image refs of every kind appended:
    ``doc_key, path, markdown``."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    m = (F.col("doc_id") * 7 % 2500).cast("string")
    refs = F.concat(
        F.lit("\n\n![Figure "), i, F.lit("](./img/p"), m, F.lit('.png "Fig '), i, F.lit('")'),
        F.lit("\n![Logo](../assets/logo"), (F.col("doc_id") % 4).cast("string"), F.lit(")"),
        F.lit("\n<IMG SRC='media/asset"), (F.col("doc_id") % 5).cast("string"), F.lit(".PNG' ALT='X'>"),
        F.lit('\n<img src="img/p'), m, F.lit('.png">'),
        F.lit("\n![remote](https://example.com/x"), i, F.lit(".png)"),
        F.lit("\n![again](./img/p"), m, F.lit(".png)"),
        F.lit("\n![abs](/abs/p"), i, F.lit(".png)"),
        F.lit("\n![inline](data:image/png;base64,AAAA)"),
    )
    path = F.concat(F.lit("/corpus/docs/d"), (F.col("doc_id") % 10).cast("string"), F.lit("/doc_"), i, F.lit(".md"))
    return d.select(F.col("doc_id").alias("doc_key"), path.alias("path"), F.concat(F.col("text"), refs).alias("markdown"))


def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media file listing derived from ``part``: ``path``."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    d = (k % 10).cast("string")
    return p.select(
        F.explode(
            F.array(
                F.concat(F.lit("/corpus/docs/d"), d, F.lit("/img/p"), k.cast("string"), F.lit(".png")),
                F.concat(F.lit("/corpus/docs/assets/logo"), (k % 3).cast("string")),
                F.concat(F.lit("/corpus/docs/d"), d, F.lit("/media/asset"), (k % 5).cast("string"), F.lit(".PNG")),
            )
        ).alias("path")
    )


MD_DOCS_SQL = """
md_docs AS (
  SELECT doc_id AS doc_key, '/corpus/docs/d' || CAST(doc_id % 10 AS VARCHAR) || '/doc_' || CAST(doc_id AS VARCHAR) || '.md' AS path,
         text || chr(10) || chr(10) || '![Figure ' || CAST(doc_id AS VARCHAR) || '](./img/p' || CAST(doc_id * 7 % 2500 AS VARCHAR) || '.png "Fig ' || CAST(doc_id AS VARCHAR) || '")'
              || chr(10) || '![Logo](../assets/logo' || CAST(doc_id % 4 AS VARCHAR) || ')'
              || chr(10) || '<IMG SRC=''media/asset' || CAST(doc_id % 5 AS VARCHAR) || '.PNG'' ALT=''X''>'
              || chr(10) || '<img src="img/p' || CAST(doc_id * 7 % 2500 AS VARCHAR) || '.png">'
              || chr(10) || '![remote](https://example.com/x' || CAST(doc_id AS VARCHAR) || '.png)'
              || chr(10) || '![again](./img/p' || CAST(doc_id * 7 % 2500 AS VARCHAR) || '.png)'
              || chr(10) || '![abs](/abs/p' || CAST(doc_id AS VARCHAR) || '.png)'
              || chr(10) || '![inline](data:image/png;base64,AAAA)' AS markdown
  FROM documents),
media AS (
  SELECT unnest(['/corpus/docs/d' || CAST(p_partkey % 10 AS VARCHAR) || '/img/p' || CAST(p_partkey AS VARCHAR) || '.png',
                 '/corpus/docs/assets/logo' || CAST(p_partkey % 3 AS VARCHAR),
                 '/corpus/docs/d' || CAST(p_partkey % 10 AS VARCHAR) || '/media/asset' || CAST(p_partkey % 5 AS VARCHAR) || '.PNG']) AS path
  FROM part)"""


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files in line form ``(path, ord, line)``.

    One file per ``part`` brand (separator by brand number: ``;`` ``,`` tab),
    a quoted name column, a blank line every 89th key and an extra field every
    97th key (a bad line); plus a one-column file of nation names, a
    header-only file and a file holding only a blank line.
    """
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    sep = F.element_at(F.array(F.lit(";"), F.lit(","), F.lit("\t")), brand % 3 + 1)
    path = F.concat(F.lit("/corpus/csv/brand_"), brand.cast("string"), F.lit(".csv"))
    k = F.col("p_partkey")
    line = F.when(k % 89 == 0, F.lit("")).otherwise(
        F.concat_ws(
            "",
            k.cast("string"), sep, F.lit('"'), F.col("p_name"), F.lit('"'), sep, F.col("p_type"), sep,
            F.col("p_size").cast("string"), sep, F.col("p_retailprice").cast("string"),
            F.when(k % 97 == 0, F.concat(sep, F.lit("extra"))),
        )
    )
    data = p.select(path.alias("path"), (k + 1).alias("ord"), line.alias("line"))
    header = p.select(path.alias("path"), sep.alias("sep")).distinct().select(
        "path", F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("key"), F.col("sep"), F.lit("name"), F.col("sep"), F.lit("type"), F.col("sep"), F.lit("size"),
                 F.col("sep"), F.lit("price")).alias("line"),
    )
    n = table(spark, sf_dir, "nation")
    names = n.select(F.lit("/corpus/csv/nation_names.csv").alias("path"), (F.col("n_nationkey") + 1).cast("bigint").alias("ord"), F.col("n_name").alias("line"))
    names_h = n.agg(F.min("n_nationkey")).select(F.lit("/corpus/csv/nation_names.csv").alias("path"), F.lit(0).cast("bigint").alias("ord"), F.lit("n_name").alias("line"))
    r = table(spark, sf_dir, "region").agg(F.count(F.lit(1)).alias("n"))
    empty = r.select(F.lit("/corpus/csv/region_empty.csv").alias("path"), F.lit(0).cast("bigint").alias("ord"), F.lit("r_regionkey;r_name").alias("line"))
    blank = r.select(F.lit("/corpus/csv/blank.csv").alias("path"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("line"))
    return data.unionByName(header).unionByName(names).unionByName(names_h).unionByName(empty).unionByName(blank)


CSV_LINES_SQL = """
csv_lines AS (
  SELECT '/corpus/csv/brand_' || CAST(CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INT) AS VARCHAR) || '.csv' AS path,
         p_partkey + 1 AS ord,
         CASE WHEN p_partkey % 89 = 0 THEN '' ELSE
           CAST(p_partkey AS VARCHAR) || s || '"' || p_name || '"' || s || p_type || s || CAST(p_size AS VARCHAR) || s
           || CAST(p_retailprice AS VARCHAR) || CASE WHEN p_partkey % 97 = 0 THEN s || 'extra' ELSE '' END END AS line
  FROM (SELECT *, [';', ',', chr(9)][CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INT) % 3 + 1] AS s FROM part)
  UNION ALL
  SELECT DISTINCT '/corpus/csv/brand_' || CAST(CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INT) AS VARCHAR) || '.csv', 0,
         concat_ws([';', ',', chr(9)][CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INT) % 3 + 1], 'key', 'name', 'type', 'size', 'price')
  FROM part
  UNION ALL SELECT '/corpus/csv/nation_names.csv', n_nationkey + 1, n_name FROM nation
  UNION ALL SELECT '/corpus/csv/nation_names.csv', 0, 'n_name' FROM (SELECT min(n_nationkey) FROM nation)
  UNION ALL SELECT '/corpus/csv/region_empty.csv', 0, 'r_regionkey;r_name' FROM (SELECT count(*) FROM region)
  UNION ALL SELECT '/corpus/csv/blank.csv', 0, '' FROM (SELECT count(*) FROM region))"""


def quoted_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents`` as quoted fields of CSV files, one file a source: ``path, ord, line``."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/corpus/csv/texts_"), F.coalesce("source", F.lit("none")), F.lit(".csv"))
    quoted = F.replace(normalize_newlines(F.coalesce("text", F.lit(""))), F.lit('"'), F.lit('""'))
    record = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), quoted, F.lit('",'), F.coalesce("lang", F.lit("")))
    lines = d.select(path.alias("path"), "doc_id", F.posexplode(F.split(record, "\n")).alias("_i", "line"))
    heads = d.select(path.alias("path")).distinct().select("path", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("_i"), F.lit("doc_id,text,lang").alias("line"))
    return group_index(lines.unionByName(heads), ["path"], ["doc_id", "_i"], "ord").select("path", "ord", "line")


def bundle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as one translation bundle: bundle = source, key = doc id, the
    text (quoted, newlines as spaces) in the column of its language."""
    d = table(spark, sf_dir, "documents")
    q = F.concat(F.lit('"'), F.regexp_replace(F.replace(F.col("text"), F.lit('"'), F.lit('""')), "\n", " "), F.lit('"'))
    cells = [F.when(F.col("lang") == lg, q).otherwise(F.lit("")) for lg in ("en", "fr", "de", "es")]
    line = F.concat_ws(", ", F.col("source"), F.concat(F.lit('"K'), F.col("doc_id").cast("string"), F.lit('"')), *cells)
    path = F.lit("/corpus/csv/messages.csv")
    body = d.select(path.alias("path"), (F.col("doc_id") + 1).alias("ord"), line.alias("line"))
    head = d.agg(F.count(F.lit(1))).select(path.alias("path"), F.lit(0).cast("bigint").alias("ord"), F.lit('bundle,"key",en,fr,de,es').alias("line"))
    return body.unionByName(head)


SLIDE_PARAGRAPHS = "array<struct<level:int,text:string>>"


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as decks: conversation = deck, turn = slide.

    Shapes per slide: a text shape named after the role (``Title 1`` for
    system turns; flagged title for a user's first turn) holding the first
    line; a content shape whose paragraphs are the turn's lines (level = line
    index mod 3); a picture whose bytes are the text behind a PNG, JPEG or GIF
    signature chosen by role. Even conversations carry a stored deck title,
    assistant turns carry notes, every fifth deck is a legacy ``.ppt``.
    """
    c = table(spark, sf_dir, "conversations")
    deck = F.concat(F.lit("/corpus/slides/conv_"), F.col("conv_id").cast("string"),
                    F.when(F.col("conv_id") % 5 == 0, F.lit(".ppt")).otherwise(F.lit(".pptx")))
    magic = (F.when(F.col("role") == "user", F.unhex(F.lit("89504E470D0A1A0A")))
             .when(F.col("role") == "assistant", F.unhex(F.lit("FFD8FFE0")))
             .otherwise(F.unhex(F.lit("474946383961"))))
    no_pars = F.lit(None).cast(SLIDE_PARAGRAPHS)
    shapes = F.array(
        F.struct(F.lit("text").alias("kind"), F.when(F.col("role") == "system", F.lit("Title 1")).otherwise(F.col("role")).alias("name"),
                 F.substring_index("text", "\n", 1).alias("text"), ((F.col("role") == "user") & (F.col("turn") == 0)).alias("is_title"),
                 no_pars.alias("paragraphs"), F.lit(None).cast("binary").alias("image"), F.lit(None).cast("string").alias("alt")),
        F.struct(F.lit("text").alias("kind"), F.concat(F.lit("Content "), F.col("turn").cast("string")).alias("name"),
                 F.col("text").alias("text"), F.lit(False).alias("is_title"),
                 F.transform(F.split("text", "\n"), lambda x, i: F.struct((i % 3).alias("level"), x.alias("text"))).alias("paragraphs"),
                 F.lit(None).cast("binary").alias("image"), F.lit(None).cast("string").alias("alt")),
        F.struct(F.lit("picture").alias("kind"), F.concat(F.lit("Picture "), F.col("turn").cast("string")).alias("name"),
                 F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_title"), no_pars.alias("paragraphs"),
                 F.concat(magic, F.encode("text", "UTF-8")).alias("image"),
                 F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Figure "), F.col("turn").cast("string"))).alias("alt")),
    )
    return c.select(
        deck.alias("deck"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Deck "), F.col("conv_id").cast("string"))).alias("core_title"),
        (F.col("turn") + 1).alias("slide_idx"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("notes"),
        shapes.alias("shapes"),
    )


# Image kinds cycled over parts (``.dat`` bytes are not an image).
IMAGE_EXTS = [".png", ".jpg", ".gif", ".dat", ".jpeg"]


# Rows of ``part`` that a task makes images of.
IMAGES_OF_A_TASK = 5000


def _hex_be(c, n):
    return F.lpad(F.hex(c), 2 * n, "0")


def part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` rows as images extracted from 50 PDF documents:
    ``p_partkey, doc_key, placeholder, filename, bytes`` (width = size*3 + key mod 7,
    height = size*2 + 1; padding of the part name repeated size*40 times)."""
    p = table(spark, sf_dir, "part")
    # some bytes of a part make an image of some 30 KB: a split of the table would be hours of one task
    p = p.repartition(max(1, -(-p.count() // IMAGES_OF_A_TASK)))
    k = F.col("p_partkey")
    w = F.col("p_size") * 3 + k % 7
    h = F.col("p_size") * 2 + 1
    typ = (k % 5).cast("int")
    ext = F.element_at(F.array(*[F.lit(e) for e in IMAGE_EXTS]), typ + 1)
    pad = F.encode(F.repeat(F.col("p_name"), F.col("p_size") * 40), "UTF-8")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex_be(w, 4), _hex_be(h, 4), F.lit("0806000000")))
    jpg = F.unhex(F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), _hex_be(h, 2), _hex_be(w, 2),
                           F.lit("03012200021101031101")))
    gif = F.unhex(F.concat(F.lit("474946383961"), F.substring(_hex_be(w, 2), 3, 2), F.substring(_hex_be(w, 2), 1, 2),
                           F.substring(_hex_be(h, 2), 3, 2), F.substring(_hex_be(h, 2), 1, 2), F.lit("F70000")))
    head = F.when(typ == 0, png).when(typ == 2, gif).when(typ == 3, F.unhex(F.lit(""))).otherwise(jpg)
    doc = F.concat(F.lit("pdf_"), (k % 50).cast("string"))
    name = F.concat(F.lit("img_"), k.cast("string"), ext)
    return p.select(
        "p_partkey", doc.alias("doc_key"),
        F.concat(F.lit("/extract/"), doc, F.lit("/"), name).alias("placeholder"),
        name.alias("filename"), F.concat(head, pad).alias("bytes"),
    )


def pdf_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown document per ``doc_key`` of :func:`part_images`: per image a
    line of text and an image link (every fourth with a title), in key order."""
    from corpusprep.operators.ordered import ordered_concat

    imgs = part_images(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    k = F.col("p_partkey")
    piece = F.concat(F.lit("Text "), F.col("p_name"), F.lit("\n![Image "), k.cast("string"), F.lit("]("), F.col("placeholder"),
                     F.when(k % 4 == 0, F.lit(' "caption"')).otherwise(F.lit("")), F.lit(")"))
    return ordered_concat(imgs.select("doc_key", "p_partkey", piece.alias("piece")), ["doc_key"], "p_partkey", "piece", "\n", "markdown")


def package_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as converted text files: ``package, source_filename, parser, markdown``
    (every 11th document produced no text)."""
    d = table(spark, sf_dir, "documents")
    pkg = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return d.select(
        pkg.alias("package"), F.concat(pkg, F.lit(".txt")).alias("source_filename"), F.lit("txt_simple").alias("parser"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text")).alias("markdown"),
    )


def package_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of the packages from ``part``: ``package, entry, name, bytes``; odd keys
    sit in a nested ``media/media/`` folder, every sixth key also has a nested twin."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pkg = F.concat(F.lit("doc_"), (k * 7 % 1000).cast("string"))
    name = F.concat(F.lit("p"), k.cast("string"), F.lit(".png"))
    main = p.select(pkg.alias("package"), F.concat(F.when(k % 2 == 0, F.lit("media/")).otherwise(F.lit("media/media/")), name).alias("entry"),
                    name.alias("name"), F.encode("p_name", "UTF-8").alias("bytes"))
    twin = p.where(k % 6 == 0).select(pkg.alias("package"), F.concat(F.lit("media/media/"), name).alias("entry"), name.alias("name"),
                                      F.encode(F.upper("p_name"), "UTF-8").alias("bytes"))
    return main.unionByName(twin)
