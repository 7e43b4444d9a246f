"""Slide decks -> Markdown: ordered assembly of per-slide fragments.

Input is a ``slides`` table (one row per slide):
``deck, core_title, slide_idx, notes, shapes ARRAY<STRUCT<kind, name, text,
is_title, paragraphs ARRAY<STRUCT<level, text>>, image BINARY, alt>>>``.
Each slide's section is built by a projection, and image numbers by a blocked
running sum. ``deck_parts`` returns a deck in ordered parts, so one of any size
is built in parallel; ``assemble_deck`` joins them into one string a deck, of
2 GB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.common import col_of, md5_prefix, py_strip
from corpusprep.functions.images import sniff_image_type
from corpusprep.operators.ordered import BLOCK, running_sum_before
from corpusprep.operators.tables import ordered_join

LEGACY_NOTICE = (
    "# PPT Format Notice\n\n"
    "This file is in the older PPT format, which has limited support in this tool. "
    "For best results, please consider converting it to PPTX format using Microsoft PowerPoint "
    "or another compatible application.\n\n"
    "Some content or formatting may not be properly extracted from this file.\n\n"
    "---\n\n"
)


#: Type of a title placeholder (fixed value).
TITLE_PLACEHOLDER = 1


def _has_text(s: Column) -> Column:
    return s["text"].isNotNull()


def slide_title(shapes, with_placeholder: bool = False) -> Column:
    """Stripped text of the first shape flagged title, named ``*title*`` or, where shapes have a
    ``placeholder_type``, of the type of titles; null when none."""
    def is_title(s: Column) -> Column:
        hit = F.coalesce(s["is_title"], F.lit(False)) | F.lower(F.coalesce(s["name"], F.lit(""))).contains("title")
        return hit | F.coalesce(s["placeholder_type"] == TITLE_PLACEHOLDER, F.lit(False)) if with_placeholder else hit

    hits = F.filter(col_of(shapes), lambda s: _has_text(s) & is_title(s))
    return py_strip(F.try_element_at(hits, F.lit(1))["text"])


def _title_of(slides: DataFrame) -> Column:
    return slide_title(F.col("shapes"), "placeholder_type" in slides.schema["shapes"].dataType.elementType.fieldNames())


def bullets(shapes) -> Column:
    """Text of all non-title shapes: ``'  ' * level`` + ``* `` (level 0) or ``- ``
    per paragraph; shapes without paragraphs give their stripped text."""
    body = F.filter(
        col_of(shapes),
        lambda s: _has_text(s) & (py_strip(s["text"]) != "") & ~F.coalesce(s["is_title"], F.lit(False)),
    )
    per_shape = F.transform(
        body,
        lambda s: F.when(
            s["paragraphs"].isNull(), py_strip(s["text"])
        ).otherwise(
            F.array_join(
                F.transform(
                    s["paragraphs"],
                    lambda p: F.concat(
                        F.repeat(F.lit("  "), p["level"]),
                        F.when(p["level"] == 0, F.lit("* ")).otherwise(F.lit("- ")),
                        py_strip(p["text"]),
                    ),
                ),
                "\n",
            )
        ),
    )
    return F.array_join(per_shape, "\n")


def notes_block(notes) -> Column:
    n = py_strip(col_of(notes))
    return F.when(n.isNotNull() & (n != ""), F.concat(F.lit("\n> **Slide Notes:** "), n, F.lit("\n")))


def _no_bytes(shapes) -> Column:
    """Shapes with image bytes dropped (what the text of a slide needs)."""
    return F.transform(col_of(shapes), lambda s: s.withField("image", F.lit(None).cast("binary")))


def slide_images(slides: DataFrame, deck: str = "deck", with_bytes: bool = True) -> DataFrame:
    """One row per picture: ``(deck, slide_idx, shape_idx, image_no, name, alt[, image])``.

    ``image_no`` runs through the deck from 0; name ``ppt_img_<n>_<md5 12><ext>``;
    alt = alt text, else shape name, else ``Slide i Image n``. Digest and type
    are read where the bytes are; only ``with_bytes`` keeps the bytes for the
    media entries of a package.
    """
    is_pic = lambda s: (s["kind"] == "picture") & s["image"].isNotNull()
    # only pictures are exploded, each with its place among the shapes; its place among the pictures is its number
    indexed = F.transform("shapes", lambda s, i: F.struct(i.alias("shape_idx"), s.alias("s")))
    pics = slides.select(deck, "slide_idx", F.posexplode(F.filter(indexed, lambda x: is_pic(x["s"]))).alias("_in_slide", "x"))
    pics = pics.select(deck, "slide_idx", "_in_slide", "x.shape_idx", "x.s").select(
        deck, "slide_idx", "shape_idx", "_in_slide",
        F.struct(F.col("s.name").alias("name"), F.col("s.alt").alias("alt"), (F.col("s.image") if with_bytes else F.lit(None).cast("binary")).alias("image"),
                 md5_prefix(F.col("s.image")).alias("digest"), sniff_image_type(F.col("s.image")).alias("ext")).alias("s"),
    )
    per_slide = slides.select(deck, "slide_idx", F.size(F.filter("shapes", is_pic)).alias("_n"))
    offsets = running_sum_before(per_slide, [deck], "slide_idx", "_n", "_off").drop("_n")
    ranked = pics.join(offsets, [deck, "slide_idx"])
    no = (F.col("_off") + F.col("_in_slide")).cast("bigint")
    name = F.concat(F.lit("ppt_img_"), no.cast("string"), F.lit("_"), F.col("s.digest"), F.col("s.ext"))
    alt = F.coalesce(
        F.when(F.col("s.alt") != "", F.col("s.alt")),
        F.when(F.col("s.name") != "", F.col("s.name")),
        F.concat(F.lit("Slide "), F.col("slide_idx").cast("string"), F.lit(" Image "), no.cast("string")),
    )
    cols = [deck, "slide_idx", "shape_idx", no.alias("image_no"), name.alias("name"), alt.alias("alt")]
    return ranked.select(*cols, F.col("s.image").alias("image")) if with_bytes else ranked.select(*cols)


def slide_sections(slides: DataFrame, images: DataFrame, deck: str = "deck") -> DataFrame:
    """``(deck, slide_idx, title, section)``: heading, text, image links, notes, rule."""
    links = images.groupBy(deck, "slide_idx").agg(
        F.array_sort(F.collect_list(F.struct("shape_idx", F.concat(F.lit("\n!["), F.col("alt"), F.lit("](media/"), F.col("name"), F.lit(")\n")).alias("l")))).alias("_imgs")
    )
    j = slides.select(deck, "slide_idx", "notes", _no_bytes("shapes").alias("shapes")).join(links, [deck, "slide_idx"], "left")
    title = _title_of(j)
    heading = F.coalesce(F.when(title != "", title), F.concat(F.lit("Slide "), F.col("slide_idx").cast("string")))
    text = bullets(F.col("shapes"))
    imgs = F.array_join(F.transform(F.coalesce(F.col("_imgs"), F.array()), lambda s: s["l"]), "\n")
    section = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), heading, F.lit("\n")),
        F.when(text != "", text),
        F.when(F.size(F.coalesce(F.col("_imgs"), F.array())) > 0, imgs),
        notes_block(F.col("notes")),
        F.lit("\n---\n"),
    )
    return j.select(deck, "slide_idx", title.alias("title"), section.alias("section"))


def _deck_facts(slides: DataFrame, deck: str) -> DataFrame:
    first = slides.groupBy(deck).agg(
        F.min_by(F.struct(_title_of(slides).alias("t")), F.col("slide_idx")).alias("f"),
        F.max(F.when(F.col("core_title") != "", F.col("core_title"))).alias("_core"),
        F.count(F.lit(1)).alias("slide_count"),
    )
    return first.select(deck, F.coalesce(F.col("_core"), F.col("f.t")).alias("title"), "slide_count")


def deck_title(slides: DataFrame, deck: str = "deck") -> DataFrame:
    """Stored title, else the title of the first slide (may be null)."""
    return _deck_facts(slides, deck).select(deck, "title")


def deck_parts(slides: DataFrame, deck: str = "deck", part_slides: int = BLOCK) -> DataFrame:
    """Markdown of each deck in parts ``(deck, part_no, parser, markdown, slide_count, image_count, title)``.

    A part holds the slides of ``part_slides`` consecutive ``slide_idx``; part 0 starts with
    the title. Joined in order with a newline the parts are the deck. No step has a
    whole deck in one group but the facts and a row for each part.
    """
    images = slide_images(slides, deck, with_bytes=False)
    part = F.floor(F.col("slide_idx") / F.lit(part_slides)).cast("bigint").alias("_part")
    sections = slide_sections(slides, images, deck).select(deck, part, "slide_idx", "section")
    body = ordered_join(sections, [deck, "_part"], "slide_idx", "section", "\n", "_body")
    numbers = F.row_number().over(Window.partitionBy(deck).orderBy("_part")) - 1
    parts = slides.select(deck, part).distinct().withColumn("part_no", numbers.cast("bigint"))
    n_img = images.groupBy(deck).agg(F.count(F.lit(1)).alias("image_count"))
    out = body.join(parts.join(_deck_facts(slides, deck), deck).join(n_img, deck, "left"), [deck, "_part"])
    heading = F.when((F.col("part_no") == 0) & (F.col("title") != ""), F.concat(F.lit("# "), F.col("title"), F.lit("\n")))
    return out.select(
        deck,
        "part_no",
        F.lit("pptx_parser").alias("parser"),
        F.concat_ws("\n", heading, F.col("_body")).alias("markdown"),
        F.col("slide_count").cast("bigint").alias("slide_count"),
        F.coalesce(F.col("image_count"), F.lit(0)).cast("bigint").alias("image_count"),
        "title",
    )


def assemble_deck(slides: DataFrame, deck: str = "deck") -> DataFrame:
    """One Markdown document per deck with ``slide_count``, ``image_count``, ``title``.

    A deck above 2 GB doesn't fit a row: see ``deck_parts``.
    """
    parts = deck_parts(slides, deck)
    facts = ["parser", "slide_count", "image_count", "title"]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "markdown"))), lambda p: p["markdown"]), "\n")
    out = parts.groupBy(deck).agg(whole.alias("markdown"), *(F.max(c).alias(c) for c in facts))
    return out.select(deck, "parser", "markdown", *facts[1:])


def legacy_notice(decks: DataFrame, deck: str = "deck", md_col: str = "markdown") -> DataFrame:
    """``.ppt`` decks get a notice ahead of their Markdown (of part 0, if in parts) unless it starts ``# Error``."""
    is_ppt = F.lower(F.col(deck)).endswith(".ppt")
    if "part_no" in decks.columns:
        is_ppt &= F.col("part_no") == 0
    ok = F.col(md_col).isNotNull() & (F.col(md_col) != "") & ~F.col(md_col).startswith("# Error")
    return decks.withColumn(md_col, F.when(is_ppt & ok, F.concat(F.lit(LEGACY_NOTICE), F.col(md_col))).otherwise(F.col(md_col)))
