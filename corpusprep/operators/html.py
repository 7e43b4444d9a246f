"""HTML documents: Markdown conversion, external images, localisation, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.config import DEFAULT, Settings
from corpusprep.functions.common import md5_prefix
from corpusprep.functions.html import (
    fix_media_paths,
    fix_table_captions,
    html_title,
    html_to_markdown,
    table_of_contents,
    with_front_matter,
)

_IMG_SRC = r"(?i)<img[ \t\r\n][^>]*?src=[\"']([^\"']*)[\"']"


def html_documents(pages: DataFrame, html_col: str = "html", settings: Settings = DEFAULT) -> DataFrame:
    """Add ``title`` and ``markdown`` (front matter with the title, optional TOC,
    media-path and caption fixes). A narrow projection: no shuffle."""
    md_body = html_to_markdown(F.col(html_col))
    if settings.pandoc_toc:
        toc = table_of_contents(md_body)
        md_body = F.when(toc == "", md_body).otherwise(F.concat(toc, F.lit("\n\n"), md_body))
    with_title = pages.withColumn("title", html_title(F.col(html_col)))
    md = fix_table_captions(fix_media_paths(with_front_matter(md_body, F.col("title"))))
    return with_title.withColumn("markdown", md)


def with_toc(docs: DataFrame, md_col: str = "markdown") -> DataFrame:
    """Table of contents ahead of the body (``pandoc_toc``)."""
    toc = table_of_contents(F.col(md_col))
    return docs.withColumn(
        md_col, F.when(toc == "", F.col(md_col)).otherwise(F.concat(toc, F.lit("\n\n"), F.col(md_col)))
    )


def external_images(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every ``<img>`` source starting ``http://`` or ``https://``: ``(key, pos, url)``."""
    srcs = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(_IMG_SRC), 1)).alias("pos", "url"))
    return srcs.where(F.col("url").startswith("http://") | F.col("url").startswith("https://"))


def external_image_name(url) -> F.Column:
    """``ext_img_<md5(url)[:12]><ext>``; the extension is the URL's own ``splitext``
    one (query strings included); none or longer than 5 -> ``.jpg``."""
    u = F.col(url) if isinstance(url, str) else url
    last = F.regexp_extract(u, r"([^/]*)$", 1)
    ext = F.regexp_extract(last, r"^\.*[^.].*(\.[^.]*)$", 1)
    ext = F.when((F.length(ext) == 0) | (F.length(ext) > 5), F.lit(".jpg")).otherwise(ext)
    return F.concat(F.lit("ext_img_"), md5_prefix(u), ext)


def fetch_plan(refs: DataFrame, existing_media: DataFrame | None = None) -> DataFrame:
    """Unique URLs over the corpus with their local names; names already present
    in ``existing_media`` (column ``name``) are not fetched again."""
    plan = refs.select("url").distinct().withColumn("local_name", external_image_name("url"))
    plan = plan.withColumn("local_path", F.concat(F.lit("media/"), F.col("local_name")))
    if existing_media is not None:
        plan = plan.join(existing_media.select(F.col("name").alias("local_name")), "local_name", "left_anti")
    return plan


_IMG_SRC_TAG = r"(?i)(<img[ \t\r\n][^>]*?src=)([\"'])([^\"']*)([\"'])"


def localize_images(pages: DataFrame, fetched: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Point every ``src`` of a fetched URL at its local copy; other sources stay.

    Each page gets a map ``url -> local path`` and is rewritten in one scan,
    however many images it has. Only pages with external images take part in
    the join; the rest pass through untouched, so their bodies never shuffle.
    """
    from corpusprep.operators.links import split_rewrite

    refs = external_images(pages, key, html_col).select(key, "url").distinct()
    links = refs.join(fetched.groupBy("url").agg(F.min("local_path").alias("local_path")), "url")
    per_page = links.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("url", "local_path"))).alias("_m"))
    has_img = F.regexp_extract_all(F.col(html_col), F.lit(_IMG_SRC), 1)
    has_ext = F.exists(has_img, lambda u: u.startswith("http://") | u.startswith("https://"))
    with_flag = pages.withColumn("_has_ext", has_ext)
    touched = with_flag.where("_has_ext").join(per_page, key, "left")

    def tag(e):
        new = F.try_element_at(F.col("_m"), e["g3"])
        return F.when(new.isNull(), e["g0"]).otherwise(F.concat(e["g1"], e["g2"], new, e["g4"]))

    html = F.col(html_col)
    rewritten = touched.withColumn(
        html_col, F.when(F.col("_m").isNull(), html).otherwise(split_rewrite(html, _IMG_SRC_TAG, 4, tag))
    ).drop("_m")
    untouched = with_flag.where(~F.col("_has_ext"))
    return rewritten.unionByName(untouched).drop("_has_ext")


def external_image_report(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: total and unique external images and the notice shown while converting."""
    refs = external_images(pages, key, html_col)
    return refs.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_images"), F.countDistinct("url").alias("unique_images")
    ).withColumn(
        "notice",
        F.concat(
            F.lit("File contains "),
            F.col("total_images").cast("string"),
            F.lit(" external image(s). Processing may take longer than usual."),
        ),
    )
