from corpusprep.operators import links


def _run(spark, md, media_paths, doc_path="/docs/note.md"):
    docs = spark.createDataFrame([(1, doc_path, md)], "doc_key int, path string, markdown string")
    media = spark.createDataFrame([(p,) for p in media_paths], "path string")
    res = links.resolve_local_refs(links.distinct_refs(links.image_refs(docs)), docs, media)
    return links.rewrite_links(docs, res).collect()[0].markdown, res


def test_simple_relative_image(spark):
    out, _ = _run(spark, "![An image](./image.png)", ["/docs/image.png"])
    assert out == "![An image](media/image.png)"


def test_nested_and_parent_and_no_extension(spark):
    out, _ = _run(spark, "![Logo](../assets/logo.png) ![Diagram](./diagram) ![N](img/sub/a.png)",
                  ["/assets/logo.png", "/docs/diagram", "/docs/img/sub/a.png"])
    assert out == "![Logo](media/assets_logo.png) ![Diagram](media/diagram.png) ![N](media/img_sub_a.png)"


def test_title_kept(spark):
    out, _ = _run(spark, '![Chart](./chart.png "Quarterly Results")', ["/docs/chart.png"])
    assert out == '![Chart](media/chart.png "Quarterly Results")'


def test_html_tag_upper_case_single_quotes(spark):
    out, _ = _run(spark, "<IMG SRC='asset.PNG' ALT='X'>", ["/docs/asset.PNG"])
    assert out == "<IMG SRC='media/asset.PNG' ALT='X'>"


def test_remote_absolute_missing_unchanged(spark):
    md = "![r](https://x.org/a.png) ![a](/abs/b.png) ![m](./missing.png) ![d](data:image/png;base64,AA)"
    out, res = _run(spark, md, [])
    assert out == md
    assert [r.ref for r in links.missing_refs(res).collect()] == ["./missing.png"]


def test_longest_ref_first(spark):
    out, _ = _run(spark, "![a](img/a.png) ![b](img/a.png.bak.png)", ["/docs/img/a.png", "/docs/img/a.png.bak.png"])
    assert out == "![a](media/img_a.png) ![b](media/img_a.png.bak.png)"


def test_name_clash_reported(spark):
    _, res = _run(spark, "![a](a/b.png) ![b](a_b.png)", ["/docs/a/b.png", "/docs/a_b.png"])
    clashes = links.media_name_clashes(res, "doc_key").collect()
    assert [(r.media_name, r.refs) for r in clashes] == [("a_b.png", 2)]
