from corpusprep.config import Settings
from corpusprep.operators import html


def test_settings_defaults_and_unknown_keys():
    s = Settings.from_dict({"max_rows_display": 10, "limit_image_download": True})
    assert s.max_rows_display == 10 and s.max_columns_display is None
    assert s.get("limit_image_download", "missing") == "missing"
    assert s.get("pandoc_toc") is False
    assert Settings.from_dict(s.to_dict()) == s


def test_html_toc_option(spark):
    pages = spark.createDataFrame([(1, "<title>T</title><h1>One</h1><p>a</p><h2>Two</h2><p>b</p>")], "page_id long, html string")
    md = html.html_documents(pages, settings=Settings(pandoc_toc=True)).collect()[0].markdown
    assert md == "---\ntitle: T\n---\n\n- One\n  - Two\n\n# One\n\na\n\n## Two\n\nb"
    plain = html.html_documents(pages).collect()[0].markdown
    assert plain == "---\ntitle: T\n---\n\n# One\n\na\n\n## Two\n\nb"
