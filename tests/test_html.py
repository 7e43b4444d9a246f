import random
import time

from pyspark.sql import functions as F

from corpusprep.functions.html import fix_media_paths, fix_table_captions, front_matter_title, html_links, html_title, html_to_markdown, table_of_contents
from corpusprep.functions.html_pages import page_markdown, table_grid
from corpusprep.operators import html


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "v string").select(col.alias("o")).collect()[0].o


def test_html_to_markdown(spark):
    src = ("<html><head><title>T &amp; U</title><style>p{}</style><script>x()</script></head><body><!-- c -->"
           "<h2>Sub</h2><p>Some <b>bold</b> and <em>it</em> and <a href=\"/u\">link</a> 3*4</p><ul><li>one</li><li>two</li></ul>"
           "<pre><code>code here</code></pre></body></html>")
    out = _one(spark, html_to_markdown(F.col("v")), src)
    assert out == "## Sub\n\nSome **bold** and *it* and [link](/u) 3\\*4\n\n- one\n- two\n\n```\ncode here\n```"
    assert _one(spark, html_title(F.col("v")), src) == "T & U"


def test_verbatim_tables_lists_and_entities():
    assert page_markdown("<p>a</p><pre><code>x *\n\n\n  y &lt; z</code></pre><p>b</p>") == "a\n\n```\nx *\n\n\n  y < z\n```\n\nb"
    table = "<table><tr><th>Name<th>Age</tr><tr><td>Ann</td><td>42</td></tr><tr><td>a|b</table>"
    assert page_markdown(table) == "| Name | Age |\n| --- | --- |\n| Ann | 42 |\n| a\\|b |  |"
    lists = "<ol><li>one<li>two<ul><li>in</li></ul></li><li>three</ol><ul><li>x</ul>"
    assert page_markdown(lists) == "1. one\n2. two\n   - in\n3. three\n\n- x"
    assert page_markdown("<blockquote>q <b>w</b><p>r</blockquote>s") == "> q **w**\n>\n> r\n\ns"
    assert page_markdown("<img alt='x y' src='a.png'><IMG SRC=b.png>") == "![x y](a.png)![](b.png)"
    assert page_markdown("&eacute;&mdash;&#8217;&#x41;&amp;lt;&copy &bogus;") == "é—’A\\&lt;&copy &bogus;"
    assert page_markdown("a <code>b*c &lt;</code> d*") == "a `b*c <` d\\*"
    nested = "<table><tr><td>o<table><tr><td>i</td><td>j</td></tr></table></td><td>p</td></tr></table>"
    assert page_markdown(nested) == "| o i j | p |\n| --- | --- |"


def test_broken_and_long_pages():
    assert page_markdown("") == "" and page_markdown("a < b") == "a < b" and page_markdown("</p></td></ul></table></pre></blockquote>x") == "x"
    assert page_markdown("<table><tr><td>a") == "| a |\n| --- |" and page_markdown("<pre>a\n b") == "```\na\n b\n```"
    assert page_markdown("<b>open<p>next") == "open\n\nnext" and page_markdown("a\x00b\x011") == "ab1"
    many = page_markdown("<p>x</p>" * 50_000)
    assert many == "\n\n".join(["x"] * 50_000)


def test_text_is_not_lost_to_stray_brackets_or_quoted_attributes():
    assert page_markdown("<p>if a < b and c > d then</p>") == "if a < b and c > d then"
    assert page_markdown('<div title="a>b">x</div>') == "x" and page_markdown("a <3 b <> c") == "a <3 b <> c"
    assert page_markdown('<a href="x>y" title=\'>\'>t</a>') == "[t](<x%3Ey>)"
    assert page_markdown('<p title="never closed>a</p>b') == "a\n\nb" and page_markdown("x <b") == "x \\<b"
    assert page_markdown("<!-- <b> -- > x --><!doctype html>z<? php ?>k<!--open>m") == "zkm"
    assert page_markdown("<script>var a='<p>';</script>z<style>y") == "zy" and page_markdown("<textarea><b></textarea>") == "\\<b>"


def test_text_that_looks_like_markup_is_escaped():
    assert page_markdown("&lt;b&gt; [x](y) # _em_ a_b ` \\* c\\d ~~e~~") == "\\<b> \\[x\\](y) # \\_em\\_ a_b \\` \\\\\\* c\\d \\~~e\\~~"
    assert page_markdown("<p># head</p><p>1. one<br>+ two</p><p>- x<p>&gt; q<p>a<br>---") == "\\# head\n\n1\\. one\n\\+ two\n\n\\- x\n\n\\> q\n\na\n\\---"
    assert page_markdown("<pre>a\n```\nb</pre>") == "````\na\n```\nb\n````" and page_markdown("<code>a`b</code>") == "``a`b``"
    assert page_markdown("<a href='a b)c'>t</a><img src='p (1).png' alt='[z]'>") == "[t](<a b)c>)![\\[z\\]](<p (1).png>)"
    assert page_markdown("<pre><code class='x language-py'>\nx = 1</code></pre>") == "```py\nx = 1\n```"


def test_implied_end_tags():
    assert page_markdown("<h1>a<br>b<p>c<h2>d</h2>") == "# a b\n\nc\n\n## d"
    assert page_markdown("<p>a<table><tr><td>c</p>d<td>e</table>f") == "a\n\n| cd | e |\n| --- | --- |\n\nf"
    assert page_markdown("<div><ul><li>x</div>y") == "- x\n\ny" and page_markdown("<b><i>x</b></i> y") == "**x** y"
    assert page_markdown("<ul>\n<li>a</li>\n<li><p>b</p><pre>c\n  d</pre></li>\n</ul>\ntext") == "- a\n- b\n\n  ```\n  c\n    d\n  ```\n\ntext"
    assert page_markdown("<ol start=5><li>a<li>b<li value=9>c</ol>") == "5. a\n6. b\n9. c" and page_markdown("x<hr>y") == "x\n\n---\n\ny"


def _plain_grid(rows):
    """Cells on a plain grid: (row, column) -> text, '' where a cell is covered."""
    grid, width = {}, 0
    for r, cells in enumerate(rows):
        c = 0
        for text, wide, high in cells:
            while (r, c) in grid:
                c += 1
            for i in range(len(rows) - r if high == 0 else high):
                for j in range(wide):
                    grid.setdefault((r + i, c + j), text if i == j == 0 else "")
            c += wide
        width = max(width, c, *(k[1] + 1 for k in grid if k[0] == r))
    return [[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def test_spans_place_cells_under_their_columns():
    table = "<table><tr><th>A<th>B<th>C</tr><tr><td rowspan=2>1<td colspan=2>2<tr><td>4<td>5</table>"
    assert page_markdown(table) == "| A | B | C |\n| --- | --- | --- |\n| 1 | 2 |  |\n|  | 4 | 5 |"
    rnd = random.Random(4)
    for _ in range(300):
        rows = [[(f"r{r}c{c}", rnd.choice([1, 1, 2, 3]), rnd.choice([1, 1, 1, 2, 0])) for c in range(rnd.randrange(1, 5))] for r in range(rnd.randrange(1, 6))]
        width = max(map(len, table_grid(rows)))
        got = [r + [""] * (width - len(r)) for r in table_grid(rows)]
        want = _plain_grid(rows)
        assert [[x for x in r if x] for r in got] == [[x for x in r if x] for r in want]
        if all(h != 0 and w == 1 for r in rows for _, w, h in r):
            assert got == [r + [""] * (width - len(r)) for r in want]


def test_bad_pages_take_linear_time():
    pages = ["<!--" * 20_000, "<b>x" * 50_000, "< " * 80_000, '<a x=">"' * 50_000, "<code>x" * 50_000 + "</code>" * 50_000, "<b>" * 20_000 + "</i>" * 20_000,
             "<div>" * 50_000 + "</p>" * 50_000, "<script>" * 50_000, "<a" * 100_000, "<b>x" * 250_000, "<table><tr><td>" + "<div>" * 30_000 + "</table>x"]
    for page in pages:
        start = time.process_time()
        page_markdown(page)
        assert time.process_time() - start < 5, page[:20]


def test_links_and_contents(spark):
    page = "<a href='x'>1</a><a data-href=no href=y>2</a><a class=\"c\" href=\"z\">3</a>"
    assert _one(spark, html_links(F.col("v")), page) == ["x", "y", "z"]
    assert _one(spark, table_of_contents(F.col("v")), "# A\n\n```sh\n# no\n```\n\n## B\n\n````\n```\n# no\n````") == "- A\n  - B"


def test_null_page(spark):
    assert spark.createDataFrame([(None,)], "v string").select(html_to_markdown(F.col("v")).alias("o")).collect()[0].o is None


def test_fixes(spark):
    assert _one(spark, fix_media_paths(F.col("v")), "![a](media/media/img.png)") == "![a](media/img.png)"
    assert _one(spark, fix_table_captions(F.col("v")), "x\n\n: []{#t}Tabela 1 - y") == "x\n\n**Tabela 1 - y**"
    assert _one(spark, front_matter_title(F.col("v")), "---\ntitle: My Document\n---\nbody") == "My Document"
    assert _one(spark, front_matter_title(F.col("v")), "no front matter") is None


def test_external_images(spark):
    page = '<img src="http://h/a.jpg"><img src="http://h/a.jpg"><img src="https://h/b.png"><img src="local.png">'
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    rep = html.external_image_report(pages).collect()[0]
    assert (rep.total_images, rep.unique_images) == (3, 2)
    plan = html.fetch_plan(html.external_images(pages))
    out = html.localize_images(pages, plan).collect()[0].html
    assert out.count('src="media/ext_img_') == 3 and 'src="local.png"' in out
    names = {r.url: r.local_name for r in plan.collect()}
    assert names["http://h/a.jpg"].endswith(".jpg") and names["https://h/b.png"].endswith(".png")
