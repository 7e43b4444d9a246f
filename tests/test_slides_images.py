import base64
import hashlib

import random
import re
import time

from pyspark.sql import functions as F

from corpusprep.config import Settings
from corpusprep.functions.images import image_size, sniff_image_type
from corpusprep.operators import images, slides

PNG_1x1 = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mP8z8BQDwAEhQGAhKmMIQAAAABJRU5ErkJggg==")
SHAPE = "struct<kind:string,name:string,text:string,is_title:boolean,paragraphs:array<struct<level:int,text:string>>,image:binary,alt:string>"
SCHEMA = f"deck string, core_title string, slide_idx int, notes string, shapes array<{SHAPE}>"


def test_deck(spark):
    shapes = [
        ("text", "Title 1", "Intro", True, None, None, None),
        ("text", "Body", "First\nSecond", False, [(0, "First"), (1, "Second")], None, None),
        ("picture", "Picture 3", None, False, None, PNG_1x1, None),
    ]
    df = spark.createDataFrame([("/d/deck.pptx", "Deck Title", 1, "Remember to demo", shapes)], SCHEMA)
    out = slides.assemble_deck(df).collect()[0]
    name = f"ppt_img_0_{hashlib.md5(PNG_1x1).hexdigest()[:12]}.png"
    assert out.markdown == (
        "# Deck Title\n\n## Intro\n\n* First\n  - Second\n\n![Picture 3](media/" + name + ")\n\n"
        "\n> **Slide Notes:** Remember to demo\n\n\n---\n"
    )
    assert (out.slide_count, out.image_count, out.title) == (1, 1, "Deck Title")


def test_deck_in_parts(spark):
    shapes = [("text", "Title 1", "Intro", True, None, None, None), ("picture", "Picture", None, False, None, PNG_1x1, None)]
    rows = [("/d/big.ppt", None, i, "note", shapes) for i in range(1, 12)] + [("/d/small.pptx", "Small", 1, None, shapes)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    parts = slides.legacy_notice(slides.deck_parts(df, part_slides=4)).collect()
    big = sorted((r for r in parts if r.deck == "/d/big.ppt"), key=lambda r: r.part_no)
    assert [r.part_no for r in big] == [0, 1, 2] and [r.markdown.count("\n---\n") for r in big] == [3 + 1, 4, 4]
    assert {(r.slide_count, r.image_count, r.title) for r in big} == {(11, 11, "Intro")}
    whole = {r.deck: r.markdown for r in slides.legacy_notice(slides.assemble_deck(df)).collect()}
    assert "\n".join(r.markdown for r in big) == whole["/d/big.ppt"]
    assert [r.markdown for r in parts if r.deck == "/d/small.pptx"] == [whole["/d/small.pptx"]]


def test_legacy_notice(spark):
    df = spark.createDataFrame([("/d/old.ppt", "x"), ("/d/err.ppt", "# Error here"), ("/d/new.pptx", "y")], "deck string, markdown string")
    got = {r.deck: r.markdown for r in slides.legacy_notice(df).collect()}
    assert got["/d/old.ppt"].startswith("# PPT Format Notice") and got["/d/old.ppt"].endswith("x")
    assert got["/d/err.ppt"] == "# Error here" and got["/d/new.pptx"] == "y"


def test_magic_bytes(spark):
    vals = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\nxxxx", b"GIF89a...", b"RIFF\x00\x00\x00\x00WEBPVP8 ", b"other"]
    df = spark.createDataFrame([(v,) for v in vals], "b binary")
    assert [r[0] for r in df.select(sniff_image_type(F.col("b"))).collect()] == [".jpg", ".png", ".gif", ".webp", ".png"]


def test_png_size_and_triage(spark):
    df = spark.createDataFrame([("d", "P1", "one.png", PNG_1x1), ("d", "P2", "two.dat", PNG_1x1)],
                               "doc_key string, placeholder string, filename string, bytes binary")
    size = df.select(image_size(F.col("bytes")).alias("s")).collect()[0].s
    assert (size.width, size.height) == (1, 1)
    relink = images.triage_images(df, Settings()).collect()
    assert sorted(r.new_path for r in relink) == ["media/one.png", "media/two.png"]
    removed = images.triage_images(df, Settings(exclude_decorative=True, decorative_threshold_px=100)).collect()
    assert {r.action for r in removed} == {"remove"}
    embedded = images.triage_images(df, Settings(embed_small_images=True, small_image_threshold_kb=1024)).collect()
    assert all(r.action == "embed" and r.data_uri.startswith("data:image/png;base64,iVBOR") for r in embedded)


def test_markdown_edits(spark):
    docs = spark.createDataFrame([("d", '![A](P1) ![B](P2 "t") ![C](P3)')], "doc_key string, markdown string")
    dec = spark.createDataFrame(
        [("d", "P1", "relink", None, "media/p1.png"), ("d", "P2", "embed", "data:image/png;base64,AA", None), ("d", "P3", "remove", None, None)],
        "doc_key string, placeholder string, action string, data_uri string, new_path string",
    )
    out = images.apply_image_decisions(docs, dec).collect()[0].markdown
    assert out == '![A](media/p1.png) ![B](data:image/png;base64,AA "t") '


def _jpeg(segments, sof, width, height):
    body = b"".join(bytes([0xFF, 0xE1]) + (2 + 5).to_bytes(2, "big") + b"xxxxx" for _ in range(segments))
    frame = bytes([0xFF, sof]) + (11).to_bytes(2, "big") + b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x11\x00"
    return b"\xff\xd8" + body + frame


def _tiff(order, width, height):
    pack = lambda n, v: v.to_bytes(n, "little" if order == b"II" else "big")
    entry = lambda tag, kind, v: pack(2, tag) + pack(2, kind) + pack(4, 1) + (pack(2, v) + b"\0\0" if kind == 3 else pack(4, v))
    return order + pack(2, 42) + pack(4, 8) + pack(2, 2) + entry(256, 3, width) + entry(257, 4, height)


def test_sizes_of_every_header(spark):
    webp = lambda chunk, rest: b"RIFF\0\0\0\0WEBP" + chunk + b"\0\0\0\0" + rest
    images = {
        "jpeg40": _jpeg(40, 0xC0, 10, 20), "sof9": _jpeg(0, 0xC9, 30, 40), "sof2": _jpeg(100, 0xC2, 5, 6), "tiff": _tiff(b"II", 70, 80),
        "tiff_be": _tiff(b"MM", 7, 8), "vp8x": webp(b"VP8X", b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")),
        "vp8l": webp(b"VP8L", b"\x2f" + ((13 - 1) | (17 - 1) << 14).to_bytes(4, "little")),
        "vp8": webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + (21).to_bytes(2, "little") + (22).to_bytes(2, "little")),
        "cut": b"\xff\xd8\xff\xe0\xff\xff", "none": b"", "text": b"plain text",
    }
    df = spark.createDataFrame(list(images.items()), "n string, b binary")
    got = {r.n: (r.s.width, r.s.height) for r in df.select("n", image_size(F.col("b")).alias("s")).collect()}
    assert got == {
        "jpeg40": (10, 20), "sof9": (30, 40), "sof2": (5, 6), "tiff": (70, 80), "tiff_be": (7, 8), "vp8x": (100, 50), "vp8l": (13, 17),
        "vp8": (21, 22), "cut": (None, None), "none": (None, None), "text": (None, None),
    }


def test_title_by_placeholder_type(spark):
    from corpusprep.operators import slides

    shape = "kind string, name string, text string, is_title boolean, paragraphs array<struct<level:int,text:string>>, image binary, alt string, placeholder_type int"
    shape = ", ".join(x.replace(" ", ":", 1) for x in shape.split(", "))
    rows = [("d", None, 1, None, [("text", "Box", "body", False, None, None, None, 2), ("text", "Box 2", " The title ", False, None, None, None, 1)]),
            ("d", None, 2, None, [("text", "Box", "no title", False, None, None, None, None)])]
    table = spark.createDataFrame(rows, f"deck string, core_title string, slide_idx long, notes string, shapes array<struct<{shape}>>")
    assert slides.deck_title(table).collect()[0].title == "The title"
    sections = slides.slide_sections(table, slides.slide_images(table, with_bytes=False)).orderBy("slide_idx").collect()
    assert sections[0].section.startswith("## The title\n") and sections[1].section.startswith("## Slide 2\n")


def _one_by_one(text, edits):
    """The longest placeholder first, a pass of the text for each."""
    for e in sorted(edits, key=lambda e: -len(e["placeholder"])):
        pattern = r"!\[([^\]]*)\]\(" + re.escape(e["placeholder"]) + r'(\s*"(?:[^"]*)")?\)'
        text = re.sub(pattern, lambda m, e=e: "" if e["action"] == "remove" else f"![{m[1]}]({e['target']}{m[2] or ''})", text)
    return text


def test_placeholders_with_blanks_and_brackets_longest_first(spark):
    rnd = random.Random(6)
    names = ["a", "a b", "a b (1).png", "a b (1", 'a "t"', "x)y", "p q", "p", "p q r"]
    edits = [{"placeholder": n, "action": rnd.choice(["remove", "relink", "embed"]), "target": None if i % 9 == 8 else f"media/{i}.png"} for i, n in enumerate(names[:-1])]
    for _ in range(200):
        links = [f"![alt {i}]({rnd.choice(names)}{rnd.choice(['', ' "title"', ' x'])})" for i in range(6)]
        text = " text ] ( ".join(links) + rnd.choice(["", "![open](a b", "![", "](a b)"])
        assert images.edited(text, edits) == _one_by_one(text, edits)
    docs = spark.createDataFrame([("d", "![x](a b) ![y](a b (1).png \"t\") ![z](plain.png)"), ("e", "![z](plain.png)"), ("f", "![n](none)"), ("g", None)], "doc_key string, markdown string")
    rows = [("d", "a b", "relink", None, "media/1.png"), ("d", "a b (1).png", "relink", None, "media/2.png"), ("d", "plain.png", "remove", None, None), ("e", "plain.png", "embed", "data:x", None), ("g", "a b", "remove", None, None)]
    decisions = spark.createDataFrame(rows, "doc_key string, placeholder string, action string, data_uri string, new_path string")
    got = {r.doc_key: r.markdown for r in images.apply_image_decisions(docs, decisions).collect()}
    assert got == {"d": "![x](media/1.png) ![y](media/2.png \"t\") ", "e": "![z](data:x)", "f": "![n](none)", "g": None}


def test_edits_of_a_thousand_placeholders_take_one_scan():
    edits = [{"placeholder": f"dir {i}/image ({i}).png", "action": "relink", "target": f"media/{i}.png"} for i in range(1000)]
    text = "".join(f"some text ![alt](dir {i % 1000}/image ({i % 1000}).png) " for i in range(50_000))
    start = time.process_time()
    assert images.edited(text, edits).count("](media/") == 50_000
    assert time.process_time() - start < 10


def test_links_are_joined_with_decisions(spark):
    """Not looked up in a map, which is searched from its start: equal keys, order, unknown and missing targets."""
    docs = spark.createDataFrame([("d", "".join(f"{i}![{i}](p{i} \"t\")" for i in range(300)) + "end"), ("d", "![a](p1)"), (None, "![a](p1)"), ("e", None)], "doc_key string, markdown string")
    rows = [("d", f"p{i}", "remove" if i % 3 == 0 else "relink", None, f"m{i}") for i in range(0, 300, 2)] + [("d", "p1", "relink", None, "one"), ("e", "p1", "remove", None, None)]
    decisions = spark.createDataFrame(rows, "doc_key string, placeholder string, action string, data_uri string, new_path string")
    out = images.apply_image_decisions(docs, decisions)
    assert "map_from_entries" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    target = lambda i: "one" if i == 1 else f"m{i}" if i % 2 == 0 else f"p{i}"
    long = "".join(f"{i}" + ("" if i % 6 == 0 else f"![{i}]({target(i)} \"t\")") for i in range(300)) + "end"
    assert sorted((r.doc_key or "", r.markdown or "") for r in out.collect()) == sorted([("d", long), ("d", "![a](one)"), ("", "![a](p1)"), ("e", "")])
    assert images.apply_image_decisions(docs, decisions.where("doc_key = 'd'")).where("doc_key = 'e'").first().markdown is None


def test_images_of_a_small_table_are_made_in_many_tasks(spark, tmp_path, monkeypatch):
    from corpusprep.plans import standins

    monkeypatch.setattr(standins, "IMAGES_OF_A_TASK", 10)
    spark.range(95).selectExpr("id AS p_partkey", "'some part' AS p_name", "id % 50 + 1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = standins.part_images(spark, str(tmp_path))
    assert made.count() == 95 and made.rdd.getNumPartitions() == 10
