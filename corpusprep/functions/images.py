"""Column functions on image bytes and names, JVM-side but for the headers that have to be walked."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions.common import col_of

# Leading bytes (hex) of the image types told apart, and their extensions.
MAGIC = [
    ("FFD8", ".jpg"),
    ("89504E470D0A1A0A", ".png"),
    ("474946383761", ".gif"),
    ("474946383961", ".gif"),
    ("424D", ".bmp"),
    ("49492A00", ".tif"),
    ("4D4D002A", ".tif"),
]


def _starts(b: Column, hex_prefix: str) -> Column:
    return F.substring(b, 1, len(hex_prefix) // 2) == F.unhex(F.lit(hex_prefix))


def sniff_image_type(image) -> Column:
    """Extension from magic bytes: jpg, png, gif (87a/89a), bmp, tif, webp; else ``.png``."""
    b = col_of(image)
    webp = _starts(b, "52494646") & (F.substring(b, 9, 4) == F.unhex(F.lit("57454250")))
    out = None
    for hx, ext in MAGIC:
        out = F.when(_starts(b, hx), F.lit(ext)) if out is None else out.when(_starts(b, hx), F.lit(ext))
    return out.when(webp, F.lit(".webp")).otherwise(F.lit(".png"))


def _be(b: Column, pos, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` bytes at 1-based ``pos``."""
    pos = pos if isinstance(pos, Column) else F.lit(pos)
    return F.conv(F.hex(F.substring(b, pos, F.lit(n))), 16, 10).cast("bigint")


def _le(b: Column, pos: int, n: int) -> Column:
    """Unsigned little-endian integer of ``n`` bytes at 1-based ``pos``."""
    total = F.lit(0).cast("bigint")
    for i in range(n):
        total = total + _be(b, pos + i, 1) * (256 ** i)
    return total


def jpeg_size(b: bytes) -> tuple[int, int] | None:
    """(width, height) from the first start-of-frame marker of any kind, however many segments come before."""
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no length
            at += 2
        elif marker in (0xD9, 0xDA):  # end, or image data without a frame
            return None
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(b):
                return None
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return width, height
        else:
            size = int.from_bytes(b[at + 2 : at + 4], "big")
            if size < 2:
                return None
            at += 2 + size
    return None


def tiff_size(b: bytes) -> tuple[int, int] | None:
    """(width, height) from tags 256 and 257 of the first directory."""
    order = "<" if b[:2] == b"II" else ">"
    if len(b) < 8:
        return None
    (at,) = struct.unpack(order + "I", b[4:8])
    found = {}
    if at + 2 <= len(b):
        (n,) = struct.unpack(order + "H", b[at : at + 2])
        for i in range(n):
            entry = b[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind = struct.unpack(order + "HH", entry[:4])
            if tag in (256, 257) and kind in (3, 4):
                found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (found[256], found[257]) if len(found) == 2 else None


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def _walked_size(images: pd.Series) -> pd.DataFrame:
    sizes = [None if b is None else jpeg_size(b) if b[:2] == b"\xff\xd8" else tiff_size(b) for b in images]
    return pd.DataFrame({
        k: pd.array([None if s is None else s[i] for s in sizes], dtype="Int64") for i, k in enumerate(("width", "height"))
    })


def image_size(image) -> Column:
    """``struct(width, height)`` read from the header of PNG, GIF, BMP, WebP, JPEG and TIFF bytes; nulls otherwise.

    JPEG and TIFF headers have to be walked, in an Arrow function that gets nulls for all other images.
    """
    b = col_of(image)
    png = _starts(b, "89504E470D0A1A0A")
    gif = _starts(b, "474946383761") | _starts(b, "474946383961")
    bmp = _starts(b, "424D")
    webp = _starts(b, "52494646") & (F.substring(b, 9, 4) == F.unhex(F.lit("57454250")))
    chunk = F.substring(b, 13, 4)
    extended, lossless, lossy = (webp & (chunk == F.unhex(F.lit(x))) for x in ("56503858", "5650384C", "56503820"))
    bits = _le(b, 22, 4)
    walked = _walked_size(F.when(_starts(b, "FFD8") | _starts(b, "49492A00") | _starts(b, "4D4D002A"), b))
    width = (
        F.when(png, _be(b, 17, 4)).when(gif, _le(b, 7, 2)).when(bmp, _le(b, 19, 4)).when(extended, _le(b, 25, 3) + 1)
        .when(lossless, bits.bitwiseAND(F.lit(0x3FFF)) + 1).when(lossy, _le(b, 27, 2).bitwiseAND(F.lit(0x3FFF))).otherwise(walked["width"])
    )
    height = (
        F.when(png, _be(b, 21, 4)).when(gif, _le(b, 9, 2)).when(bmp, _le(b, 23, 4)).when(extended, _le(b, 28, 3) + 1)
        .when(lossless, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1).when(lossy, _le(b, 29, 2).bitwiseAND(F.lit(0x3FFF)))
        .otherwise(walked["height"])
    )
    return F.struct(width.alias("width"), height.alias("height"))


def image_format(name) -> Column:
    """Save format from a file name: ``.jpg``/``.jpeg`` -> ``JPEG``, else ``PNG``."""
    n = F.lower(col_of(name))
    return F.when(n.endswith(".jpg") | n.endswith(".jpeg"), F.lit("JPEG")).otherwise(F.lit("PNG"))


def data_uri(image, fmt) -> Column:
    """``data:image/<fmt>;base64,<bytes>`` without line breaks."""
    b64 = F.replace(F.replace(F.base64(col_of(image)), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    return F.concat(F.lit("data:image/"), F.lower(col_of(fmt)), F.lit(";base64,"), b64)
