"""Sizes of image files from their headers, and the page each makes."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A page's long side in points, and turns of the orientation tag (mirrored ones count as none).
LONG_SIDE = 842.0
TURNS = {3: 180, 6: 270, 8: 90}


def header(data: bytes) -> tuple[int, int, int] | None:
    """(width, height, orientation tag) of a PNG or JPEG; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return (*struct.unpack(">II", data[16:24]), 1)
    if data[:2] != b"\xff\xd8":
        return None
    at, turn = 2, 1
    while at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turn = _orientation(data[at + 10 : at + 2 + size])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h, turn
        at += 2 + size
    return None


def _orientation(tiff: bytes) -> int:
    order = "<" if tiff[:2] == b"II" else ">"
    try:
        (at,) = struct.unpack(order + "I", tiff[4:8])
        (n,) = struct.unpack(order + "H", tiff[at : at + 2])
        for i in range(n):
            tag, _, _, value = struct.unpack(order + "HHIH", tiff[at + 2 + 12 * i : at + 12 + 12 * i])
            if tag == 0x0112:
                return value
    except struct.error:
        pass
    return 1


def sizes(files: DataFrame) -> DataFrame:
    """(path, pixel_width, pixel_height, tag) of files (path, content); nulls for what is no image."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [header(bytes(c)) or (None, None, None) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], **{n: pd.array([f[i] for f in found], "Int32") for i, n in enumerate(("pixel_width", "pixel_height", "tag"))}})

    return files.select("path", "content").mapInPandas(run, "path string, pixel_width int, pixel_height int, tag int")


def rotation(tag: Column) -> Column:
    out = F.lit(0)
    for k, turn in TURNS.items():
        out = F.when(tag == k, turn).otherwise(out)
    return out


def pages(images: DataFrame) -> DataFrame:
    """Page sizes: turned by a quarter the sides change places; the long side is fixed, the shape kept."""
    turn = rotation(F.col("tag"))
    quarter = turn.isin(90, 270)
    w, h = F.when(quarter, F.col("pixel_height")).otherwise(F.col("pixel_width")), F.when(quarter, F.col("pixel_width")).otherwise(F.col("pixel_height"))
    scale = F.lit(LONG_SIDE) / F.greatest(w, h)
    return images.select("path", turn.alias("rotation"), (w * scale).alias("width"), (h * scale).alias("height"))
